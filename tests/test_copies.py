"""Copies under new keys, their checks, and backups matched with documents."""

import random
import uuid

from pyspark.sql import functions as F

from fernloom.operators import matching, migration

SPACE = "1b4e28ba-2fa1-5d1e-883f-0016d3cca427"


def test_name_uuid(spark):
    names = [*(f"document:{i}" for i in range(300)), "", "é 한", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", migration.name_uuid(SPACE, F.col("n")).alias("u")).collect()
    assert all(r["u"] == (None if r["n"] is None else str(uuid.uuid5(uuid.UUID(SPACE), r["n"]))) for r in rows)


def test_to_copy(spark):
    kind = "id int, a string"
    source = spark.createDataFrame([(1, "x"), (2, "z"), (2, "y"), (3, None), (None, "n"), (4, "w")], kind)
    target = spark.createDataFrame([(4, "other")], kind)
    new = migration.to_copy(source, target, ["id"])
    assert sorted(tuple(r) for r in new.collect()) == [(1, "x"), (2, "y"), (3, None)]
    assert migration.to_copy(source, target.union(new), ["id"]).count() == 0
    links = source.select("id").dropna()
    assert sorted(r[0] for r in migration.to_copy(links, links.where("id = 1"), ["id"]).collect()) == [2, 3, 4]
    assert migration.to_copy(source.limit(0), target, ["id"]).count() == 0


def test_parity(spark):
    a, b = spark.range(5), spark.range(3)
    rows = migration.parity({"x": (a, b), "y": (a, a), "none": (a.limit(0), a.limit(0))}).collect()
    assert sorted(tuple(r) for r in rows) == [("none", 0, 0, True), ("x", 5, 3, False), ("y", 5, 5, True)]


def test_differences(spark):
    kind = "k int, text string, n int"
    rows = [(i, f"text {i}", i % 3) for i in range(500)]
    target = list(rows)
    target[7], target[8] = (7, "text 8", 2), (8, "text 7", 1)  # texts that changed places
    target[20] = (20, None, 2)
    target[30] = (30, "text 30", None)
    del target[100]
    target += [(900, "new", 1), (5, "text 5", 2)]  # a new key, a row twice
    rows += [(600, None, None), (None, "a", 1), (601, "", 1)]
    target += [(600, "", None), (None, "a", 1), (601, None, 1)]
    random.Random(1).shuffle(target)
    source, other = spark.createDataFrame(rows, kind), spark.createDataFrame(target, kind)
    want = {7: "changed", 8: "changed", 20: "changed", 30: "changed", 100: "missing", 900: "extra", 5: "changed", 600: "changed", 601: "changed"}
    for buckets in (1, 16, 4096):
        assert {r["key"]: r["kind"] for r in migration.differences(source, other, "k", ["text", "n"], buckets).collect()} == want
    assert migration.differences(source, source.repartition(7), "k", ["text", "n"]).count() == 0
    assert migration.differences(source.limit(0), source.limit(0), "k", ["text"]).count() == 0
    assert {r["kind"] for r in migration.differences(source, source.limit(0), "k", ["text"]).collect()} == {"missing"}


def plain(backup, docs):
    seen = [d for d in docs if d["public"] or (backup["user"] is not None and d["owner"] == backup["user"])]
    if found := [d for d in seen if backup["id"] is not None and d["doc"] == backup["id"]]:
        return found[0]["doc"], "id"
    if found := [d for d in seen if backup["title"] is not None and d["title"] == backup["title"]]:
        at = lambda d: d["updated"] if d["updated"] is not None else d["created"]
        return max(found, key=lambda d: (at(d) is not None, at(d) or 0, d["doc"]))["doc"], "title"
    if found := [d for d in seen if d["content"] and (backup["content"] or "")[:500] == d["content"][:500]]:
        return min(d["doc"] for d in found), "content"
    return None, None


def test_match_backups(spark):
    r = random.Random(3)
    pick = lambda *xs: r.choice(xs)
    long = "é" * 500
    docs = [{"doc": i, "owner": pick(1, 2, None), "public": pick(True, False, None), "title": pick("a", "b", "c", None, ""), "content": pick("x", "y", "", None, long + "1", long[:-1]), "updated": pick(None, 1, 2), "created": pick(None, 1, 3)} for i in range(40)]
    backups = [{"backup_id": i, "user": pick(1, 2, 3, None), "id": pick(None, None, None, r.randrange(60)), "title": pick("a", "d", None, "", "z"), "content": pick("x", "q", "", None, long + "2", long[:-1])} for i in range(200)]
    backups += backups[:3]
    got = matching.match_backups(
        spark.createDataFrame([tuple(b.values()) for b in backups], "backup_id int, user int, id int, title string, content string"),
        spark.createDataFrame([tuple(d.values()) for d in docs], "doc int, owner int, public boolean, title string, content string, updated int, created int"),
    )
    rows = [tuple(x) for x in got.collect()]
    key = lambda t: (t[0], str(t))
    assert sorted(rows, key=key) == sorted(((b["backup_id"], *plain(b, docs)) for b in backups), key=key)
    assert {x[2] for x in rows} == {"id", "title", "content", None}
    none = spark.createDataFrame([], "doc int, owner int, public boolean, title string, content string, updated int, created int")
    assert {x[1] for x in matching.match_backups(spark.createDataFrame([(1, None, 1, "a", "x")], "backup_id int, user int, id int, title string, content string"), none).collect()} == {None}
