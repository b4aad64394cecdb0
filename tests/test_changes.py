"""The change feed against a plain recount, and paths in graphs against plain search."""

import random
from collections import Counter

import pytest

from fernloom.operators import graph
from fernloom.streaming.changes import ChangeFeed

SCHEMA = "key long, seq long, op string, grp string, at timestamp"


def state(rows):
    last = {}
    for key, seq, op, grp, _ in rows:
        if key is not None and seq is not None and op != "view" and (key not in last or seq > last[key][0]):
            last[key] = (seq, op, grp)
    return {k: v for k, v in last.items() if v[1] != "delete"}


@pytest.mark.parametrize("compact", [3, 100])
def test_counters(spark, tmp_path, compact):
    rng = random.Random(compact)
    ops = ["insert", "update", "update", "delete", "view"]
    rows = [(rng.randint(0, 30), seq, rng.choice(ops), rng.choice(["a", "b", None]), None) for seq in range(260)]
    rng.shuffle(rows)
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    batches[2] += batches[1][:10]  # changes that come again
    batches[3] = []
    batches[4] += [(None, 5, "insert", "a", None), (5, None, "insert", "a", None)]
    feed = ChangeFeed(spark, str(tmp_path), compact=compact)
    assert feed.counts().count() == feed.current().count() == feed.views().count() == 0
    done, views = [], Counter()
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        feed.apply(df, n)
        if n in (1, 4):
            feed.apply(df, n)  # a batch that is run again
        done += batch
        views.update(r[0] for r in batch if r[2] == "view" and r[0] is not None)
        if n in (0, 4, len(batches) - 1):
            want = state(done)
            assert {r["key"]: (r["seq"], r["op"], r["grp"]) for r in feed.current().collect()} == want
            assert {r["grp"]: r["n"] for r in feed.counts().collect()} == dict(Counter(v[2] for v in want.values()))
    assert {r["key"]: r["n"] for r in feed.views().collect()} == dict(views)


def test_follow(spark, tmp_path):
    rows = [(k, s, "insert" if s < 3 else "delete", f"g{k % 2}", None) for k in range(6) for s in range(k % 4 + 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    feed = ChangeFeed(spark, str(tmp_path / "feed"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed.follow(stream)
    feed.follow(stream)  # nothing new
    assert {r["grp"]: r["n"] for r in feed.counts().collect()} == dict(Counter(v[2] for v in state(rows).values()))


def test_paths(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(55)} | {(100, 101), (7, 7)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for depth in (1, 3, 10):
        want, last = {0: [0]} if 0 in near else {}, [0]
        for _ in range(depth):
            new = {}
            for a in sorted(last):
                for b in near.get(a, ()):
                    if b not in want and (b not in new or a < new[b][-2]):
                        new[b] = want[a] + [b]
            want |= new
            last = list(new)
        got = {r["node"]: (r["distance"], r["path"]) for r in graph.paths(edges, 0, depth).collect()}
        assert got == {n: (len(p) - 1, p) for n, p in want.items()}
    far = max(want, key=lambda n: (len(want[n]), n))
    assert [tuple(r) for r in graph.paths(edges, 0, 10, far).collect()] == [(far, len(want[far]) - 1, want[far])]
    assert graph.paths(edges, 0, 10, 101).count() == graph.paths(edges, 999).count() == 0
    assert [tuple(r) for r in graph.paths(edges, 100, 5, 100).collect()] == [(100, 0, [100])]
