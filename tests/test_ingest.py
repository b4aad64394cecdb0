"""The staged ingest: counts, faults, options, tags, and metadata."""

import datetime

import pytest
from pyspark.sql import functions as F

from fernloom.functions import metadata
from fernloom.operators import ingest
from fernloom.operators.ingest import STAGES, Context, Stage, StageError

SCHEMA = "doc_id long, title string, path string, content string"
ROWS = [
    (1, "One", None, "# Head\nSome **bold** words by [me](http://x).\n\nWritten by Jane Roe \n2024-02-30 then 3/4/2023"),
    (2, None, None, "---\ntitle: \"Named\"\nauthor: A\nauthor: 'B'\ndate: 2024-01-15\n---\nbody"),
    (3, "Empty", None, " \n　"),
    (4, "Null", None, None),
    (5, "Big", None, "x" * 200),
    (6, "One", None, "a newer one"),
    (7, "x", "p/a", "in a file"),
    (8, "y", "p/a", "the same file"),
    (9, "  ", None, "First line.\nmore"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_stage(context):
    return {m["stage"]: (m["status"], m["rows_in"], m["failed"], m["rows_out"]) for m in context.metrics}


def test_dry_run(docs):
    context = Context({"max_bytes": 150, "dry": True})
    rows = {r["doc_id"]: r for r in ingest.run(STAGES, docs, context).collect()}
    assert set(rows) == {1, 2, 6, 7, 8, 9}
    assert (rows[1]["author"], rows[1]["date"]) == ("me.", datetime.date(2023, 3, 4))
    assert (rows[2]["title"], rows[2]["author"], rows[2]["date"]) == ("Named", "B", datetime.date(2024, 1, 15))
    assert rows[9]["title"] == "First line" and rows[6]["n_chunks"] == 1
    done = by_stage(context)
    assert done["ingestion"] == ("done", 9, 3, 6) and done["parsing"] == ("done", 6, 0, 6) and done["storage"][0] == done["embedding"][0] == "skipped"
    assert sorted(map(tuple, context.faults[0].collect())) == [(3, "ingestion", "Content cannot be empty"), (4, "ingestion", "Content cannot be empty"), (5, "ingestion", "Content too large")]
    assert ingest.totals(context)["done"] == 4 and ingest.totals(context)["skipped"] == 4


def test_whole_run(spark, docs, tmp_path):
    old = spark.createDataFrame([(100, "One", None, "old one"), (101, "Other", None, "stays")], SCHEMA)
    tags = spark.createDataFrame([(7, "known"), (3, "other")], "tag_id long, tag string")
    topics = F.array(F.lit(" Known "), F.concat(F.lit("New"), F.col("doc_id") % 2), F.lit(""), F.lit(None), F.lit("x" * 51), F.lit("é" * 26))
    embed = lambda c: c.withColumn("vector", F.array(F.length("text").cast("double")))
    context = Context({"store": old, "tags": tags, "analyse": topics, "embed": embed, "index": str(tmp_path / "index"), "chunks": "semantic", "size": 64})
    rows = ingest.run(STAGES, docs, context)
    assert sorted(r["doc_id"] for r in rows.collect()) == [2, 5, 6, 8, 9]
    stored = {r["key"]: r["doc_id"] for r in context.tables["documents"].collect()}
    assert stored == {"title One": 6, "title Named": 2, "title Big": 5, "path p/a": 8, "title First line": 9, "title Other": 101}
    assert sorted(map(tuple, context.tables["tags"].collect())) == [(3, "other"), (7, "known"), (8, "new0"), (9, "new1")]
    assert context.tables["document_tags"].count() == 10
    assert "vector" in context.tables["chunks"].columns and context.tables["chunks"].count() >= 7
    assert {r["doc"] for r in context.tables["index"].ranked("newer").collect()} == {6}
    assert all(m["status"] == "done" for m in context.metrics)


def test_stages(spark, docs):
    def fails(rows, context):
        raise KeyError("no")

    context = Context()
    half = Stage("half", lambda r, c: r.where("doc_id > 4"), lambda c: F.when(F.col("doc_id") == 9, "nine"))
    with pytest.raises(StageError) as e:
        ingest.run([half, Stage("left out", fails, skip=lambda c: True), Stage("bad", fails), half], docs, context)
    assert e.value.stage == "bad" and by_stage(context) == {"half": ("done", 9, 1, 4), "left out": ("skipped", None, None, None), "bad": ("failed", None, None, None)}

    def stop(rows, context):
        context.cancelled = True
        return rows

    context = Context()
    assert ingest.run([Stage("stop", stop), Stage("never", fails)], docs, context).count() == 9
    assert len(context.metrics) == 1
    empty = Context({"analyse": F.array(F.lit("a"))})
    assert ingest.run(STAGES, docs.limit(0), empty).count() == 0 and empty.tables["tags"].count() == 0
    with pytest.raises(StageError):
        ingest.run(STAGES, docs, Context({"chunks": "none"}))


def test_metadata(spark):
    rows = [("Author: Kim\nx", None, None), ("see Written By\tLee Min  \nby me", None, None), ("nothing", None, None), ("---\nauthor: \"X\"\n---\nby Y", None, None), ("due 2023-13-01 or 12/31/2022", None, None), ("1/2/99 2021-05-06", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, c string")
    got = {r["i"]: (r["a"], r["d"]) for r in df.select("i", metadata.author(F.col("c"), F.col("c")).alias("a"), metadata.found_date(F.col("c"), F.col("c")).alias("d")).collect()}
    day = datetime.date
    assert got == {0: ("Kim", None), 1: ("Lee Min", None), 2: (None, None), 3: ("X", None), 4: (None, day(2022, 12, 31)), 5: (None, day(2021, 5, 6)), 6: (None, None)}
