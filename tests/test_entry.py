"""Every query of the library against its SQL on the smallest tables, where they are."""

import math
import os

import duckdb
import pytest

from fernloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


NO_SQL = {"communities", "chunk_sentences", "chunk_paragraphs", "kmeans_clusters", "edit_fold", "unified_diffs", "cluster_quality", "lda_topics", "semantic_chunks", "marked_headlines", "ward_clusters", "cluster_choice", "auto_clusters"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query(spark, con, name):
    run, sql = catalogue()[name]
    df = run(spark, SF)
    rows = df.collect()
    # a query that finds nothing shows nothing; these are held against plain code in test_units
    assert rows
    if sql is None:
        assert name in NO_SQL
        return
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)
