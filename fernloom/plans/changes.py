"""Queries of a change feed and its counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernloom.session import load
from fernloom.sources.files import scratch
from fernloom.streaming.changes import ChangeFeed

C = F.col
_DONE: dict[tuple[str, str], ChangeFeed] = {}


def _feed(spark, d) -> ChangeFeed:
    """The orders as changes of their customers, in batches and in no order, applied once for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _DONE:
        n = C("o_orderkey")
        op = F.when(n % 5 == 0, "delete").when(n % 7 == 0, "view").when(n % 2 == 0, "insert").otherwise("update")
        changes = load(spark, d, "orders").select(C("o_custkey").cast("long").alias("key"), n.cast("long").alias("seq"), op.alias("op"), C("o_orderpriority").alias("grp"), C("o_orderdate").cast("timestamp").alias("at"))
        source = scratch(spark)
        changes.repartition(4, F.xxhash64("seq")).write.parquet(source)
        feed = ChangeFeed(spark, scratch(spark), compact=2)
        feed.follow(spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source))
        _DONE[key] = feed
    return _DONE[key]


def maintained_counts(spark, d):
    """Live keys of each group, from counters that every batch has moved."""
    return _feed(spark, d).counts()


def live_rows(spark, d):
    return _feed(spark, d).current().select("key", "seq", "grp", C("at").cast("date").alias("at"))


def view_counts(spark, d):
    return _feed(spark, d).views()


_LAST = "WITH l AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"
QUERIES = {
    "maintained_counts": (maintained_counts, f"{_LAST} SELECT o_orderpriority AS grp, count(*) AS n FROM l WHERE o_orderkey % 5 <> 0 GROUP BY 1"),
    "live_rows": (live_rows, f"{_LAST} SELECT CAST(o_custkey AS BIGINT) AS key, CAST(o_orderkey AS BIGINT) AS seq, o_orderpriority AS grp, CAST(o_orderdate AS DATE) AS at FROM l WHERE o_orderkey % 5 <> 0"),
    "view_counts": (view_counts, "SELECT CAST(o_custkey AS BIGINT) AS key, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 GROUP BY 1"),
}
