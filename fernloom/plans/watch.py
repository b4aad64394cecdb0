"""Queries of a watched folder."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernloom.session import load
from fernloom.sources.files import scratch
from fernloom.streaming.watch import FolderWatch

C = F.col
START = datetime.datetime(2024, 1, 1)


def _files(spark, d, scan: int) -> DataFrame:
    """The documents as files that come, change and go from scan to scan, a minute apart; some are written just then."""
    i, at = C("doc_id"), F.lit(START.isoformat()).cast("timestamp")
    there = (i % 7 != 3 if scan == 0 else i % 5 != 1 if scan == 1 else i % 4 != 2)
    changes = (F.when((i % 3 == 0) & (scan >= 1), 60).otherwise(0) + F.when((i % 11 == 0) & (scan >= 2), 60).otherwise(0)).cast("int")
    late = F.when((i % 13 == 5) & (scan == 1), 60).otherwise(changes - 10)
    path = F.concat(F.when(i % 17 == 4, "/in/.git/").otherwise("/in/"), C("source"), F.lit("/"), i.cast("string"), F.lit(".md"))
    modified = F.timestamp_seconds(F.unix_timestamp(at) + late)
    return load(spark, d, "documents").where(there).select(path.alias("path"), modified.alias("modified"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


def watched_files(spark, d):
    """Events of three scans."""
    watch = FolderWatch(spark, scratch(spark))
    scans = [watch.scan(_files(spark, d, n), START + datetime.timedelta(minutes=n), n).select(F.lit(n).alias("scan"), "path", "event", "size") for n in range(3)]
    return reduce(DataFrame.unionByName, scans)


WATCHED = """WITH d AS (SELECT doc_id AS i, '/in/' || source || '/' || doc_id || '.md' AS path, strlen(coalesce(text, '')) AS size FROM documents WHERE doc_id % 17 <> 4),
f AS (SELECT *, i % 7 <> 3 AS t0, i % 5 <> 1 AS t1, i % 4 <> 2 AS t2, CASE WHEN i % 3 = 0 THEN 50 ELSE -10 END AS m1, i % 13 = 5 AS late, CASE WHEN i % 3 = 0 THEN 50 ELSE -10 END + CASE WHEN i % 11 = 0 THEN 60 ELSE 0 END AS m2 FROM d),
a AS (SELECT *, CASE WHEN t0 THEN -10 END AS s0, CASE WHEN NOT t1 THEN NULL WHEN late THEN CASE WHEN t0 THEN -10 END ELSE m1 END AS s1, CASE WHEN t2 THEN m2 END AS s2 FROM f)
SELECT 0 AS scan, path, 'created' AS event, size FROM a WHERE t0
UNION ALL SELECT 1, path, CASE WHEN NOT t1 THEN 'deleted' WHEN s0 IS NULL THEN 'created' ELSE 'modified' END, size FROM a WHERE (t0 AND NOT t1) OR (t1 AND NOT late AND s1 IS DISTINCT FROM s0)
UNION ALL SELECT 2, path, CASE WHEN NOT t2 THEN 'deleted' WHEN s1 IS NULL THEN 'created' ELSE 'modified' END, size FROM a WHERE (s1 IS NOT NULL AND NOT t2) OR (t2 AND s2 IS DISTINCT FROM s1)"""

QUERIES = {"watched_files": (watched_files, WATCHED)}
