"""Copies of tables under new keys, and checks that a copy is whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a table that are compared by their sums first.
BUCKETS = 1 << 12


def name_uuid(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace; null for a null name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    at = lambda i, n: F.substring(h, i + 1, n)
    variant = F.translate(at(16, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(at(0, 8), F.lit("-"), at(8, 4), F.lit("-5"), at(13, 3), F.lit("-"), variant, at(17, 3), F.lit("-"), at(20, 12))


def to_copy(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of source to append to target so that each key is there once; running it again gives none.

    Both have the same columns. Of rows of source with one key the least is taken.
    Rows with a null in a key are left out, as a key can't be null.
    """
    rest = [c for c in source.columns if c not in keys]
    new = source.dropna(subset=keys).join(target.select(*keys).distinct(), keys, "left_anti")
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else new.distinct()
    return one.select(*(F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in source.columns))


def parity(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table, source_n, target_n, same) of each named pair of tables, counted in one job."""
    sides = [t.select(F.lit(name).alias("table"), F.lit(side).alias("side")) for name, both in pairs.items() for side, t in enumerate(both)]
    counts = reduce(DataFrame.union, [t.groupBy("table", "side").agg(F.count("*").alias("n")) for t in sides])
    known = counts.sparkSession.createDataFrame([(name,) for name in pairs], "table string")
    n = [F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)) for side in (0, 1)]
    return known.join(counts, "table", "left").groupBy("table").agg(n[0].alias("source_n"), n[1].alias("target_n")).withColumn("same", F.col("source_n") == F.col("target_n"))


def differences(source: DataFrame, target: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(key, kind) of the keys that aren't alike: missing in the target, extra in it, or changed.

    Every row is compared, in any order, by hashes of its columns; rows that repeat a
    key are compared as a bag. First each bucket of keys is summed, which moves a row
    for each task and bucket; only rows of buckets whose sums differ are then brought
    together. A null key is a key of its own, and a null isn't an empty text.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    here = [t.select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), *(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"h{i}") for i in range(2)), F.lit(side).alias("side")) for side, t in enumerate((source, target))]
    both = here[0].union(here[1])
    of = lambda side: F.sum(F.when(F.col("side") == side, 1).otherwise(0))
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    apart = (F.sum(sign) != 0) | (F.sum(F.col("h0") * sign) != 0) | (F.sum(F.col("h1") * sign) != 0)
    # keys are summed with their rows, or two rows that changed places wouldn't show
    mixed = F.sum(sign * F.xxhash64("key", "h0", "h1").cast("decimal(20,0)")) != 0
    some = both.groupBy("bucket").agg(mixed.alias("apart")).where("apart").select("bucket")
    each = both.join(F.broadcast(some), "bucket", "left_semi").groupBy("key").agg(of(0).alias("s"), of(1).alias("t"), apart.alias("apart")).where("apart")
    return each.select("key", F.when(F.col("t") == 0, "missing").when(F.col("s") == 0, "extra").otherwise("changed").alias("kind"))
