"""Ordering, pages and the newest of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a page's number and size.
PAGES, SIZES = (1, 10_000), (1, 100)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with total, pages and has_next on each row. order must be unique, else pages overlap."""
    number, size = min(max(number, PAGES[0]), PAGES[1]), min(max(size, SIZES[0]), SIZES[1])
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size)).withColumn("has_next", F.lit(number * size) < F.col("total"))


def newest(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in the order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def decayed(df: DataFrame, score: str, order: list[Column], top: int = 30, step: float = 0.02) -> DataFrame:
    """The top rows by order with score * (1 - step * place), place from 0."""
    best = df.orderBy(*order).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).withColumn(score, F.col(score) * (1 - step * F.col("place")))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The upsert of new into old: of each key the row of greatest version, new before old."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(rows, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def placed(df: DataFrame, parts: list[str | Column], order: list[str]) -> DataFrame:
    """df with place, counted from 1 in the order of parts and then of order.

    parts cut the order into ranges of rows: only the counts of ranges are numbered in
    one task, each range is sorted in a task of its own.
    """
    named = df.select("*", F.struct(*(F.expr(p) if isinstance(p, str) else p for p in parts)).alias("_range"))
    counts = named.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return named.withColumn("_own", own).join(before, "_range").select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias("place"))
