"""Trees of (id, parent) rows: closures by joins, a level each round, with a guard against cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernloom.sources.files import cut

def descendants(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, level, path) for every node and each node below it, itself at level 0, to a depth if one is given.

    nodes: id, parent, name. A node that a path has already is not entered again. Each
    level is a table in the shared folder, joined with the nodes for the next, until
    one is empty.
    """
    kids = nodes.select(F.col("id").alias("_kid"), F.col("parent").alias("_of"), F.col("name").alias("_name"))
    level = nodes.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"), F.col("name").alias("path"), F.array("id").alias("_seen"))
    out = [level]
    while depth is None or len(out) <= depth:
        level = level.join(kids, F.col("_of") == F.col("id")).where(~F.array_contains("_seen", F.col("_kid")))
        level = cut(level.select("root", F.col("_kid").alias("id"), (F.col("level") + 1).alias("level"), F.concat("path", F.lit(" > "), "_name").alias("path"), F.array_append("_seen", F.col("_kid")).alias("_seen")))
        if not level.limit(1).count():
            break
        out.append(level)
    return reduce(DataFrame.unionByName, out).drop("_seen")


def ancestors(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, ancestor, distance), each node its own at 0."""
    return descendants(nodes, depth).select("id", F.col("root").alias("ancestor"), F.col("level").alias("distance"))


def subtree_counts(nodes: DataFrame, facts: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, direct, total) of facts (id) at a node and in its whole subtree, zeros kept."""
    own = facts.groupBy("id").agg(F.count("*").alias("n"))
    direct = nodes.select("id").join(own, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("direct"))
    total = descendants(nodes, depth).join(own, "id", "left").groupBy("root").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return direct.join(total.withColumnRenamed("root", "id"), "id")


def nested(nodes: DataFrame) -> DataFrame:
    """Roots with their children as an array of structs, two levels deep, by name."""
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(F.struct("name", F.col("id").alias("child")))).alias("children"))
    return nodes.where("parent is null").join(kids, "id", "left").select("id", "name", F.coalesce("children", F.array().cast(kids.schema["children"].dataType)).alias("children"))


def reparent(nodes: DataFrame, gone: list) -> DataFrame:
    """nodes without those of the ids in gone; their children hang at the parent above."""
    cut = nodes.where(F.col("id").isin(gone)).select(F.col("id").alias("_gone"), F.col("parent").alias("_up"))
    return nodes.where(~F.col("id").isin(gone)).join(F.broadcast(cut), F.col("parent") == F.col("_gone"), "left").select("id", F.when(F.col("_gone").isNotNull(), F.col("_up")).otherwise(F.col("parent")).alias("parent"), "name")
