"""Graphs of (a, b, weight) edges: degrees, shortest paths, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernloom.sources.files import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def node_statistics(edges: DataFrame) -> DataFrame:
    """(node, degree, mean_weight, best): best is the neighbour of the greatest weight."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.max_by("b", F.struct("weight", -F.col("b"))).alias("best"))


def distances(edges: DataFrame, source, depth: int = 5) -> DataFrame:
    """(node, distance) of what is within depth steps of the source, by one join a step."""
    links = cut(both_ways(edges).select("a", "b").distinct())
    seen = edges.sparkSession.range(1).select(F.lit(source).cast(edges.schema["a"].dataType).alias("node"), F.lit(0).alias("distance"))
    for step in range(1, min(max(depth, 1), 10) + 1):
        new = seen.where(F.col("distance") == step - 1).join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(step).alias("distance"))
        seen = cut(seen.union(new).groupBy("node").agg(F.min("distance").alias("distance")))
    return seen


def paths(edges: DataFrame, source, depth: int = 5, target=None) -> DataFrame:
    """(node, distance, path) of what is within depth steps (1 to 10) of the source; path is an array from the source to the node.

    Of several shortest paths a node's is that of its least neighbour before it. With a
    target, the search ends where that is reached, and its row alone is returned; none
    if it isn't within reach. A source without edges reaches nothing.
    """
    links = cut(both_ways(edges).select("a", "b").where("a <> b").distinct())
    start = F.col("a").alias("node")
    seen = cut(links.where(F.col("a") == F.lit(source)).select(start, F.lit(0).alias("distance"), F.array("a").alias("path")).limit(1))
    last = seen
    for step in range(1, min(max(depth, 1), 10) + 1):
        if target is not None and last.where(F.col("node") == F.lit(target)).count():
            break
        reached = last.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "a", "path")
        # a path is carried by one of a node's neighbours before it
        new = reached.groupBy("node").agg(F.min_by("path", "a").alias("path")).join(seen.select("node"), "node", "left_anti")
        last = cut(new.select("node", F.lit(step).alias("distance"), F.array_append("path", F.col("node")).alias("path")))
        if not last.limit(1).count():
            break
        seen = seen.union(last)
    return seen if target is None else seen.where(F.col("node") == F.lit(target))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by synchronous label propagation: the label of most weight among a node's neighbours and itself, the least of equal ones."""
    links = cut(both_ways(edges))
    # a node votes for its own label like its heaviest neighbour, so that two nodes don't swap labels for ever
    own = links.groupBy(F.col("a").alias("node")).agg(F.max("weight").alias("weight"))
    label = own.select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = links.join(label.select(F.col("node").alias("b"), "community"), "b").select(F.col("a").alias("node"), "community", "weight")
        votes = votes.unionByName(label.join(own, "node")).groupBy("node", "community").agg(F.sum("weight").alias("w"))
        label = votes.groupBy("node").agg(F.max_by("community", F.struct(F.round("w", 9), -F.col("community"))).alias("community"))
        label = cut(label)
    return label


def shared_members(members: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, weight) of groups that share members, from members (member, group) by a join on the member."""
    x, y = members.toDF("member", "a"), members.toDF("member", "b")
    return x.join(y, "member").where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight")).where(F.col("weight") >= least)


def top_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    by = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    return both_ways(edges).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def export_lines(edges: DataFrame) -> DataFrame:
    """(section, line): quoted nodes with their degrees, and quoted edges with weights of four decimals."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    nodes = both_ways(edges).groupBy("a").agg(F.count("*").alias("n"))
    nodes = nodes.select(F.lit("nodes").alias("section"), F.concat_ws(",", quoted(F.col("a")), F.col("n").cast("string")).alias("line"))
    return nodes.union(edges.select(F.lit("edges"), F.concat_ws(",", quoted(F.col("a")), quoted(F.col("b")), F.format_string("%.4f", "weight"))))
