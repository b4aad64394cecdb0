"""Prefix trie of conversations as succinct level-order tries, one for each prefix shard.

A node is told by a 128-bit key over its turns, the exclusive or of a hash of each
turn and its place, so that keys of one conversation can be made in pieces. Nodes,
their members and their turns are aggregates over keys. Runs of nodes with the same
members are one chain; a trie of chains has at most two for each different
conversation, however long these are. Chains with few members form shards by their
topmost prefix; in each shard a LOUDS bitvector and a label array are built, and
sums go from the leaves to the top. The few chains with many members are a trie of
their own, on top of what the shards have found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernloom.llm.common import sent, table

#: Members above which a chain belongs to the upper trie; more if that has more than HEAVY chains otherwise.
LIGHT = 1 << 15
HEAVY = 1 << 16
#: Turns of a sorted piece, chains of a bin of shards, about.
PIECE = 1 << 18
#: Turns that a conversation may take over from the first of its twenty.
SHARED = 3
EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = 0


class Louds(NamedTuple):
    """A level-order unary degree sequence: for each node a 1 for each child and a 0, level by level, after 10 for the top.

    labels has each node's label, order the place that it had in the input, levels
    where the levels begin (one more at the end); node 0 is the top.
    """

    bits: np.ndarray
    labels: np.ndarray
    order: np.ndarray
    levels: np.ndarray

    def ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits)[: 2 * len(self.order) + 1])

    def parents(self) -> np.ndarray:
        """Of each node but the top: the zeros before its 1, less that of the top's 10."""
        at = self.ones()
        return (at - np.arange(len(at)))[1:] - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits)[: 2 * len(self.order) + 1] == 0)
        return np.diff(zeros) - 1

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree, from the last level up; values and sums are in level order."""
        total, parent = values.astype(np.int64), np.append(0, self.parents())
        for k in range(len(self.levels) - 2, 0, -1):
            a, b = self.levels[k], self.levels[k + 1]
            np.add.at(total, parent[a:b], total[a:b])
        return total


def louds(parent: np.ndarray, labels: np.ndarray) -> Louds:
    """The trie of nodes 0 (the top) to n - 1 with their parents (the top's is ignored); siblings are ordered by label."""
    n = len(parent)
    kids = 1 + np.lexsort((labels[1:], parent[1:]))
    count = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n, np.int64)
    begin = np.append(0, np.cumsum(count))
    order, levels = [np.zeros(1, np.int64)], [0, 1]
    while len(last := order[-1]) and (wide := int(count[last].sum())):
        c = count[last]
        within = np.arange(wide) - np.repeat(np.cumsum(c) - c, c)
        order.append(kids[np.repeat(begin[last], c) + within])
        levels.append(levels[-1] + wide)
    order = np.concatenate(order)
    bits = np.zeros(2 * n + 1, np.uint8)
    degree = np.append(1, count[order])
    ends = np.cumsum(degree + 1) - 1
    bits[:] = 1
    bits[ends] = 0
    return Louds(np.packbits(bits), labels[order], order, np.array(levels))


def _sums(chains: pa.Table) -> pa.Table:
    """Leaves and saved tokens in the subtrees of the chains of some shards, and their children.

    base_leaves and base_saved are what lies below a chain in other tries. A chain whose parent isn't here hangs on the top.
    """
    conv, n, up, up_n = (chains.column(c).to_numpy() for c in ("conv_id", "n_convs", "up", "up_n"))
    rows = len(conv)
    _, at = np.unique(np.stack([np.append(conv, up), np.append(n, up_n)], 1), axis=0, return_inverse=True)
    at = at.reshape(-1)
    place = np.zeros(at.max() + 1, np.int64)
    place[at[:rows]] = np.arange(1, rows + 1)
    parent = place[at[rows:]]
    # the root's chain is its own parent
    parent[parent == np.arange(1, rows + 1)] = 0
    trie = louds(np.append(0, parent), np.append(0, chains.column("label").to_numpy()))
    more = lambda c: np.append(0, chains.column(c).to_numpy())[trie.order]
    kids = trie.degrees() + more("base_children")
    leaves = trie.rollup(more("base_leaves") + (kids == 0))
    saved = trie.rollup(more("base_saved") + more("own"))
    back = np.empty(rows + 1, np.int64)
    back[trie.order] = np.arange(rows + 1)
    back = back[1:]
    return pa.table({"conv_id": conv, "n_convs": n, "n_children": kids[back], "n_leaves": leaves[back], "saved": saved[back]})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, ends_sha256) of pieces of id lists in order of key and place; only a hash state is kept between pieces."""
    key, state = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _triples(out)
    if key is not None:
        yield _triples([(*key, state.hexdigest())])


def _triples(rows: list) -> pa.RecordBatch:
    k1, k2, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "ends_sha256": pa.array(sha, pa.string())})


def _pieces(df: DataFrame, rows: int, by: list, size: int) -> DataFrame:
    """df as a table sorted by the columns, with at: the piece in the upper bits, the place in the piece in the lower 33. No key is kept together."""
    return table(df.repartitionByRange(max(1, -(-rows // size)), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))


def prefix_trie(conversations: DataFrame, light: int = LIGHT, heavy: int = HEAVY, piece: int = PIECE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of rebuilt conversations.

    conversations has (conv_id, turn, role, text), a null role or text being empty.
    Turns are in order of turn, null first, equal ones in order of role and of a hash
    of role and text; equal rows are each a turn. Of conversation c, the first h turns
    (h = crc32(c) % 4) are replaced by those of conversation c - c % 20 (of the sign of
    c), all that it has if these are fewer. A node is a distinct sequence of the first
    depth turns, told by 128 bits, from the root of depth 0. conv_id is its least
    member, parent_conv_id the parent's (null for the root), n_convs its members,
    n_leaves the nodes without children below or at it, saved_tokens the sum of
    (n_convs - 1) times the words of the last turn over the same nodes, ends_sha256 the
    hash of the ids that end here, ascending and comma-joined. Rows without conv_id
    belong to no conversation and are left out; extra columns are dropped; an empty
    table has no conversation and gives no node.

    A chain with more than light members is in the upper trie, which holds at most
    heavy chains but that of the root: with more, light is raised.
    """
    both = lambda *c: (F.xxhash64(F.lit(3), *c), F.xxhash64(F.lit(11), *c))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t1, t2 = both(F.length("role"), "role", "text")
    turns = table(turns.select("conv_id", "turn", "role", t1.alias("t1"), t2.alias("t2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")))
    total = turns.count()
    order = ["turn", "role", "t1", "t2"]

    # the first turns of each twentieth conversation go to those that take them over
    of = Window.partitionBy("conv_id").orderBy(*order)
    heads = turns.where("conv_id % 20 = 0").withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= SHARED)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    people = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h"))
    given = people.join(heads.withColumnRenamed("conv_id", "base"), "base").where(F.col("rank") <= F.col("h"))
    given = given.select("conv_id", F.lit(0).alias("own"), F.col("rank").cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), "t1", "t2", "words")
    rows = turns.select("conv_id", F.lit(1).alias("own"), *order, "words").union(given)
    sorted_rows = _pieces(rows, total * 2, ["conv_id", "own", *order], piece).drop("turn", "role").withColumn("p", F.shiftright("at", 33))

    # where a conversation goes on in the next piece, its rows before are counted there
    by = ["conv_id", "p"]
    runs = sorted_rows.groupBy(*by).agg(F.min("at").alias("first"), F.count("*").alias("rows"), F.count_if(F.col("own") == 0).alias("given"))
    of = Window.partitionBy("conv_id")
    before = of.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*by, "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("given").over(of).alias("given"), F.count("*").over(of).alias("pieces"))
    at = F.col("before") + F.col("at") - F.col("first") + 1
    placed = sorted_rows.join(runs, by).withColumn("rank", at).where((F.col("own") == 0) | (F.col("rank") - F.col("given") > h))
    placed = placed.withColumn("depth", F.when(F.col("own") == 0, F.col("rank")).otherwise(F.col("rank") - h))
    g1, g2 = (F.xxhash64(F.lit(s), "t1", "t2", "depth") for s in (5, 13))
    so_far = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    keyed = placed.select(*by, "at", "depth", "words", "pieces", g1.alias("g1"), g2.alias("g2"))
    keyed = keyed.select(*by, "depth", "words", "pieces", "g1", "g2", F.bit_xor("g1").over(so_far).alias("k1"), F.bit_xor("g2").over(so_far).alias("k2"), F.sum("words").over(so_far).alias("upto"))
    keyed = table(keyed)
    whole = keyed.where("pieces > 1").groupBy(*by).agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"), F.sum("words").alias("x"))
    carried = whole.select(*by, *(F.coalesce(f(c).over(before), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "x1"), (F.bit_xor, "x2"), (F.sum, "x"))))
    keyed = keyed.join(sent(table(carried)), by, "left")
    plus = lambda k, x: F.col(k).bitwiseXOR(F.coalesce(x, F.lit(0))).alias(k)
    keyed = table(keyed.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", "g1", "g2", plus("k1", "x1"), plus("k2", "x2"), (F.col("upto") + F.coalesce("x", F.lit(0))).alias("upto")))
    up = [F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")) for i in (1, 2)]

    # nodes, with the root; ids that end at a node
    everyone = turns.agg(F.min("conv_id").alias("conv_id"), F.count_distinct("conv_id").alias("n_convs")).first()
    people_all = everyone["n_convs"]
    nodes = keyed.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("upto").alias("upto"), F.max(up[0]).alias("p1"), F.max(up[1]).alias("p2"), F.max("g1").alias("label"))
    zero = F.lit(_ROOT).cast("long")
    root = conversations.sparkSession.range(1 if people_all else 0).select(*(zero.alias(c) for c in ("depth", "k1", "k2")), F.lit(everyone["conv_id"]).cast("long").alias("conv_id"), F.lit(people_all).cast("long").alias("n_convs"), *(zero.alias(c) for c in ("words", "upto", "p1", "p2", "label")))
    nodes = table(nodes.union(root))

    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k"))
    ends = people.select("conv_id").join(last, "conv_id", "left").select("conv_id", F.coalesce("k.k1", zero).alias("k1"), F.coalesce("k.k2", zero).alias("k2"))
    joined = _pieces(ends, people_all, ["k1", "k2", "conv_id"], piece).withColumn("p", F.shiftright("at", 33))
    # parts of a piece are lists of bounded length; they're hashed in order, one after another
    part = F.shiftright("at", 14)
    joined = joined.groupBy("k1", "k2", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    hashed = joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")

    # chains: nodes with the same members, which are those with the same least one and number
    name = ["conv_id", "n_convs"]
    ordered = lambda c: F.min_by(c, "depth")
    chains = nodes.groupBy(*name).agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), ordered(F.struct("k1", "k2")).alias("t"), ordered(F.struct("p1", "p2")).alias("p"), F.max_by(F.struct("k1", "k2"), "depth").alias("b"), F.max("upto").alias("upto"), F.min(F.col("upto") - F.col("words")).alias("since"), ordered("label").alias("label"))
    chains = table(chains)
    bottoms = chains.select(F.col("b").alias("p"), (F.col("bottom") + 1).alias("top"), F.col("conv_id").alias("up"), F.col("n_convs").alias("up_n"))
    # the root's chain hangs on itself
    linked = chains.join(bottoms, ["p", "top"], "left").withColumn("up", F.coalesce("up", "conv_id")).withColumn("up_n", F.coalesce("up_n", "n_convs"))
    linked = table(linked.withColumn("own", (F.col("n_convs") - 1) * (F.col("upto") - F.col("since"))).join(hashed.select(F.struct("k1", "k2").alias("b"), "ends_sha256"), "b", "left"))

    # a chain of more than most members accounts for as many rows of its own, so that there are few
    most = max(light, -(-2 * total // heavy))
    is_heavy = (F.col("n_convs") > most) | (F.col("top") == 0)
    tops = table(linked.where(is_heavy).select("t", "b"))
    at_top, at_bottom = F.broadcast(tops.select(F.col("t.k1").alias("k1"), F.col("t.k2").alias("k2"))), F.broadcast(tops.select(F.col("b.k1").alias("p1"), F.col("b.k2").alias("p2")))
    # of each conversation, the first node that isn't heavy
    shard = keyed.select("conv_id", "k1", "k2", up[0].alias("p1"), up[1].alias("p2")).join(at_bottom, ["p1", "p2"], "left_semi").join(at_top, ["k1", "k2"], "left_anti").select("conv_id", F.xxhash64("k1", "k2").alias("shard"))
    none = [zero.alias(c) for c in ("base_children", "base_leaves", "base_saved")]
    small = linked.where(~is_heavy).join(shard, "conv_id").select(*name, "up", "up_n", "own", "label", F.pmod("shard", F.lit(max(1, -(-2 * people_all // piece)))).alias("bin"), *none)
    schema = "conv_id long, n_convs long, n_children long, n_leaves long, saved long"
    lower = table(small.groupBy("bin").applyInArrow(_sums, schema))
    # what hangs on the upper trie's chains
    below = linked.where(~is_heavy).join(F.broadcast(linked.where(is_heavy).select(F.col("conv_id").alias("up"), F.col("n_convs").alias("up_n"))), ["up", "up_n"], "left_semi").join(lower, name)
    below = below.groupBy(F.col("up").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("base_children"), F.sum("n_leaves").alias("base_leaves"), F.sum("saved").alias("base_saved"))
    large = linked.where(is_heavy).join(below, name, "left").na.fill(0, ["base_children", "base_leaves", "base_saved"])
    upper = large.select(*name, "up", "up_n", "own", "label", zero.alias("bin"), "base_children", "base_leaves", "base_saved").groupBy("bin").applyInArrow(_sums, schema)
    sums = linked.join(lower.union(upper), name).select(*name, "top", "bottom", F.col("upto").alias("end"), "own", "up", "n_children", "n_leaves", "saved", "ends_sha256")

    done = nodes.join(sums, name)
    is_end = F.col("depth") == F.col("bottom")
    return done.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(is_end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") - F.col("own") + (F.col("n_convs") - 1) * (F.col("end") - F.col("upto") + F.col("words"))).alias("saved_tokens"),
        F.when(is_end, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_STEP = "list_reduce(list_prepend(xor({c}, {b}), list_transform(range(8), lambda i: i)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: " + _STEP.format(c="c", b="b") + "), 4294967295)"
OP13_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS r, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
g AS (SELECT c.conv_id, 0 AS own, r, m, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.r <= c.h UNION ALL SELECT conv_id, 1, r, m, words FROM c JOIN t USING (conv_id) WHERE r > h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, r) AS depth FROM g),
k AS (SELECT conv_id, depth, words, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT k, min(conv_id) AS conv_id, max(depth) AS depth, max(words) AS words, count(*) AS n_convs FROM k GROUP BY k),
e AS (SELECT k, sha256(string_agg(conv_id, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(k, depth) AS k FROM k GROUP BY conv_id) GROUP BY k),
p AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND starts_with(x.k, n.k)) AS n_children FROM n LEFT JOIN n u ON n.depth > 0 AND u.k = left(n.k, -32) AND u.depth = n.depth - 1)
SELECT p.conv_id, p.depth, any_value(p.parent_conv_id) AS parent_conv_id, any_value(p.n_convs) AS n_convs, any_value(p.n_children) AS n_children, count(*) FILTER (x.n_children = 0) AS n_leaves,
  CAST(sum((x.n_convs - 1) * x.words) AS BIGINT) AS saved_tokens, any_value(coalesce(ends, sha256(''))) AS ends_sha256 FROM p JOIN p x ON starts_with(x.k, p.k) LEFT JOIN e ON e.k = p.k GROUP BY p.conv_id, p.depth, p.k
"""
