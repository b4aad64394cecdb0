"""Near duplicates among embeddings by an exact metric range join.

Angles between unit vectors are a metric. Pivots, sampled from each large label and
kept apart, cut it into cells: a vector's home is the cell of its nearest pivot, and
the triangle inequality tells which other cells can hold a partner, so that it visits
these alone. Each cell is joined on its own by matrix products, cut into parts of
bounded size where it holds many vectors. Vectors within half the angle of their
pivot are all linked with each other, which a sum tells without a comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.llm.common import components, sent, table

#: Different vectors of a cell's part; a task holds two parts at most.
CELL = 2048
#: Bytes of pivots that the driver and every task hold at most, in doubles; with more vectors, cells are larger and have more parts.
PIVOT_BYTES = 16 << 20
#: What rounding may change in an angle; bounds are wider by it, so that no pair is lost.
SLACK = 1e-6


def _valid(vector: Column) -> Column:
    """Not null, not empty, all entries finite, one of them not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def apart(v: np.ndarray, angle: float, most: int) -> np.ndarray:
    """Of the unit vectors in v, the first ones that are more than the angle from each one taken before."""
    near, taken = np.full(len(v), np.inf), []
    for i in range(len(v)):
        if len(taken) < most and near[i] > angle:
            taken.append(i)
            near = np.minimum(near, angles(v, v[i : i + 1])[:, 0])
    return v[taken]


def homes(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the angle to it."""
    cos = v @ pivots.T
    home = cos.argmax(axis=1)
    return home, np.arccos(np.clip(cos[np.arange(len(v)), home], -1, 1))


def visits(v: np.ndarray, pivots: np.ndarray, radius: np.ndarray, theta: float) -> list[np.ndarray]:
    """The cells after its home in which a vector can have a partner within theta.

    A partner y of x in the cell of q is within radius[q] of q and no farther from q
    than from x's pivot p. By the triangle inequality, x is within theta + radius[q]
    of q, and at most 2 theta farther from q than from p; and x is within theta of the
    plane between p and q.
    """
    cos = v @ pivots.T
    home = cos.argmax(axis=1)
    far = np.arccos(np.clip(cos, -1, 1))
    own, at = far[np.arange(len(v)), home], cos[np.arange(len(v)), home]
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    can = (far <= theta + radius + SLACK) & (far <= own[:, None] + 2 * theta + SLACK) & (at[:, None] - cos <= math.sin(theta) * between + SLACK)
    can &= np.arange(len(pivots)) > home[:, None]
    return [np.flatnonzero(x) for x in can]


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least least. What a product leaves open is decided by the plain formula."""
    x, y = unit(a), unit(b)
    out = np.empty((len(a), len(b)), bool)
    for s in range(0, len(a), 512):
        cos = x[s : s + 512] @ y.T
        out[s : s + 512] = cos >= least
        for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):
            p, q = a[s + i], b[j]
            out[s + i, j] = p @ q / (math.sqrt(p @ p) * math.sqrt(q @ q)) >= least
    return out


def roots(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that links reach, for the rows (left) and the columns (right)."""
    left, right = left.copy(), right.copy()
    if not links.any():
        return left, right
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    m, big = links[np.ix_(rows, cols)], np.iinfo(np.int64).max
    while True:
        a = np.minimum(left[rows], np.where(m, right[cols], big).min(axis=1))
        b = np.minimum(right[cols], np.where(m, a[:, None], big).min(axis=0))
        if (a == left[rows]).all() and (b == right[cols]).all():
            return left, right
        left[rows], right[cols] = a, b


def _join(least: float):
    """A group's rows as (node, links, root): the vectors that each is linked with in the group, and the least node that these links reach."""

    def of(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        v = _matrix(t.column("embedding").combine_chunks(), dim)
        node, n, core, side = (t.column(c).to_numpy() for c in ("node", "n", "core", "side"))
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        alone = t.column("i")[0].as_py() == t.column("j")[0].as_py() and not t.column("visit")[0].as_py()
        if alone:
            b = a
        if not len(a) or not len(b):
            return pa.table({"node": node[:0], "links": n[:0], "root": node[:0]})
        m = linked(v[a], v[b], least) & ~(core[a][:, None] & core[b][None])
        if alone:
            np.fill_diagonal(m, False)
        left, right = roots(m, node[a], node[b])
        if alone:
            return pa.table({"node": node[a], "links": (m @ n[a].astype(float)).astype(np.int64), "root": np.minimum(left, right)})
        links = np.append(m @ n[b].astype(float), n[a].astype(float) @ m).astype(np.int64)
        return pa.table({"node": np.append(node[a], node[b]), "links": links, "root": np.append(left, right)})

    return of


def near_vectors(rows: DataFrame, least: float = 0.93, cell: int = CELL, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null, their vectors have one
    length and a cosine of at least least (0 to 1). n_links counts the other rows that a
    row is linked with, component_id is the least vec_id that links reach, its own
    included, kept tells whether the two are equal. A vector that is null, empty, all
    zero, or has null or non-finite entries is linked with nothing, as is a row without
    label. Rows with one vec_id are different rows: equal ones are linked, and all with
    the least id are kept. A null vec_id is never a component's least one unless all are
    null; such a row is kept then. Extra columns are dropped; an empty table gives none.
    """
    if not 0 <= least <= 1:
        raise ValueError("least must be between 0 and 1")
    spark, theta = rows.sparkSession, math.acos(least)
    known = rows.select("vec_id", "label", "embedding", (F.col("label").isNotNull() & _valid(F.col("embedding"))).alias("_ok"))
    keyed = known.where("_ok").select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(17), "embedding").alias("k2"))
    # equal vectors are one class; nodes are numbered when they are written
    classes = keyed.groupBy("label", "k1", "k2", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = table(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))

    # labels of several parts; the largest of them, of bounded number, get pivots
    sizes = table(classes.groupBy("label", "dim").agg(F.count("*").alias("size")))
    total, dim = sizes.agg(F.sum("size"), F.max("dim")).first()
    target = max(cell, -(-(total or 0) * 8 * (dim or 1) // pivot_bytes))
    large = sizes.where(F.col("size") > target).withColumn("gid", F.xxhash64("label", "dim")).collect()
    number = {(r["label"], r["dim"]): i for i, r in enumerate(large)}
    several = sizes.where(F.col("size") > cell)
    if large:
        ids = spark.createDataFrame([(r["label"], r["dim"], number[r["label"], r["dim"]]) for r in large], sizes.select("label", "dim", F.lit(0).alias("gid")).schema)
        several = several.join(F.broadcast(ids), ["label", "dim"], "left")
    else:
        several = several.withColumn("gid", F.lit(None).cast("int"))
    labelled = classes.join(sent(several), ["label", "dim"], "left")

    wanted = [-(-r["size"] // target) for r in large]
    pivots: list[np.ndarray] = []
    if large:
        share = F.pmod("k2", F.lit(1 << 30)) / float(1 << 30)
        some = labelled.where(F.col("gid").isNotNull() & (share < 2 * F.ceil(F.col("size") / target) / F.col("size"))).select("gid", "embedding").orderBy("gid", "k1").collect()
        for g, r in enumerate(large):
            v = np.array([x["embedding"] for x in some if x["gid"] == g], float).reshape(-1, r["dim"])
            pivots.append(apart(unit(v), theta, wanted[g]) if len(v) else v)
    held = spark.sparkContext.broadcast(pivots)

    def cells_of(batches: Iterator[pa.RecordBatch], radii: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        """Adds home, angle and, where radii are known, visits. Without a pivot a label is one cell."""
        for batch in batches:
            gid = batch.column("gid").fill_null(-1).to_numpy(zero_copy_only=False)
            home, angle, to = np.zeros(len(gid), np.int32), np.full(len(gid), np.inf), [()] * len(gid)
            for g in np.unique(gid[gid >= 0]):
                if not len(p := held.value[g]):
                    continue
                at = np.flatnonzero(gid == g)
                for s in range(0, len(at), 1024):
                    i = at[s : s + 1024]
                    v = unit(_matrix(batch.column("embedding").take(pa.array(i)), p.shape[1]))
                    home[i], angle[i] = homes(v, p)
                    if radii is not None:
                        for k, x in zip(i, visits(v, p, radii[g], theta), strict=True):
                            to[k] = x
            kept = {c: batch.column(c) for c in (("gid", "node", "n") if radii is None else ("gid", "label", "dim", "size", "node", "n", "embedding"))}
            more = {} if radii is None else {"visits": pa.array(to, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(kept | {"home": pa.array(home), "angle": pa.array(angle), "core": pa.array(angle <= theta / 2 - SLACK)} | more)

    kinds = dict(labelled.dtypes)
    found, radii = {}, [np.zeros(len(p)) for p in pivots]
    if large:
        near = labelled.where("gid is not null").select("gid", "node", "n", "embedding").mapInArrow(lambda b: cells_of(b, None), "gid int, node long, n long, home int, angle double, core boolean")
        about = near.groupBy("gid", "home").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.sum(F.when(F.col("core"), F.col("n"))).alias("n"), F.min(F.when(F.col("core"), F.col("node"))).alias("top"))
        # a row for each pivot
        for r in about.collect():
            found[r["gid"], r["home"]] = r
            if len(radii[r["gid"]]):
                radii[r["gid"]][r["home"]] = r["radius"]
    fields = ", ".join(f"{c} {kinds[c]}" for c in ("gid", "label", "dim", "size", "node", "n", "embedding"))
    placed = table(labelled.select("gid", "label", "dim", "size", "node", "n", "embedding").mapInArrow(lambda b: cells_of(b, radii), f"{fields}, home int, angle double, core boolean, visits array<int>"))
    guests = {(r["gid"], r["cell"]): r["n"] for r in placed.select("gid", F.explode("visits").alias("cell")).groupBy("gid", "cell").agg(F.count("*").alias("n")).collect()} if large else {}
    cuts = spark.createDataFrame([(g, c, -(-r["size"] // cell), -(-guests.get((g, c), 0) // cell), r["n"], r["top"]) for (g, c), r in found.items()], "gid int, cell int, parts int, halls int, core_n long, top long")

    # parts of cells, each with each of its own cell and with each part of the cell's visitors
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    same = ["label", "dim", "cell"]
    body = ["node", "n", "embedding"]
    at_home = placed.withColumn("cell", F.col("home")).join(F.broadcast(cuts), ["gid", "cell"], "left")
    at_home = at_home.withColumn("parts", F.coalesce("parts", F.ceil(F.coalesce("size", F.lit(1)) / cell).cast("int"))).withColumn("part", part(F.col("parts")))
    inner = at_home.withColumn("other", upto(F.col("parts"))).select(*same, F.lit(False).alias("visit"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("side"), "core", *body)
    hosts = at_home.where("halls > 0").withColumn("j", upto(F.col("halls"))).select(*same, F.lit(True), F.col("part"), "j", F.lit(False), F.lit(False), *body)
    visitors = placed.select("gid", "label", "dim", *body, F.explode("visits").alias("cell")).join(F.broadcast(cuts), ["gid", "cell"])
    visitors = visitors.withColumn("i", upto(F.col("parts"))).select(*same, F.lit(True), "i", part(F.col("halls")), F.lit(True), F.lit(False), *body)
    per = table(inner.union(hosts).union(visitors).groupBy(*same, "visit", "i", "j").applyInArrow(_join(least), "node long, links long, root long"))

    cores = placed.where("core").select("gid", F.col("home").alias("cell"), "node", "n").join(F.broadcast(cuts), ["gid", "cell"])
    cores = cores.select("node", (F.col("core_n") - F.col("n")).alias("links"), F.col("top").alias("root"))
    every = per.union(cores)
    component = components(every.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = every.groupBy("node").agg(F.sum("links").alias("links"))
    done = classes.drop("embedding").join(counts, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    done = table(done.select("label", "k1", "k2", "dim", "first", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least_id = done.groupBy("component").agg(F.min("first").alias("component_id"))
    done = done.join(least_id, "component").select("label", "k1", "k2", F.col("n_links"), "component_id")
    linked_rows = keyed.drop("embedding").join(done, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = known.where("not _ok").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked_rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
