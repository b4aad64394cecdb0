"""Whitening of embeddings: covariance by generated column aggregates, components by LAPACK.

The sums of centred products of all pairs of dimensions (the upper triangle) are
expressions of one aggregation, so that each task sends one row. Entries are whole
numbers and are centred at the nearest whole mean; what that leaves is put right in
exact arithmetic on the driver, where only these sums arrive.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.llm.common import table

#: Steps to which an entry is rounded down, for each unit.
SCALE = 256
#: A whole number below this is a long without overflow.
LONG = 1 << 63


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def covariance(n: int, centres: list[int], sums: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance (divisor n) from sums of entries and sums of products of entries less centres, exact before it is rounded."""
    d = len(centres)
    left = [s - n * m for s, m in zip(sums, centres, strict=True)]
    out = np.zeros((d, d))
    for (i, j), p in products.items():
        out[i, j] = out[j, i] = float(Fraction(n * p - left[i] * left[j], n * n))
    return out


def _first(df: DataFrame, *arrays: list[str]) -> list[list]:
    """One aggregation of many SQL expressions, as arrays, so that its row has few columns."""
    row = df.selectExpr("count(*) AS n", *(f"array({', '.join(x)}) AS a{k}" for k, x in enumerate(arrays))).collect()[0]
    return [row["n"], *row[1:]]


def fit(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[int], np.ndarray]:
    """n, largest deviations from the centres, sums and covariance of the distinct rows x (array of long, of length dim)."""
    at, pairs = range(dim), [(i, j) for i in range(dim) for j in range(i, dim)]
    columns = vectors.selectExpr(*(f"element_at(x, {i + 1}) AS x{i}" for i in at))
    # decimal sums can't overflow, whatever a long holds
    n, sums, low, high = _first(columns, [f"sum(CAST(x{i} AS decimal(38,0)))" for i in at], [f"min(x{i})" for i in at], [f"max(x{i})" for i in at])
    if not n:
        return 0, [0] * dim, [0] * dim, np.zeros((dim, dim))
    sums = list(map(int, sums))
    centres = [min(max(round(Fraction(s, n)), a), b) for s, a, b in zip(sums, low, high, strict=True)]
    most = [max(b - m, m - a) for m, a, b in zip(centres, low, high, strict=True)]
    # whole numbers in a long where no sum can overflow, else in a decimal; beyond that, doubles
    bound = max(most) ** 2
    kind = "bigint" if bound * n < LONG else "decimal(38,0)" if bound < LONG else "double"
    centred = vectors.selectExpr(*(f"CAST(element_at(x, {i + 1}) AS {'bigint' if bound < LONG else kind}) - {centres[i]}{'L' if bound < LONG else 'D'} AS x{i}" for i in at))
    _, products = _first(centred, [f"sum(CAST(x{i} * x{j} AS {kind}))" if kind != "bigint" else f"sum(x{i} * x{j})" for i, j in pairs])
    return n, most, sums, covariance(n, centres, sums, {p: int(v) for p, v in zip(pairs, products, strict=True)})


def whiten(rows: DataFrame, most: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    An entry c becomes the long x = floor(256 c). The covariance is that of the
    distinct x vectors, n of them with sums S. Components are its unit eigenvectors by
    falling eigenvalue e, at most `most`; one whose eigenvalue rounding can't tell from
    0 has no whitened form and is left out, so that a single distinct vector gives no
    rows. deviation is the sum of (n x - S)^2 over the dimensions, null where no long
    holds it; whitened is x - S/n on the component, over sqrt(e); explained is e over
    the trace; identity_error is how far the covariance of the whitened distinct
    vectors is from the identity at most.

    Vectors that are null, empty, or have a null or non-finite entry are left out, and
    so are those whose length isn't the commonest one (the greatest of equal ones).
    Entries beyond a long are its bounds. Equal rows and rows without vec_id each give
    their rows; extra columns are dropped; an empty table gives none.
    """
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite(F.col("v")))
    schema = f"vec_id {dict(rows.dtypes)[vec_id]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = length["d"]
    every = good.where(F.size("v") == dim).select("vec_id", _whole(F.col("v")).alias("x"))
    listed = table(every.select("x").distinct())
    n, most_far, sums, cov = fit(listed, dim)
    values, vecs = np.linalg.eigh(cov)
    trace, low = float(np.trace(cov)), dim * np.finfo(float).eps * max(float(values[-1]), 0.0)
    parts = [(k + 1, float(values[-1 - k]), vecs[:, -1 - k]) for k in range(min(most, dim)) if values[-1 - k] > low]
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)

    means = [float(Fraction(s, n)) for s in sums]
    entry = lambda i: f"element_at(x, {i + 1})"

    def score(value: float, v: np.ndarray) -> str:
        return f"({' + '.join(f'({entry(i)} - {means[i]!r}D) * {float(v[i])!r}D' for i in range(dim))}) / {math.sqrt(value)!r}D"

    marks = listed.selectExpr(*(f"{score(e, v)} AS w{k}" for k, e, v in parts))
    pairs = [(i, j) for i, _, _ in parts for j, _, _ in parts if i <= j]
    _, found = _first(marks, [f"covar_pop(w{i}, w{j})" for i, j in pairs])
    error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))

    # |n x - S| is at most n (|x - centre| + 1); squares beyond a long are null, and so is their sum
    if sum((n * (m + 1)) ** 2 for m in most_far) < LONG:
        deviation = " + ".join(f"({n}L * {entry(i)} - {sums[i]}L) * ({n}L * {entry(i)} - {sums[i]}L)" for i in range(dim))
    else:
        far = [f"abs(CAST({entry(i)} AS decimal(19,0)) * {n}BD - {sums[i]}BD)" for i in range(dim)]
        square = [f"CASE WHEN {x} < {math.isqrt(LONG)}BD THEN CAST(CAST({x} AS bigint) * CAST({x} AS bigint) AS decimal(38,0)) END" for x in far]
        deviation = f"CASE WHEN {' + '.join(square)} < {LONG}BD THEN CAST({' + '.join(square)} AS bigint) END"
    each = ", ".join(f"named_struct('component', {k}, 'whitened', {score(e, v)}, 'explained', {e / trace!r}D)" for k, e, v in parts)
    out = every.selectExpr("vec_id", f"{deviation} AS deviation", f"explode(array({each})) AS c")
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
