"""Near vectors, whitening and the prefix trie against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernloom.llm.near_vectors import apart, near_vectors
from fernloom.llm.prefix_trie import EMPTY, louds, prefix_trie
from fernloom.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_links(rows, least=0.93):
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    u = [np.array(v) / np.abs(v).max() if good(v) else None for _, v, _ in rows]
    u = [x if x is None else x / np.linalg.norm(x) for x in u]
    near = [[j for j in range(len(rows)) if j != i and u[i] is not None and u[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least] for i in range(len(rows))]
    comp = list(range(len(rows)))
    while (new := [min([comp[i], *(comp[j] for j in near[i])]) for i in range(len(rows))]) != comp:
        comp = new
    out = []
    for i, (k, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        top = min(ids) if ids else None
        out.append((k, len(near[i]), top, k == top))
    return sorted(out, key=str)


def vectors(rng, n, dim, labels):
    """Tight groups, chains of steps within the angle, and lone ones, in labels of very unequal size."""
    rows = []
    while len(rows) < n:
        kind, label = rng.random(), rng.choice(labels)
        v = rng.normal(size=dim)
        size = 1 if kind < 0.4 else int(rng.integers(2, 40))
        for _ in range(size):
            rows.append((len(rows), v.tolist(), int(label)))
            noise = rng.normal(size=dim)
            v = v + (0.3 if kind > 0.8 else 0.02) * np.linalg.norm(v) * noise / np.linalg.norm(noise)
    return rows


@pytest.mark.parametrize(("dim", "cell", "pivot_bytes", "least"), [(4, 8, 1 << 20, 0.93), (16, 20, 1 << 20, 0.93), (16, 20, 800, 0.93), (3, 16, 1 << 20, 0.0), (8, 2048, 1 << 20, 1.0)])
def test_near_vectors(spark, dim, cell, pivot_bytes, least):
    rng = np.random.default_rng(dim * cell)
    rows = vectors(rng, 400, dim, [1] * 8 + [2] * 3 + [3])
    rows += [(5000 + i, rows[7][1], rows[7][2]) for i in range(60)]  # copies
    rows += [(6000, [0.0] * dim, 1), (6001, None, 1), (6002, [], 1), (6003, [1.0, None] * (dim // 2), 1), (6004, [math.nan] * dim, 1), (6005, [math.inf] + [1.0] * (dim - 1), 1), (6006, rows[0][1], None)]
    rows += [(6007, rows[0][1] + [1.0], rows[0][2]), (6008, [1e200] * dim, 2), (6009, [1e-200] * dim, 2), (6009, [1e-200] * dim, 2), (None, [1.0] * dim, 2), (None, [1.0] * dim, 9)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("n_links", F.lit("x")).withColumn("node", F.lit(1))
    got = sorted((tuple(r) for r in near_vectors(df, least, cell, pivot_bytes).collect()), key=str)
    if least < 1:
        assert got == plain_links(rows, least)
        assert sum(r[1] > 0 for r in got) > 100
    else:
        assert len(got) == len(rows)
        assert dict((r[0], r[1]) for r in got)[5000] >= 60


def test_near_vectors_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], VECTORS)
    assert sorted(map(tuple, near_vectors(df).collect())) == [(1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False)]
    assert near_vectors(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        near_vectors(df, -0.5)
    v = np.eye(3)
    assert len(apart(np.vstack([v, v]), 0.1, 9)) == 3


def plain_whitened(rows, most=4):
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in good]
    dim = max(lengths, key=lambda d: (lengths.count(d), d))
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in good if len(v) == dim]
    listed = sorted({tuple(v) for _, v in x})
    n, s = len(listed), [sum(v[k] for v in listed) for k in range(dim)]
    c = np.array([[float(n * e - t) / n for e, t in zip(v, s, strict=True)] for v in listed])
    cov = c.T @ c / n
    e, w = np.linalg.eigh(cov)
    parts = [k for k in range(dim)[::-1] if e[k] > dim * 2.3e-16 * e[-1]][:most]
    return [(i, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), np.array([(a * n - b) / n for a, b in zip(v, s, strict=True)]) @ w[:, p] / math.sqrt(e[p]), e[p] / np.trace(cov)) for i, v in x for k, p in enumerate(parts)]


@pytest.mark.parametrize(("dim", "size", "scale"), [(6, 80, 1.0), (3, 40, 5.0), (2, 30, 1e5), (2, 20, 1e8), (5, 4, 1.0)])
def test_whiten(spark, dim, size, scale):
    rng = np.random.default_rng(dim + size)
    values = rng.normal(size=(size, dim)) * scale * np.arange(1, dim + 1) - scale
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[1][1]), (901, None), (902, []), (903, [None] * dim), (904, [math.nan] * dim), (905, [-math.inf] * dim), (906, [1.0] * (dim + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("x", F.lit(2))
    got = sorted(whiten(df).collect(), key=lambda r: (str(r["vec_id"]), r["component"], r["whitened"]))
    want = sorted(plain_whitened(rows), key=lambda r: (str(r[0]), r[1]))
    assert [(r["vec_id"], r["component"], r["n"]) for r in got] == [r[:3] for r in want]
    assert [r["deviation"] for r in got] == [r[3] if r[3] < 1 << 63 else None for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[j] for r in rows if r[1] == k]) for rows, j in (([tuple(r) for r in got], 4), (want, 4)))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert all(abs(r["explained"] - w[5]) < 1e-9 for r, w in zip(got, want, strict=True))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6


def test_whiten_edges(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert whiten(df).collect() == [] == whiten(df.limit(0)).collect()
    line = spark.createDataFrame([(i, [float(i), -0.0, float(-i)]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(i, [float(i) * 1e300, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert len(whiten(huge).collect()) == 3


TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    for c in conv:
        conv[c].sort(key=lambda y: y[:2])
    built = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(y[1:] for y in conv.get(c - int(math.fmod(c, 20)), [])[:h] + conv[c][h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(built):
        s = built[c]
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
        ends[s].append(c)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        own = (len(members[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = own + sum(saved[k] for k in kids[s])
        ids = ",".join(map(str, ends[s]))
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"light": 4, "piece": 9}, {"light": 1, "heavy": 6, "piece": 50}])
def test_prefix_trie(spark, sizes):
    rng = random.Random(5)
    first = [f"hello  {i} there" for i in range(3)] + ["", None]
    rows = []
    for c in [*range(90), -41, -7, 1005]:
        if c in (40, 60):
            continue  # conversations without the first of their twenty
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t > 3 else "user", rng.choice(first) if t < 4 else f"{rng.randint(0, 1)}\t x"))
    rows += [(200, t, "user", "hello  0 there") for t in range(150)] + [(201, t, "user", "hello  0 there") for t in range(150)] + [(202, t, "user", "hello  0 there") for t in range(90)]  # long, and a prefix of them
    for c in range(300, 340):  # copies
        rows += [(c, 0, "user", "hello  0 there"), (c, 1, "bot", "same"), (c, 2, None, "same again"), (c, 3, "user", "the end")]
    rows += [(None, 0, "user", "x"), (400, None, "user", "first"), (400, -5, "user", "second"), (400, 3, "a", "tie"), (400, 3, "b", "tie"), (401, 1, "u", "twice"), (401, 1, "u", "twice"), (402, 1, "u", "w " * 200000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("k1", F.lit(1))
    got = sorted((tuple(r) for r in prefix_trie(df, **sizes).collect()), key=str)
    assert got == plain_trie(rows)


def test_prefix_trie_edges(spark):
    df = spark.createDataFrame([(4, 0, "user", "a b")], TURNS)
    assert prefix_trie(df.limit(0)).collect() == []
    h = zlib.crc32(b"4") % 4
    want = [(4, 0, None, 1, 1, 1, 0, EMPTY), (4, 1, 4, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())] if h == 0 else [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]
    assert sorted(map(tuple, prefix_trie(df).collect()), key=str) == sorted(want, key=str)


def test_louds():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 40)
        parent = np.array([0] + [rng.randrange(i) for i in range(1, n)])
        labels = np.array([rng.randint(0, 99) for _ in range(n)])
        t = louds(parent, labels)
        assert sorted(t.order) == list(range(n)) and (t.labels == labels[t.order]).all()
        assert [t.order[p] for p in t.parents()] == [parent[i] for i in t.order[1:]]
        assert list(t.degrees()) == [int((parent[1:] == i).sum()) for i in t.order]
        values = np.array([rng.randint(0, 9) for _ in range(n)])
        total = values.copy()
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
        assert list(t.rollup(values[t.order])) == list(total[t.order])
