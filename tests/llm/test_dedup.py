"""Line dedup, substring dedup and the n-gram join against brute force."""

import random
import re

from pyspark.sql import functions as F

from fernloom.llm import line_dedup as lines_of
from fernloom.llm.line_dedup import line_dedup
from fernloom.llm.ngram_join import ngram_components
from fernloom.llm.substring_dedup import substring_dedup

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "é ü\x85x"), (906, "word " * 30000)]


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "of", "AND"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(40, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [[rng.choice(vocab) for _ in range(rng.randint(0, 60))] for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(1, rng.choice(passages))
        text = "\n".join(" ".join(p) for p in parts)
        if rows and rng.random() < 0.4:
            words = re.split(r"( |\n)", rng.choice(rows)[1])
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = "".join(words)
        rows.append((i * 3 % 211, text))
    return rows + ODD


def brute_lines(rows):
    """The lines that go, by document, and those documents' rest."""
    lines = [(d, j, frozenset(lower(w) for w in spaced(line))) for d, t in rows for j, line in enumerate((t or "").split("\n"))]
    gone = {d: set() for d, _ in rows}
    for d, j, s in lines:
        if s and any((e, k) < (d, j) and 100 * len(s & u) >= 75 * len(s | u) for e, k, u in lines):
            gone[d].add(j)
    return {d: (None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]), len(gone[d])) for d, t in rows}


def test_line_dedup(docs):
    for seed in (1, 6):
        rows = [*corpus(seed), (910, "Home\nOne  two three\n\nhome"), (911, "one two\nONE two three\n one two three four\na b c d e"), (912, "one\ttwo\none two three four\na b c d\nb c d e")]
        want = brute_lines(rows)
        assert sum(n for _, n in want.values()) > 20 and want[910][1] == 1
        got = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in line_dedup(docs(rows)).collect()}
        assert got == want


def test_line_dedup_family(docs):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(40)] = f"x{rng.randrange(30)}"
        rows.append((d, " ".join(w)))
    assert {r["doc_id"]: (r["kept"], r["n_removed"]) for r in line_dedup(docs(rows)).collect()} == brute_lines(rows)


def test_line_dedup_few_frequent_words(docs):
    rows = corpus(2, 40)
    assert {tuple(r) for r in line_dedup(docs(rows), frequent=3).collect()} == {tuple(r) for r in line_dedup(docs(rows)).collect()}


def test_long_unlike_lines_are_told_apart_before_they_are_compared(docs):
    """Parities of large sets drop unlike pairs that 90 bits let pass, and no pair that is alike."""
    rng = random.Random(4)
    sets = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in range(60, 300, 3)]
    near = [[*w[: len(w) * 7 // 8], "other"] for w in sets]
    rows = list(enumerate(" ".join(w) for w in sets + near))
    made = lines_of._lines(docs(rows), 75, lines_of.frequent_tokens(docs(rows))).select("doc_id", "parity", "size", "thirds.p", "thirds.q", "n").cache()
    both = made.alias("x").join(made.alias("y"), F.col("x.doc_id") < F.col("y.doc_id"))
    found = {k: {(r["a"], r["b"]) for r in both.where(lines_of._alike(75, thirds=k)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).collect()} for k in (False, True)}
    words = [set(w) for w in sets + near]
    alike = {(a, b) for b in range(len(words)) for a in range(b) if 100 * len(words[a] & words[b]) >= 75 * len(words[a] | words[b])}
    assert len(alike) == len(sets) and alike <= found[True] <= found[False]
    assert len(found[True] - alike) * 10 < len(found[False] - alike)


def test_postings_are_shuffled_once_and_lose_no_similar_pair(docs):
    """Lines that share prefix tokens are found by one shuffle without a join; of two lines that went none is asked for."""
    rng = random.Random(8)
    sets = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in [*range(1, 40), *range(40, 400, 9)]]
    rows = list(enumerate(" ".join(w) for w in [*sets, *([*w[: len(w) * 7 // 8 + 1], "other"] for w in sets)]))
    made = lines_of._lines(docs(rows), 75, lines_of.frequent_tokens(docs(rows)))
    found = lines_of._sharing(made.withColumn("went", F.lit(None).cast("boolean")), 75, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    words = [set(t.split(" ")) for _, t in rows]
    alike = {(a, b) for b in range(len(words)) for a in range(b) if words[a] != words[b] and 100 * len(words[a] & words[b]) >= 75 * len(words[a] | words[b])}
    got = {(r["a"], r["b"]) for r in found.collect()}
    assert len(alike) > 60 and alike <= got and len(got - alike) < len(alike)
    assert not lines_of._sharing(made.withColumn("went", F.lit(True)), 75, 3).count()


def test_substring_dedup(docs):
    rows = corpus(3)
    texts = {d: spaced(t) for d, t in rows}
    least = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            least[g] = min(d, least.get(g, d))
    got = {r["doc_id"]: r for r in substring_dedup(docs(rows)).collect()}
    removed = 0
    for d, w in texts.items():
        bad = {p for i in range(len(w) - 49) if least[tuple(w[i : i + 50])] < d for p in range(i, i + 50)}
        removed += len(bad)
        assert got[d]["kept"] == " ".join(x for p, x in enumerate(w) if p not in bad)
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), len(bad))
    assert removed


def brute_components(rows, k=5):
    sets = {}
    for d, t in rows:
        w = [lower(x) for x in spaced(t)]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in sets}


def test_ngram_components(docs):
    for seed in (4, 5):
        rows = corpus(seed, 80)
        want = brute_components(rows)
        assert any(d != c for d, _, c in want)
        assert {tuple(r) for r in ngram_components(docs(rows)).collect()} == want


def test_empty_and_clashing(docs, spark):
    none = docs([], ", kept string, n int")
    assert line_dedup(none).count() == substring_dedup(none).count() == ngram_components(none).count() == 0
    rows = docs([(1, "a b c d e f", "x", 3), (2, "a b c d e f", None, None), (None, "a b c d e f", "y", 1), (2, "a b c d e f", None, None)], ", kept string, n int")
    got = sorted(((r["doc_id"] or 0, r["kept"], r["n"]) for r in line_dedup(rows).collect()), key=str)
    assert got == [(0, "a b c d e f", 1), (1, "a b c d e f", 3), (2, "", None), (2, "", None)]
    assert substring_dedup(rows).count() == 4
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_components(rows).collect()) == [(0, 1), (1, 1), (2, 1), (2, 1)]
