"""Values and groups that only larger tables have."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernloom.functions import documents as D
from fernloom.functions import korean as K
from fernloom.functions import text as T
from fernloom.operators import clusters, fulltext, ingest, mining, vectors
from fernloom.plans import relational


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [("sum", "8320373, 2.5, x, 1679646", "10000021.5"), ("avg", "8320397, 2.5, x, 1679782", "3333393.833333"), ("avg", "10000000, 20000000.5", "15000000.25"), ("sum", "0.0001", "0.0001"), ("sum", "1e17, 1", "100000000000000000"), ("sum", "1e19", "10000000000000000000"), ("min", "-12345678.5", "-12345678.5"), ("sum", "0", "0"), ("max", "100, 20", "100")],
)
def test_numbers_are_shown_without_exponent(spark, name, args, want):
    assert spark.range(1).select(D.called(name, F.lit(args)).alias("x")).first()["x"] == want


def test_similar_texts_passes_on_the_best_alone(spark, monkeypatch):
    """Blocks of few terms, ties, copies and a text without terms give what all pairs give, and no pair is shuffled but the best of a block."""
    monkeypatch.setattr(mining, "BLOCK_TERMS", 120)
    texts = [(i, " ".join(f"w{chr(97 + i * j % 7)}{chr(97 + (i + j) % 5)}" for j in range(i % 9))) for i in range(60)] + [(60, None), (61, "common wab"), (62, "common wab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    w = mining.tfidf(docs)
    got = mining.similar_texts(w, docs.where("doc_id % 3 = 1"), 3)
    of = {}
    for r in w.collect():
        of.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    want = []
    for q in (x for x in of if x % 3 == 1):
        sims = [(-round(sum(of[q][t] * v for t, v in of[i].items() if t in of[q]), 6), i) for i in of if i != q and of[i].keys() & of[q].keys()]
        want += [(q, i, -s) for s, i in sorted(sims)[:3]]
    assert {(q, i): s for q, i, s in map(tuple, got.collect())} == pytest.approx({(q, i): s for q, i, s in want}) and len(want) > 40
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_hangul_in_steps(spark, monkeypatch):
    """Python objects are made for a step's texts alone, whatever an Arrow batch has."""
    texts = pa.array(["가나 다", None, "", "라" * 50, "마 바", None])
    monkeypatch.setattr(K, "STEP_BYTES", 20)
    seen = []
    batches = iter([texts, texts.slice(0, 0), texts.slice(4)])
    out = K._in_steps(batches, lambda rows: seen.append(rows) or pa.array(rows, pa.string()))
    assert pa.concat_arrays(list(out)).to_pylist() == texts.to_pylist() + ["마 바", None]
    assert seen == [["가나 다", None, ""], ["라" * 50], ["마 바", None], ["마 바", None]]
    of = spark.createDataFrame([(t,) for t in texts.to_pylist()], "t string").repartition(1)
    got = of.select("t", K.tokens(F.col("t")).alias("w"), K.letters(F.col("t")).alias("l")).collect()
    assert {r["t"]: r["w"] and [w["text"] for w in r["w"]] for r in got} == {t: None if t is None else t.split() for t in texts.to_pylist()}


def test_words_are_indexed_by_three_segments(spark, tmp_path):
    """A word of any length has three rows at most, and all words near a term are found by them."""
    letters = ["", "a", "b", "é"]
    words = sorted({w + x + y for w in ("aab", "abab", "babab", "ababab", "bbaaéb", "abcdefg") for x in letters for y in letters} | {w[:i] + x + w[i + 1 :] for w in ("abab", "ababab", "bbaaéb", "abcdefg") for i in range(7) for x in letters} | {"a", "b", "ab", "x" * 4000})
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    index = fulltext.build_index(docs, str(tmp_path / "i"), {"text": 1.0}, buckets=2)
    kept = spark.read.parquet(f"{index.path}/segments")
    assert kept.groupBy("word").count().where("count > 3").count() == 0 and kept.select("word").distinct().count() == len(words)
    terms = ["a", "ab", "aba", "abab", "babab", "ababab", "bbaaéb", "abcdefg", "cdefgab", "bcdefg"]
    got = {tuple(r) for r in index.near(terms).collect()}
    pairs = spark.createDataFrame([(t, fulltext.may_differ(t), w) for t in terms for w in words], "term string, most int, word string")
    want = {tuple(r) for r in pairs.withColumn("d", F.levenshtein("term", "word")).where("d <= most").select("term", "word", "d").collect()}
    assert got == want and len(want) > 60


def test_documents_of_a_word_are_counted_at_its_first_place(spark, tmp_path):
    """Fields, repeated words and rows without an id count once for a document; the places are marked when they are written."""
    docs = spark.createDataFrame([(1, "a b a", "a"), (2, "b", None), (None, "a", "a c"), (None, "a", "b")], "doc_id long, title string, text string")
    index = fulltext.build_index(docs, str(tmp_path / "i"), {"title": 1.0, "text": 0.4}, buckets=2)
    assert {(r["word"], r["uses"], r["docs"]) for r in index.words().collect()} == {("a", 6, 2), ("b", 3, 3), ("c", 1, 1)}
    kept = spark.read.parquet(f"{index.path}/occurrences")
    assert {(r["word"], r["n"]) for r in kept.where("first").groupBy("word").agg(F.count("*").alias("n")).collect()} == {("a", 2), ("b", 3), ("c", 1)}
    assert index.occurrences().columns == ["word", "doc", "field", "pos", "bucket"]


def test_expertise_has_more_tasks_for_more_rows(spark, monkeypatch):
    """A task's share of the rows is bounded: partitions grow with the line items."""
    monkeypatch.setattr(relational, "TASK_ROWS", 500)
    plan = relational.expertise(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(o_custkey#\d+L?, p_brand#\d+, 1[0-9]\), REPARTITION_BY_NUM", plan)


def test_top_tokens_shuffle_texts_once(spark, monkeypatch):
    """Tokens are counted where their texts are; partitions grow with the texts."""
    monkeypatch.setattr(T, "TASK_TEXTS", 3)
    docs = spark.createDataFrame([(i, "b b a c " * i) for i in range(30)] + [(3, "c c c c"), (40, None)], "doc_id long, text string")
    got = T.top_tokens(docs, "doc_id", F.split("text", " +"), 2)
    rows = {(r["doc_id"], r["token"]): r["n"] for r in got.collect() if r["token"]}
    assert rows[3, "c"] == 7 and rows[3, "b"] == 6 and (3, "a") not in rows and rows[29, "b"] == 58
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and ", 10), REPARTITION_BY_NUM" in plan


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in {"BLOCK": 8, "GROUP": 50, "TILE": 7}.items():
        monkeypatch.setattr(vectors, name, n)


def embedded(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_vectors_are_copied_for_few_blocks(spark, monkeypatch):
    """A vector is copied for no more blocks than give each core some pairs of them, and a pair's results are those of all pairs."""
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rows = embedded(spark, np.random.default_rng(5).normal(size=(400, 6)).round(3))
    plan = vectors.similarity_edges(rows, 0.9)._jdf.queryExecution().analyzed().toString()
    # blocks are numbered from 0
    assert int(re.search(r"sequence\(0, (\d+)", plan)[1]) < 10


def test_pairs_over_tiles_and_blocks(spark, small_blocks):
    """Pairs, nearest rows, sums and silhouettes where a task has several tiles, and copies among the vectors."""
    x = np.random.default_rng(6).normal(size=(130, 5)).round(3)
    x[100:] = x[:30]
    rows = embedded(spark, x)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    upper = np.triu_indices(130, 1)
    assert {tuple(r) for r in vectors.similarity_edges(rows, 0.5).collect()} == {(i, j, s[i, j]) for i, j in zip(*upper, strict=True) if s[i, j] >= 0.5}
    near = {(r["query_id"], r["vec_id"]) for r in vectors.neighbours(rows, rows, 3, -1.0).collect()}
    assert near == {(i, j) for i in range(130) for j in sorted((j for j in range(130) if j != i), key=lambda j: (-s[i, j], j))[:3]}
    got, all_pairs = vectors.similarity_summary(rows).first(), s[upper]
    assert (got["n"], got["low"], got["high"], got["near"]) == (130 * 129 // 2, all_pairs.min(), all_pairs.max(), (all_pairs >= 0.8).sum())
    assert got["mean"] == pytest.approx(all_pairs.mean(), abs=1e-6) and got["dev"] == pytest.approx(all_pairs.std(), abs=1e-6)
    labels = rows.select("vec_id", F.lit(0).alias("labelling"), (F.col("vec_id") % 3).alias("cluster"))
    d = np.sqrt(np.maximum(0, ((x.astype(np.float32).astype(float)[:, None] - x.astype(np.float32).astype(float)[None]) ** 2).sum(2)))
    of = np.arange(130) % 3
    a = np.array([d[i, of == of[i]].sum() / ((of == of[i]).sum() - 1) for i in range(130)])
    b = np.array([min(d[i, of == k].mean() for k in range(3) if k != of[i]) for i in range(130)])
    assert clusters.silhouettes(rows, labels).first()["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-6)
    with pytest.raises(Exception, match="lengths"):
        vectors.similarity_edges(rows.union(spark.createDataFrame([(999, [1.0])], rows.schema)), 0.5).collect()


def test_pairs_of_a_class_stay_in_their_task(spark, small_blocks, monkeypatch):
    """Pairs are counted by hundredths where they are found; listed ones leave their task tile by tile."""
    x = np.random.default_rng(8).normal(size=(120, 3)).round(1)
    # similarities of exactly 0.8 and 0.6
    x[:3], x[3:6] = [[1, 0, 0], [0.8, 0.6, 0], [-1, 0, 0]], [[0.8, -0.6, 0], [0, 1, 0], [3, 0, 0]]
    rows = embedded(spark, x).withColumn("of", F.col("vec_id") % 3)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    upper = [(i, j) for i, j in zip(*np.triu_indices(120, 1), strict=True) if s[i, j] >= 0.2]
    found = vectors.similarity_counts(rows, 0.2, "of")
    got = {(r["upto"], r["same"]): r["n"] for r in found.collect()}
    assert sum(got.values()) == len(upper)
    for bound in (0.2, 0.6, 0.8, 0.95):
        for same in (True, False):
            assert sum(n for (upto, alike), n in got.items() if upto > bound and alike == same) == sum(s[i, j] > bound and (i % 3 == j % 3) == same for i, j in upper)
    sizes = []
    monkeypatch.setattr(vectors.pa, "record_batch", lambda x, real=pa.record_batch: sizes.append(len(x["a"])) or real(x))
    monkeypatch.setattr(vectors, "block_pairs", lambda rows, key: Caught(rows))
    near = vectors.similarity_edges(rows, 0.2)
    batch = pa.RecordBatch.from_pylist([{"vec_id": i, "embedding": v.tolist(), "block": 0} for i, v in enumerate(x)])
    assert sum(map(len, near((0, 0), iter([batch])))) == len(upper) and max(sizes) <= 49


class Caught:
    """Gives the function that a task would run."""

    def __init__(self, rows):
        self.rows = rows

    def groupBy(self, *keys):  # noqa: N802
        return self

    def applyInArrow(self, f, schema):  # noqa: N802
        return f


def test_terms_move_as_bytes(spark, monkeypatch):
    """A document's terms are a few bytes each wherever they are written or shuffled, texts that have an id of their own are counted where they lie, and similarities are those of all pairs."""
    for name, n in {"BLOCK_TERMS": 300, "BLOCK_PACKED": 900, "STEP_TEXTS": 7}.items():
        monkeypatch.setattr(mining, name, n)
    x = np.array([0, 127, 128, 5, 1 << 14, (1 << 33) + 9, 300])
    packed = pa.concat_arrays([mining._packed(x, np.array([0, 3, 3, 7])), mining._packed(x, np.array([0, 7]))])
    for rows, want, ends in ((packed, [*x, *x], [0, 3, 3, 7, 14]), (packed.slice(2, 1), x[3:], [0, 4]), (packed.slice(1, 1), [], [0, 0])):
        got, bounds = mining._unpacked(rows)
        assert got.tolist() == list(want) and bounds.tolist() == ends
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice([f"{chr(97 + a)}{chr(97 + b)}x" for a in range(20) for b in range(15)], 40)) + " abx" * (i % 3 * 100)) for i in range(80)]
    docs, written = spark.createDataFrame(texts, "doc_id long, text string"), []
    monkeypatch.setattr(mining, "cut", lambda df, real=mining.cut: written.append((df._jdf.queryExecution().toString(), real(df))) or written[-1][1])
    w = mining.tfidf(docs)
    assert "REPARTITION_BY_NUM" not in written[0][0]
    got = mining.similar_texts(w, docs.where("doc_id % 4 = 1"), 3)
    of = {}
    for r in w.collect():
        of.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    sims = {q: sorted((-sum(v * of[i].get(t, 0) for t, v in of[q].items()), i) for i in of if i != q)[:3] for q in of if q % 4 == 1}
    assert {(r["query"], r["doc_id"]): r["similarity"] for r in got.collect()} == pytest.approx({(q, i): round(-s, 6) for q, best in sims.items() for s, i in best}, abs=1.1e-6)
    kept, kinds = written[1][1], dict(written[1][1].dtypes)
    assert kinds["numbers"] == kinds["counts"] == "binary"
    assert kept.agg(F.sum(F.length("numbers") + F.length("counts")) / F.sum("size")).first()[0] < 4 and kept.where("not asks and size(asked) > 0").count() == 0


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_term_weights_shuffle_texts_once(spark, monkeypatch, most):
    """Counts and norms stay where the texts were dealt to; terms join by broadcast or, where there are too many, by shuffle."""
    monkeypatch.setattr(mining, "SEND_TERMS", most)
    texts = [(1, "Aaa bbb-aaa 1ccc"), (2, "bbb ccc ddd the"), (2, "Éaaa"), (None, "ddd ccc"), (None, "ddd"), (4, None), (5, ""), (6, "zz xyz")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = mining.tfidf(docs)
    count = {1: {"aaa": 2, "bbb": 1, "ccc": 1}, 2: {"bbb": 1, "ccc": 1, "ddd": 1, "aaa": 1}, None: {"ddd": 2, "ccc": 1}}
    df = {t: sum(t in c for c in count.values()) for t in ("aaa", "bbb", "ccc", "ddd")}
    raw = {d: {t: n * (np.log(9 / (1 + df[t])) + 1) for t, n in c.items()} for d, c in count.items()}
    want = {(d, t): w / np.sqrt(sum(x * x for x in c.values())) for d, c in raw.items() for t, w in c.items()}
    assert {(r["doc_id"], r["term"]): r["weight"] for r in got.collect()} == pytest.approx(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not most or plan.count("Exchange hashpartitioning") == 1


def test_rows_passed_on_are_not_written_again(spark, monkeypatch):
    """A stage that gives back its rows as they are writes no table of them, and is counted all the same."""
    written = []
    monkeypatch.setattr(ingest, "cut", lambda df, real=ingest.cut: written.append(df) or real(df))
    stages = [ingest.Stage("one", lambda r, c: r.withColumn("y", F.col("x") + 1)), ingest.Stage("same", lambda r, c: r), ingest.Stage("two", lambda r, c: r, lambda c: F.when(F.col("x") > 3, "big"))]
    context = ingest.Context()
    out = ingest.run(stages, spark.createDataFrame([(i, i) for i in range(6)], "doc_id long, x long"), context)
    assert out.count() == 4 and len(written) == 2
    assert [(m["rows_in"], m["failed"], m["rows_out"]) for m in context.metrics] == [(6, 0, 6), (6, 0, 6), (6, 2, 4)]
