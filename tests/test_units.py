"""Cases that the tables don't have."""

import datetime

import pytest
from pyspark.sql import functions as F

from fernloom.functions import documents as D
from fernloom.functions import text as T
from fernloom.operators import chunking, graph, hierarchy, predicates, ranking, search, timeline, vectors
from fernloom.plans import catalogue
from fernloom.sources import files
from fernloom.streaming import events as streams
from fernloom.streaming.events import folded_edits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_language_and_korean(spark):
    assert [one(spark, T.language(F.lit(t))) for t in ("hello", "안녕하세요", "これは日本", "中文文本", "")] == ["en", "ko", "ja", "zh", "en"]
    assert one(spark, T.initial_consonants(F.lit("한글 a"))) == "ㅎㄱ a"


def test_sentences_tokens_slugs(spark):
    assert one(spark, T.sentence_count(F.lit("a."))) == 2
    assert [one(spark, T.token_estimate(F.lit("a" * n))) for n in (5, 26)] == [2, 7]
    assert one(spark, T.slug(F.lit("  Héllo, World! "))) == "héllo-world"
    assert one(spark, T.without_reasoning(F.lit("a<think>x</think>b<think>y"))) == "ab"
    assert tuple(one(spark, T.line_changes(F.lit("a\nb"), F.lit("a\nc\nd")))) == (2, 1)


def test_streak_and_heat(spark):
    days = spark.createDataFrame([(1, datetime.date(2024, 1, d)) for d in (1, 2, 4, 5, 6)] + [(2, datetime.date(2024, 1, 1))], "user_id int, day date")
    assert {tuple(r) for r in timeline.streaks(days, "2024-01-07").collect()} == {(1, 3, 3), (2, 0, 1)}
    assert [one(spark, timeline.heat_level(F.lit(v), F.lit(m))) for v, m in ((0, 0), (4, 4), (1, 4), (9, 4))] == [0, 4, 1, 4]


def test_hierarchy_cycle(spark):
    nodes = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id int, parent int, name string")
    assert sorted((r["root"], r["id"], r["level"]) for r in hierarchy.descendants(nodes, 5).collect()) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 3, 0)]


def test_predicates(spark):
    assert predicates.escape_like("a%b_c\\") == "a\\%b\\_c\\\\"
    docs = spark.createDataFrame([(1, 7, True), (2, 8, False), (3, 7, False)], "id int, user_id int, is_public boolean")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(predicates.visible_to(docs, 7)) == [1, 3] and ids(predicates.visible_to(docs, None)) == [1] and ids(predicates.visible_to(docs, 8, write=True)) == [2]
    assert one(spark, predicates.transition_allowed(F.lit("draft"), F.lit("published"))) is False


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "  "), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in chunking.fixed(docs, 3, 1).orderBy("index").collect()] == [(1, 0, "a b c", 3), (1, 1, "c d e", 3)]
    assert chunking.fixed(docs, 0).count() == 0
    assert one(spark, chunking.sentences(F.lit("One. Two! Three"))) == ["One.", "Two.", "Three."]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id int, rank int")
    best = search.fused([a, b]).orderBy(F.desc("score")).collect()
    assert (best[0]["doc_id"], best[0]["score"]) == (2, 1.0)
    assert search.fused([a.limit(0), b.limit(0)]).count() == 0
    assert one(spark, search.expansions(F.lit("fix error"))) == ["fix issue", "fix problem", "solve error"]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (7, 8, 1.0)], "a long, b long, weight double")
    assert {tuple(r) for r in graph.distances(e, 1, 5).collect()} == {(1, 0), (2, 1), (3, 2)}
    groups = {r["node"]: r["community"] for r in graph.communities(e, 5).collect()}
    assert groups[7] == groups[8] != groups[1] == groups[2] == groups[3]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["similarity"]) for r in vectors.nearest(v, [2.0, 0.0], 5, -1.0).collect()} == {(1, 1.0), (2, 0.0), (3, 0.0)}


def test_documents(spark):
    assert one(spark, D.called("avg", F.lit("1, x, 4"))) == "2.5" and one(spark, D.called("sum", F.lit(""))) == "0" and one(spark, D.called("min", F.lit("x"))) == ""
    assert one(spark, D.answer(F.lit("no json"))) is None


def test_front_matter_and_notes(spark):
    text = F.lit('---\ntitle: "A b"\ndate: 2024-01-02\n---\nbody')
    assert one(spark, files.front_matter(text)) == {"title": "A b", "date": "2024-01-02"}
    assert one(spark, files.front_matter(F.lit("no block"))) == {}
    note = files.outline_note(F.lit("#+title: T\n#+filetags: :a:b:\n:ID: x1\n[[id:k][K]] [[file.org]]"))
    assert [one(spark, note[k]) for k in ("title", "id", "tags", "links")] == ["T", "x1", ["a", "b"], ["k", "file.org"]]


def test_folder_and_log(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/my-note_1.md").write_text("hello")
    (tmp_path / "blank.md").write_text("  ")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "x.txt").write_text("no")
    found = {r["title"]: (r["text"], r["status"]) for r in files.markdown_folder(spark, str(tmp_path)).collect()}
    assert found == {"my note 1": ("hello", "ok"), "blank": (None, "empty"), "bad": (None, "not_utf8")}
    log = spark.createDataFrame([(1, "abcdef1|Ann|Fix it | now"), (2, " 2 files changed, 3 insertions(+), 1 deletion(-)"), (3, "1234567|Bo|Empty")], "no int, line string")
    assert {tuple(r) for r in files.commits(log).collect()} == {("abcdef1", "Ann", "Fix it | now", 2, 3, 1), ("1234567", "Bo", "Empty", 0, 0, 0)}


def test_pages_and_upsert(spark):
    df = spark.range(45).withColumnRenamed("id", "k")
    rows = ranking.page(df, [F.col("k")], 3, 20).collect()
    assert [r["k"] for r in rows] == [40, 41, 42, 43, 44] and {(r["total"], r["pages"], r["has_next"]) for r in rows} == {(45, 3, False)}
    old, new = (spark.createDataFrame(x, "k int, v int, t string") for x in ([(1, 1, "a"), (2, 5, "b")], [(1, 1, "A"), (2, 4, "B"), (3, 1, "C")]))
    assert {(r["k"], r["t"]) for r in ranking.latest_wins(old, new, ["k"], "v").collect()} == {(1, "A"), (2, "b"), (3, "C")}


@pytest.mark.parametrize("bad", [[], [(None, None)]])
def test_empty_tables(spark, bad):
    docs = spark.createDataFrame(bad, "doc_id int, text string")
    assert search.postings(docs).count() == 0
    assert T.top_tokens(docs, "doc_id", T.keywords(F.col("text"))).count() == 0


def test_edit_fold_takes_all_users(spark, tmp_path):
    rows = [(i, i * 7 % 12, f"e{i % 5}" * (1 + i % 3)) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for i, user, text in rows:
        n, acc = want.get(user, (0, ""))
        at = min(i % 10, len(acc))
        want[user] = (n + 1, acc[:at] + ("" if i % 3 == 1 else text) + acc[at + (0 if i % 3 == 0 else len(text)) :])
    assert len(want) == 12
    df = catalogue()["edit_fold"][0](spark, str(tmp_path))
    assert {r["doc"]: (r["version"], r["text"]) for r in df.collect()} == want
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_folded_edits_nulls_and_places(spark):
    rows = [("a", 1, "insert", 99, "héllo"), ("a", 2, "delete", -3, "é"), ("a", 3, "replace", 3, "xyz"), ("b", 1, "insert", None, "t"), ("b", 2, None, 0, "u"), ("c", 2, "insert", 0, "v"), ("c", 1, "insert", 0, None), (None, 1, "delete", 0, "w"), (None, 0, "insert", 0, "w😀")]
    df = folded_edits(spark.createDataFrame(rows, "doc string, seq long, op string, at int, text string"))
    assert {tuple(r) for r in df.collect()} == {("a", 3, "éllxyz"), ("b", 2, "u"), ("c", 2, None), (None, 2, "😀")}
    assert folded_edits(spark.createDataFrame([], "doc string, seq long, op string, at int, text string")).count() == 0


def test_lda_topics_of_all_languages(spark, tmp_path):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("wasser feuer", "de"), ("wasser feuer", "de"), ("letter window", "en"), ("letter window", "en")])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["term"] for r in catalogue()["lda_topics"][0](spark, str(tmp_path)).collect()} == {"wasser", "feuer", "letter", "window"}


def test_fixed_rules(spark):
    sample = "a (b); c: [d] " * 3
    assert one(spark, T.complexity(F.lit(sample))) == 100 and one(spark, T.complexity(F.lit(""))) == 0
    # two sentences of four words with an empty one after the last mark, all words distinct
    assert one(spark, T.complexity(F.lit("aa bb cc dd. ee ff gg hh."))) == round(25 * (8 / 3 / 20) + 25 * (18 / 8 / 8) + 25, 6)
    assert [one(spark, T.sentiment(F.lit(t))) for t in ("I LIKE it", "the worst", "good but bad", "")] == ["positive", "negative", "neutral", "neutral"]
    assert [one(spark, T.doc_type(F.lit(t))) for t in ("How to x", "Parameters: y", "let a let b let c let d let e let f", "# T\n" + "w " * 600, "short", "w " * 300)] == ["tutorial", "reference", "code", "article", "notes", "unknown"]
    assert one(spark, search.expansions(F.lit("Fix the error"))) == ["fix the issue", "fix the problem", "solve the error"]
    assert one(spark, search.expansions(F.lit("very new thing here"))) == ["thing here"] and one(spark, search.expansions(F.lit("new thing"))) == []
    assert [one(spark, D.called("repeat", F.lit(a))) for a in ("ab", "ab,3", "ab, 0", "ab,x")] == ["ab", "ababab", "", "ab"]
    assert len(one(spark, D.called("repeat", F.lit("a,5000")))) == 1000


def test_sliding_limit_and_throttle(spark):
    at = [0, 10, 20, 30, 61, 65, 75]
    rows = spark.createDataFrame([(i, 1, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for i, s in enumerate(at)], "event_id int, user_id int, ts timestamp_ntz")
    # the fourth is rejected and doesn't count: a minute after the first there is room again
    assert sorted(r["event_id"] for r in streams.sliding_limited(rows, 3, 60).where("accepted").collect()) == [0, 1, 2, 4, 6]
    assert sorted(r["event_id"] for r in streams.throttled(rows, 25).where("accepted").collect()) == [0, 3, 4]


def test_late_rows_are_dropped(spark, tmp_path):
    import time

    day = lambda n, h=0: datetime.datetime(2024, 1, n, h)
    for name, rows in (("a", [(1, day(1)), (2, day(1, 5)), (3, day(5))]), ("b", [(5, day(9))]), ("c", [(4, day(1, 6)), (6, day(20))])):
        spark.createDataFrame([(i, 7, t, "view") for i, t in rows], "event_id long, user_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(str(tmp_path / f"raw-{name}"))
        next((tmp_path / f"raw-{name}").glob("part-*.parquet")).rename(tmp_path / f"events-{name}.parquet")
        time.sleep(1.1)
    for folder in tmp_path.glob("raw-*"):
        for f in folder.iterdir():
            f.unlink()
        folder.rmdir()
    got = streams.finished(streams.daily_counts(streams.read_events(spark, str(tmp_path), "events-*.parquet")))
    # event 4 comes after the watermark has passed its day; the last day is still open
    assert sorted((str(r["day"]), r["n"]) for r in got.collect()) == [("2024-01-01", 2), ("2024-01-05", 1), ("2024-01-09", 1)]


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(1).normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(i, j, s[i, j]) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}
    assert {(r["a"], r["b"], r["similarity"]) for r in vectors.similarity_edges(rows, 0.5).collect()} == want
    got = vectors.neighbours(rows.where("vec_id % 20 = 0"), rows, 3, -1.0).collect()
    for q in (0, 20, 40):
        best = sorted(((-s[q, j], j) for j in range(60) if j != q))[:3]
        assert sorted((-r["similarity"], r["vec_id"]) for r in got if r["query_id"] == q) == best
    pairs = s[np.triu_indices(60, 1)]
    row = vectors.similarity_summary(rows).first()
    assert row["n"] == len(pairs) and row["low"] == pairs.min() and row["far"] == (pairs < 0.5).sum() and abs(row["dev"] - pairs.std()) < 1e-5


def test_chunks_against_plain_code(spark):
    text = "One two. Three! Four?  Five\n\nshort\n\n" + "long paragraph " * 20 + "\n\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    want = []
    for p in parts:
        if want and len(p) < 100:
            want[-1] += "\n\n" + p
        else:
            want.append(p)
    assert [r["text"] for r in chunking.paragraphs(docs, 100).orderBy("index").collect()] == want


def test_semantic_chunks(spark):
    from fernloom.operators.chunking import semantic

    long = "One two three four. Five six seven eight! Nine ten?"
    rows = [(1, "aaaa\n\nbbbb\n\n \n\ncccc"), (2, "x\n\n" + long + "\n\ny\n\nz"), (3, None), (4, " \n\n"), (5, "é" * 40)]
    got = {}
    for r in semantic(spark.createDataFrame(rows, "doc_id int, text string"), 6).orderBy("doc_id", "index").collect():
        got.setdefault(r["doc_id"], []).append((r["index"], r["text"], r["n_tokens"]))
    assert got == {
        1: [(0, "aaaa\n\nbbbb\n\ncccc", 5)],
        2: [(0, "x", 1), (1, "One two three four.", 5), (2, "Five six seven eight.", 6), (3, "Nine ten?.", 3), (4, "y\n\nz", 2)],
        5: [(0, "é" * 40 + ".", 21)],
    }


def test_comment_cut(spark):
    from pyspark.sql import functions as F

    from fernloom.functions.content import comment_cut

    rows = spark.createDataFrame([("é" * 60,), ("a" * 60,), ("é" * 50,), ("",), (None,)], "t string").select(comment_cut(F.col("t"), 100)).collect()
    assert [r[0] for r in rows] == ["é" * 50, "a" * 60, "é" * 50, "", None]


def test_deep_hierarchy(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(14)], "id int, parent int, name string")
    got = {(r["root"], r["id"]): r["level"] for r in hierarchy.descendants(nodes).collect()}
    assert got == {(a, b): b - a for a in range(14) for b in range(a, 14)}
    assert hierarchy.descendants(nodes, 2).count() == 14 + 13 + 12
    facts = spark.createDataFrame([(13,), (13,), (5,)], "id int")
    assert {r["id"]: (r["direct"], r["total"]) for r in hierarchy.subtree_counts(nodes, facts).collect()} == {i: ((i == 5) + 2 * (i == 13), 2 + (i <= 5)) for i in range(14)}


def test_streaks_of_a_long_history(spark):
    days = spark.sql("SELECT 1 AS user_id, explode(sequence(DATE '2022-01-01', DATE '2024-01-07')) AS day")
    assert [tuple(r) for r in timeline.streaks(days, "2024-01-07").collect()] == [(1, 365, 365)]
    assert [tuple(r) for r in timeline.streaks(days.where("day < '2023-06-01'"), "2024-01-07").collect()] == [(1, 0, 144)]
