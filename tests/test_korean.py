"""Hangul: letters, tokens, sentences, searches and the index of prefixes."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from fernloom.functions import korean as K
from fernloom.operators import korean

TEXTS = ["학생이 학교에 가요. 밥을 먹다!  정말?  。 끝", "", None, "  \t\n", "hello 값 ㄱㄴ 뷁", "가 가 가가", "한국어 。말이!", "😀 이 끝이", "나" * 5000]
#: Compatibility letters by the order of the letters that Unicode takes syllables apart into.
FIRSTS, VOWELS, LASTS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", K.VOWELS, K.FINALS


def apart(text):
    out = []
    for c in text:
        parts = unicodedata.normalize("NFD", c) if "가" <= c <= "힣" else ""
        out.append("".join((FIRSTS[ord(p) - 0x1100] if ord(p) < 0x1161 else VOWELS[ord(p) - 0x1161] if ord(p) < 0x11A8 else LASTS[ord(p) - 0x11A8]) for p in parts) or c)
    return "".join(out)


def test_letters(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, "".join(chr(c) for c in range(0xAC00, 0xD7A4))]], "t string").select("t", K.letters(F.col("t")).alias("x")).collect()
    assert all(r["x"] == (None if r["t"] is None else apart(r["t"])) for r in rows)


def test_places(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", K.tokens(F.col("t")).alias("w"), K.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["w"] is None and r["s"] is None
            continue
        assert [w["text"] for w in r["w"]] == r["t"].split()
        assert all(r["t"][w["start"] : w["end"]] == w["text"] for w in r["w"])
        assert all(r["t"][s["start"] : s["end"]].strip() == s["text"] for s in r["s"])
    assert [s["text"] for s in rows[0]["s"]] == ["학생이 학교에 가요", "밥을 먹다", "정말", "끝"]
    assert [w["start"] for w in rows[5]["w"]] == [0, 2, 4]


def test_parts_of_speech_and_initials(spark):
    words = {"먹다": "VV", "가요": "VV", "학생이": "JKS", "고양이가": "JKS", "기술": "NNG", "데이터": "NNG", "": "NNG", None: None}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", K.part_of_speech(F.col("w")).alias("x")).collect()
    assert {r["w"]: r["x"] for r in rows} == words
    asked = {"ㄱㄴㄷ": True, "ㅎ": True, "가나다": False, "hello": False, "ㄱ나": False, "": True}
    rows = spark.createDataFrame([(w,) for w in asked], "w string").select("w", K.only_initials(F.col("w")).alias("x")).collect()
    assert {r["w"]: r["x"] for r in rows} == asked


DOCS = [(1, "한국어 사전", "값이 있다", "a", 5), (2, "Title", "한글 100%", "b", 9), (3, None, None, "a", 7), (4, "ㅎㄱ 모음", "", None, 5), (5, "하늘", "TITLE case", "a", 5), (5, "하늘", "TITLE case", "a", 5)]


@pytest.mark.parametrize(
    ("query", "mode", "more", "want"),
    [("title", "exact", {}, [2, 5, 5]), ("하", "exact", {}, [5, 5]), ("하", "jamo", {}, [2, 1, 5, 5]), ("한국", "chosung", {}, [2, 1, 4]), ("ㅎㄱ", "chosung", {"category": "a"}, [1]), ("0%", "morpheme", {}, [2]), ("%", "exact", {}, [2]), ("", "exact", {"limit": 2}, [2, 1]), ("없음", "jamo", {}, [])],
)
def test_search(spark, query, mode, more, want):
    index = korean.prepared(spark.createDataFrame(DOCS, "doc int, title string, content string, category string, updated int"))
    rows = korean.search(index, query, mode, **more).collect()
    assert [r["doc"] for r in rows] == want
    assert all(r["score"] == 1 and r["match_type"] == {"jamo": "exact"}.get(mode, mode) for r in rows)


def test_search_of_other_inputs(spark):
    empty = spark.createDataFrame([], "doc int, title string, content string, category string, updated int, more int")
    assert korean.search(korean.prepared(empty), "가").count() == 0
    with pytest.raises(ValueError, match="mode"):
        korean.search(korean.prepared(empty), "가", "sound")


def test_prefixes(spark, tmp_path):
    path = str(tmp_path / "prefixes")
    titles = ["한국어", "한국어", "학교", "Hat", "hat", "ㅎ 자", None, "나무"]
    korean.write_prefixes(spark.createDataFrame([(t,) for t in titles], "title string"), path)

    def found(prefix, **more):
        return [(r["completion"], r["frequency"], r["match_type"]) for r in korean.complete(spark, path, prefix, **more).collect()]

    assert sorted(found("ㅎㄱ")) == [("학교", 3, "chosung"), ("한국어", 3, "chosung")]
    assert sorted(found("ㅎ", initials=False)) == [("ㅎ 자", 1, "exact")]
    assert sorted(found("HA")) == [("Hat", 2, "exact"), ("hat", 2, "exact")]
    assert found("없") == []
    assert len(found("ㅎ", limit=2)) == 2
    plan = korean.complete(spark, path, "ㅎㄱ")._jdf.queryExecution().toString()
    assert "StringStartsWith(initials,ㅎㄱ)" in plan
