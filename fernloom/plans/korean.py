"""Queries of Hangul: tokens, sentences, letters, search modes and completions.

The tables have no Korean text, so letters of their texts stand for syllables: `HANGUL`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fernloom.functions import korean as K
from fernloom.functions.text import INITIALS, initial_consonants
from fernloom.operators import korean
from fernloom.session import load
from fernloom.sources.files import cut, scratch

C = F.col
LATIN, HANGUL = "abcdefghijklmnopqrstuvwxyz", "가나강논다바사아자차카타문이솔파하옷요덟빛잣칠킥쌍꽃"
#: Query and mode of each search, prefix of each completion.
SEARCHES = (("덟아다 ", "exact"), ("ㄷㅇㄷㅈ", "chosung"), ("솔더", "jamo"), ("이논", "morpheme"))
PREFIXES = ("덟아", "ㅈㅇ", "가")


def _texts(spark, d):
    text = F.translate(F.lower("text"), LATIN, HANGUL)
    return load(spark, d, "documents").select("doc_id", text.alias("text"), "source")


def korean_tokens(spark, d):
    """Tokens of each part of speech in each document, and where they stand."""
    each = _texts(spark, d).select("doc_id", F.explode(K.tokens(C("text"))).alias("t")).select("doc_id", K.part_of_speech(C("t.text")).alias("pos"), "t.*")
    return each.groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"), F.sum("end").cast("long").alias("ends"))


def korean_sentences(spark, d):
    return _texts(spark, d).select("doc_id", F.explode(K.sentences(C("text"))).alias("s")).select("doc_id", C("s.start").cast("long").alias("start"), C("s.end").cast("long").alias("end"), C("s.text").alias("sentence"))


def korean_letters(spark, d):
    return _texts(spark, d).select("doc_id", F.sha2(K.letters(C("text")), 256).alias("letters"), F.sha2(initial_consonants(C("text")), 256).alias("initials"))


def korean_search(spark, d):
    """A search in each mode over titles (first lines) and texts."""
    docs = _texts(spark, d).select(C("doc_id").alias("doc"), F.split("text", "\n")[0].alias("title"), C("text").alias("content"), C("source").alias("category"), (C("doc_id") % 1000).alias("updated"))
    index = cut(korean.prepared(docs))
    found = [korean.search(index, q, mode).withColumn("mode", F.lit(mode)) for q, mode in SEARCHES]
    out = found[0].union(found[1]).union(found[2]).union(found[3])
    return out.select("mode", "doc", F.sha2("snippet", 256).alias("snippet"), "matched_term", "match_type")


def korean_completions(spark, d):
    path = scratch(spark)
    korean.write_prefixes(_texts(spark, d).select(F.split("text", "\n")[0].alias("title")), path)
    found = [korean.complete(spark, path, p) for p in PREFIXES]
    return found[0].union(found[1]).union(found[2])


_T = f"t AS (SELECT doc_id, source, translate(lower(text), '{LATIN}', '{HANGUL}') AS text FROM documents)"
_CODE = "(unicode(c) - 44032)"
_FORM = "array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN {} ELSE c END), '')"
_FIRST = f"substr('{INITIALS}', CAST({_CODE} // 588 AS BIGINT) + 1, 1)"
_REST = f"substr('{K.VOWELS}', CAST({_CODE} % 588 // 28 AS BIGINT) + 1, 1) || CASE WHEN {_CODE} % 28 = 0 THEN '' ELSE substr('{K.FINALS}', CAST({_CODE} % 28 AS BIGINT), 1) END"


def _initials(c: str) -> str:
    return _FORM.format(c, _FIRST)


def _letters(c: str) -> str:
    return _FORM.format(c, f"{_FIRST} || {_REST}")


def _search_sql() -> str:
    of = {"chosung": _initials, "jamo": _letters}
    one = """SELECT * FROM (SELECT '{m}' AS mode, doc_id AS doc, sha256(substr(text, 1, 200)) AS snippet, {q} AS matched_term, '{kind}' AS match_type FROM t
    WHERE contains({text}, {q}) ORDER BY doc_id % 1000 DESC, doc_id LIMIT 20)"""
    parts = [one.format(m=m, q=of.get(m, str)(f"'{q}'"), text=of.get(m, str)("text"), kind={"jamo": "exact"}.get(m, m)) for q, m in SEARCHES]
    return f"WITH {_T} " + " UNION ALL ".join(parts)


def _completion_sql() -> str:
    one = """SELECT * FROM (SELECT '{p}' AS text, title AS completion, CAST(1.0 AS DOUBLE) AS score, '{kind}' AS match_type, CAST(sum(count(*)) OVER () AS BIGINT) AS frequency FROM l
    WHERE starts_with({by}, '{p}') GROUP BY title ORDER BY title LIMIT 10)"""
    kinds = [(p, p[0] in INITIALS) for p in PREFIXES]
    return f"WITH {_T}, l AS (SELECT string_split(text, chr(10))[1] AS title FROM t) " + " UNION ALL ".join(one.format(p=p, kind="chosung" if i else "exact", by=_initials("title") if i else "title") for p, i in kinds)


_PIECES = f"p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{{}}')) AS s, generate_subscripts(regexp_extract_all(text, '{{}}'), 1) AS i FROM t), o AS (SELECT *, CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM p)"
_WORDS, _PARTS = f"[{K.SPACES}]+|[^{K.SPACES}]+", "[.!?。]+|[^.!?。]+"
TOKENS = f"""WITH {_T}, {_PIECES.format(_WORDS, _WORDS)} SELECT doc_id, CASE WHEN right(s, 1) IN ('다', '요') THEN 'VV' WHEN right(s, 1) IN ('이', '가') THEN 'JKS' ELSE 'NNG' END AS pos, count(*) AS n,
CAST(sum(e - length(s)) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM o WHERE regexp_matches(s, '[^{K.SPACES}]') GROUP BY 1, 2"""
SENTENCES = f"""WITH {_T}, {_PIECES.format(_PARTS, _PARTS)} SELECT doc_id, e - length(s) AS start, e AS end, regexp_replace(s, '^[{K.SPACES}]+|[{K.SPACES}]+$', '', 'g') AS sentence FROM o
WHERE NOT regexp_matches(s, '^[.!?。]') AND regexp_matches(s, '[^{K.SPACES}]')"""
LETTERS = f"WITH {_T} SELECT doc_id, sha256({_letters('text')}) AS letters, sha256({_initials('text')}) AS initials FROM t"
QUERIES = {
    "korean_tokens": (korean_tokens, TOKENS),
    "korean_sentences": (korean_sentences, SENTENCES),
    "korean_letters": (korean_letters, LETTERS),
    "korean_search": (korean_search, _search_sql()),
    "korean_completions": (korean_completions, _completion_sql()),
}
