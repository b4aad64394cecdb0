"""Queries of the stored full-text index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernloom.operators import fulltext, search
from fernloom.session import load
from fernloom.sources.files import scratch

C = F.col
FIELDS = {"source": 1.0, "text": 0.4}
BOOSTS = [3.0, 1.0]
TERMS = ["the", "lation", "webb"]
_BUILT: dict[tuple[str, str], fulltext.FullTextIndex] = {}


def index(spark, d) -> fulltext.FullTextIndex:
    """The index of the documents under their source as title, built once for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = fulltext.build_index(load(spark, d, "documents"), scratch(spark), FIELDS)
    return _BUILT[key]


def ranked_full_text(spark, d):
    """Documents with two stems by cover density; function words of the query count for nothing."""
    return index(spark, d).ranked("The tioning of an Erinator").select(C("doc").alias("doc_id"), "score")


def ranked_titles(spark, d):
    """A word of the title and one of the text: a title's words weigh more."""
    return index(spark, d).ranked("src8 tions").select(C("doc").alias("doc_id"), "score")


def search_modes(spark, d):
    """One query in each of the four modes."""
    rows = load(spark, d, "embeddings")
    vector = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    modes = [search.by_mode(index(spark, d), "the tioning", rows, vector, m, 20, 0.05).select(F.lit(m).alias("mode"), C("doc").cast("long").alias("doc_id"), "score") for m in ("keyword", "vector", "hybrid", "deep")]
    return reduce(DataFrame.unionByName, modes)


def marked_headlines(spark, d):
    return index(spark, d).headlines("The tioning of an Erinator", load(spark, d, "documents"), "doc_id", "text").select(C("doc").alias("doc_id"), "score", "headline")


def indexed_words(spark, d):
    """Every word of the index, its uses and documents, and its first and last place in a document."""
    places = index(spark, d).occurrences().groupBy("word").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return index(spark, d).words().select("word", "uses", "docs").join(places, "word")


def near_words(spark, d):
    return index(spark, d).near(TERMS + ["tiones", "a"]).select("term", "word", C("distance").cast("long").alias("distance"))


def boosted_search(spark, d):
    """Documents whose source (as the title) or words are near the query's, best field, with a boost of 3 for titles."""
    return index(spark, d).fuzzy(TERMS, BOOSTS).select(C("doc").alias("doc_id"), "score")


_WORDS = r"regexp_extract_all(lower(coalesce({}, chr(32))), '[\p{{L}}\p{{N}}]+')"
PLACES = f"""p AS (SELECT doc_id, {_WORDS.format("source")} AS a, {_WORDS.format("text")} AS b FROM documents),
w AS (SELECT doc_id, 0 AS field, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM p UNION ALL SELECT doc_id, 1, unnest(b), len(a) + generate_subscripts(b, 1) FROM p)"""


def _ranked(*families: str) -> str:
    """SQL of the ranking; a family is a pattern of a stem's words."""
    kind = " ".join(f"WHEN regexp_full_match(word, '{f}') THEN {k}" for k, f in enumerate(families))
    last = ", ".join(f"max(CASE WHEN k = {k} THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS l{k}" for k in range(len(families)))
    every = " AND ".join(f"l{k} IS NOT NULL" for k in range(len(families)))
    return f"""WITH {PLACES}, h AS (SELECT doc_id, pos, CASE {kind} END AS k, CASE field WHEN 0 THEN 1 ELSE 2.5 END AS cost FROM w WHERE k IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(cost) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM h),
l AS (SELECT *, {last} FROM i), f AS (SELECT doc_id, i, pos, total, least({", ".join(f"l{k}" for k in range(len(families)))}) AS b FROM l WHERE {every}),
m AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM f)
SELECT m.doc_id, round(sum((m.i - m.b + 1) / CAST(m.total - s.total + s.cost AS DOUBLE) / (1 + (m.pos - s.pos) - (m.i - m.b))), 6) AS score FROM m JOIN i s ON s.doc_id = m.doc_id AND s.i = m.b WHERE prev IS NULL OR m.b > prev GROUP BY m.doc_id"""


def _most(t: str) -> int:
    return 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2


def _best(t: str, field: str) -> str:
    return f"coalesce(1 - list_min(list_filter(list_transform(list_filter({field}, lambda w: abs(len(w) - {len(t)}) <= {_most(t)}), lambda w: levenshtein({_ONE.format('w')}, '{t}')), lambda x: x <= {_most(t)})) / {len(t)}, 0)"


#: All words of the tables with the two stems.
TION, ERIN = "tion(ly|ed|edly|es|ing|ingly|lyed|lying)?", "erin(ly|lyed|lying|ed|edly|es|ing|ator|ates|er|ered|ering|erly|e?able|e?ant|eation)?"
#: This SQL's distance counts bytes; no term has a letter of more than one.
_ONE = r"regexp_replace({}, '[^\x00-\x7F]', '#', 'g')"
NEAR = " UNION ALL ".join(f"SELECT '{t}' AS term, word, levenshtein({_ONE.format('word')}, '{t}') AS distance FROM v WHERE distance <= {_most(t)}" for t in [*TERMS, "tiones", "a"])
BOOSTED = f"""WITH f AS (SELECT doc_id, list_distinct({_WORDS.format("source")}) AS s, list_distinct({_WORDS.format("text")}) AS t FROM documents)
SELECT * FROM (SELECT doc_id, round(greatest(3 * ({" + ".join(_best(t, "s") for t in TERMS)}), {" + ".join(_best(t, "t") for t in TERMS)}), 6) AS score FROM f) WHERE score > 0"""

_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
MODES = f"""WITH a AS ({_ranked(TION)}), k AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM a QUALIFY r <= 40),
v AS (SELECT e.vec_id AS doc_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY round({_COS}, 6) DESC, e.vec_id) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY r <= 40),
u AS (SELECT doc_id, sum(1 / (60 + r)) + CASE WHEN count(*) = 2 THEN 0.1 ELSE 0 END AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY 1), h AS (SELECT doc_id, round(score / (SELECT max(score) FROM u), 6) AS score FROM u),
p AS (SELECT doc_id, round(score * (1 - 0.02 * (row_number() OVER (ORDER BY score DESC, doc_id) - 1)), 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM h QUALIFY place <= 30),
m AS (SELECT 'keyword' AS mode, doc_id, score FROM k UNION ALL SELECT 'vector', doc_id, score FROM v UNION ALL SELECT 'hybrid', doc_id, score FROM h UNION ALL SELECT 'deep', doc_id, score FROM p)
SELECT mode, CAST(doc_id AS BIGINT) AS doc_id, score FROM m WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY score DESC, doc_id) <= 20"""

QUERIES = {
    "search_modes": (search_modes, MODES),
    "ranked_full_text": (ranked_full_text, _ranked(TION, ERIN)),
    "ranked_titles": (ranked_titles, _ranked("src8", TION)),
    "marked_headlines": (marked_headlines, None),
    "indexed_words": (indexed_words, f"WITH {PLACES} SELECT word, count(*) AS uses, count(DISTINCT doc_id) AS docs, min(pos) AS first, max(pos) AS last FROM w GROUP BY word"),
    "near_words": (near_words, f"WITH {PLACES}, v AS (SELECT DISTINCT word FROM w) {NEAR}"),
    "boosted_search": (boosted_search, BOOSTED),
}
