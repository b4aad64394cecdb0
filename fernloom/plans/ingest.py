"""Queries of the staged ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernloom.functions import metadata
from fernloom.operators import ingest
from fernloom.session import load

C = F.col
MOST = 40_000
_DONE: dict[tuple[str, str], tuple[DataFrame, ingest.Context]] = {}


def _incoming(docs: DataFrame) -> DataFrame:
    """Documents with leading blocks, repeated titles, some paths, and blank contents among them."""
    i = C("doc_id")
    title = F.when(i % 10 == 3, F.concat(C("source"), F.lit(" notes"))).otherwise(F.concat(F.lit("doc "), i.cast("string")))
    block = F.when(i % 9 == 4, F.concat(F.lit("---\nauthor: 'A "), C("source"), F.lit("'\ntitle: named "), (i % 20).cast("string"), F.lit("\ndate: 2024-0"), (i % 12).cast("string"), F.lit("-05\n---\n"))).otherwise("")
    content = F.when(i % 11 == 5, " \n\t").otherwise(F.concat(block, C("text")))
    return docs.select("doc_id", title.alias("title"), F.when(i % 7 == 2, F.concat(F.lit("in/"), C("source"))).alias("path"), content.alias("content"), "lang", "source")


def _run(spark, d) -> tuple[DataFrame, ingest.Context]:
    """The whole ingest of the documents, run once for a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _DONE:
        docs = load(spark, d, "documents")
        old = _incoming(docs.where("doc_id % 5 = 0")).withColumn("title", F.when(C("doc_id") % 2 == 0, F.concat(F.lit("old "), C("doc_id").cast("string"))).otherwise(C("title")))
        tags = docs.select(C("lang").alias("tag")).distinct().select(F.ascii("tag").cast("long").alias("tag_id"), "tag").where("tag in ('de', 'en')")
        topics = F.array(F.upper("lang"), F.concat(F.lit("  "), C("source"), F.lit(" ")), F.concat(C("language"), F.lit(" "), C("type")), F.lit(" "), F.repeat(C("lang"), 26), C("author"))
        context = ingest.Context({"max_bytes": MOST, "store": old, "tags": tags, "analyse": topics})
        _DONE[key] = (ingest.run(ingest.STAGES, _incoming(docs), context), context)
    return _DONE[key]


def ingested_documents(spark, d):
    """What the stages found of each document that was taken."""
    done = _run(spark, d)[0]
    return done.select("doc_id", "title", "author", "date", "n_words", "minutes", "n_chunks", F.size("links").cast("long").alias("n_links"))


def ingest_stages(spark, d):
    """Rows that each stage was given, refused and passed on."""
    context = _run(spark, d)[1]
    rows = [(i, m["stage"], m["status"], m["rows_in"], m["failed"], m["rows_out"]) for i, m in enumerate(context.metrics, 1)]
    return spark.createDataFrame(rows, "place int, stage string, status string, rows_in long, failed long, rows_out long")


def ingest_faults(spark, d):
    return reduce(DataFrame.unionByName, _run(spark, d)[1].faults)


def ingest_store(spark, d):
    """The stored documents after the run: new ones in place of old ones of their path or title."""
    return _run(spark, d)[1].tables["documents"].select("key", "doc_id", F.sha2("content", 256).alias("hash"))


def ingest_tags(spark, d):
    """Tags, old and new, and how many documents each has."""
    t = _run(spark, d)[1].tables
    return t["tags"].join(t["document_tags"], "tag_id", "left").groupBy("tag_id", "tag").agg(F.count("doc_id").alias("n"))


def authors_and_dates(spark, d):
    docs = _incoming(load(spark, d, "documents"))
    return docs.select("doc_id", metadata.author(C("content"), C("content")).alias("author"), metadata.found_date(C("content"), C("content")).alias("date"))


_INCOMING = """i AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN source || ' notes' ELSE 'doc ' || doc_id END AS title, CASE WHEN doc_id % 7 = 2 THEN 'in/' || source END AS path, lang, source,
  CASE WHEN doc_id % 11 = 5 THEN ' ' || chr(10) || chr(9) ELSE CASE WHEN doc_id % 9 = 4 THEN '---' || chr(10) || 'author: ''A ' || source || '''' || chr(10) || 'title: named ' || (doc_id % 20) || chr(10) || 'date: 2024-0' || (doc_id % 12) || '-05' || chr(10) || '---' || chr(10) ELSE '' END || text END AS content FROM documents)"""


def _plain(c: str) -> str:
    for pattern, by in (("(?s)```.*?```", ""), ("(?m)^#{1,6} +", ""), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"[*_`]([^*_`\n]+)[*_`]", r"\1")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


def _author(text: str) -> str:
    return rf"CASE WHEN doc_id % 9 = 4 AND doc_id % 11 <> 5 THEN 'A ' || source ELSE nullif(trim(regexp_extract({text}, '{metadata.AUTHOR}', 1), ' '), '') END"


def _date(text: str) -> str:
    own = "CASE WHEN doc_id % 9 = 4 AND doc_id % 11 <> 5 AND doc_id % 12 BETWEEN 1 AND 9 THEN CAST('2024-0' || (doc_id % 12) || '-05' AS DATE) END"
    return f"coalesce({own}, CAST(try_strptime(regexp_extract({text}, '{metadata.DATES[0][0]}', 1), '%Y-%m-%d') AS DATE), CAST(try_strptime(regexp_extract({text}, '{metadata.DATES[1][0]}', 1), '%m/%d/%Y') AS DATE))"


_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)
FLOW = rf"""{_INCOMING}, f AS (SELECT *, CASE WHEN NOT regexp_matches(content, '{_NOT_SPACE}') THEN 'Content cannot be empty' WHEN strlen(content) > {MOST} THEN 'Content too large' END AS fault FROM i),
x AS (SELECT * REPLACE (CASE WHEN doc_id % 9 = 4 THEN 'named ' || (doc_id % 20) ELSE title END AS title), {_plain("content")} AS text FROM f WHERE fault IS NULL),
m AS (SELECT *, len(regexp_extract_all(text, '{_NOT_SPACE}+')) AS n_words, {_author("text")} AS author, {_date("text")} AS date FROM x),
s AS (SELECT *, coalesce('path ' || path, 'title ' || title) AS key FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1)"""
_TYPE = """CASE WHEN contains(lower(text), 'step 1') OR contains(lower(text), 'how to') THEN 'tutorial' WHEN contains(lower(text), 'api reference') OR contains(lower(text), 'parameters:') THEN 'reference'
  WHEN list_sum(list_transform(['fn ', 'function ', 'class ', 'def ', 'import ', 'const ', 'let '], lambda k: (length(text) - length(replace(lower(text), k, ''))) / length(k))) > 5 THEN 'code'
  WHEN regexp_matches(text, '(?m)^#{1,6} ') AND strlen(text) > 1000 THEN 'article' WHEN strlen(text) < 500 THEN 'notes' ELSE 'unknown' END"""
TAGS = rf"""WITH {FLOW}, t AS (SELECT DISTINCT doc_id, trim(lower(unnest([upper(lang), '  ' || source || ' ', 'en ' || {_TYPE}, ' ', repeat(lang, 26), author])), ' ') AS tag FROM s),
n AS (SELECT doc_id, tag FROM t WHERE strlen(tag) BETWEEN 1 AND 50), k AS (SELECT DISTINCT CAST(ascii(lang) AS BIGINT) AS tag_id, lang AS tag FROM documents WHERE lang IN ('de', 'en')),
g AS (SELECT tag_id, tag FROM k UNION ALL SELECT (SELECT max(tag_id) FROM k) + row_number() OVER (ORDER BY tag), tag FROM (SELECT DISTINCT tag FROM n WHERE tag NOT IN (SELECT tag FROM k)))
SELECT tag_id, tag, count(doc_id) AS n FROM g LEFT JOIN n USING (tag) GROUP BY tag_id, tag"""
_ALL, _GOOD, _KEPT = "(SELECT count(*) FROM f)", "(SELECT count(*) FROM x)", "(SELECT count(*) FROM s)"
STAGE_ROWS = f"""WITH {FLOW} SELECT CAST(place AS INTEGER) AS place, stage, CASE stage WHEN 'embedding' THEN 'skipped' ELSE 'done' END AS status, CASE WHEN stage = 'embedding' THEN NULL WHEN place = 1 THEN {_ALL} WHEN place = 8 THEN {_KEPT} ELSE {_GOOD} END AS rows_in,
  CASE WHEN stage = 'embedding' THEN NULL WHEN place = 1 THEN {_ALL} - {_GOOD} ELSE 0 END AS failed, CASE WHEN stage = 'embedding' THEN NULL WHEN place >= 7 THEN {_KEPT} ELSE {_GOOD} END AS rows_out
FROM (SELECT unnest(['ingestion', 'parsing', 'metadata', 'chunking', 'embedding', 'analysis', 'storage', 'indexing']) AS stage, unnest(range(1, 9)) AS place)"""
STORE = rf"""WITH {FLOW}, o AS (SELECT *, coalesce('path ' || path, 'title ' || CASE WHEN doc_id % 2 = 0 THEN 'old ' || doc_id ELSE title END) AS key FROM i WHERE doc_id % 5 = 0)
SELECT key, doc_id, sha256(content) AS hash FROM s UNION ALL SELECT key, doc_id, sha256(content) FROM o WHERE key NOT IN (SELECT key FROM s)"""

QUERIES = {
    "ingested_documents": (ingested_documents, rf"WITH {FLOW} SELECT doc_id, title, author, date, n_words, CAST(ceil(n_words / 200) AS BIGINT) AS minutes, CASE WHEN n_words = 0 THEN 0 WHEN n_words <= 100 THEN 1 ELSE CAST(ceil((n_words - 100) / 80) AS BIGINT) + 1 END AS n_chunks, len(regexp_extract_all(regexp_replace(content, '!\[', '', 'g'), '\[([^\]]*)\]\(([^)\s]+)[^)]*\)')) AS n_links FROM s"),
    "ingest_stages": (ingest_stages, STAGE_ROWS),
    "ingest_faults": (ingest_faults, f"WITH {FLOW} SELECT doc_id, 'ingestion' AS stage, fault FROM f WHERE fault IS NOT NULL"),
    "ingest_store": (ingest_store, STORE),
    "ingest_tags": (ingest_tags, TAGS),
    "authors_and_dates": (authors_and_dates, f"WITH {_INCOMING} SELECT doc_id, {_author('content')} AS author, {_date('content')} AS date FROM i"),
}
