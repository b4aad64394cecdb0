"""Queries of text statistics over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernloom.functions import markup as M
from fernloom.functions import text as T
from fernloom.session import load

C = F.col


def _docs(spark, d):
    return load(spark, d, "documents")


def content_analysis(spark, d):
    w = T.words(C("text"))
    stop = F.least(F.lit(100.0), 10.0 * F.octet_length(F.array_join(w, "")) / F.greatest(F.size(w), F.lit(1)))
    return _docs(spark, d).select("doc_id", F.size(w).cast("long").alias("n_words"), T.sentence_count(C("text")).cast("long").alias("sentences"), F.round(stop, 6).alias("complexity"), T.reading_minutes(C("text")).alias("minutes"))


W = r"regexp_extract_all(text, '[^ \t\n\r\f\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')"
CONTENT = f"""SELECT doc_id, CAST(len({W}) AS BIGINT) AS n_words, CAST(len(regexp_split_to_array(text, '[.!?]')) AS BIGINT) AS sentences,
round(least(100.0, 10.0 * strlen(array_to_string({W}, '')) / greatest(len({W}), 1)), 6) AS complexity, CAST(ceil(len({W}) / 200) AS BIGINT) AS minutes FROM documents"""


def markdown_stats(spark, d):
    return _docs(spark, d).select("doc_id", *(v.alias(k) for k, v in T.markdown_stats(C("text")).items()))


_N = lambda p: f"len(regexp_extract_all(text, '{p}'))"
MARKDOWN = rf"""SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: length(trim(p)) > 0)) AS paragraphs,
{_N("(?m)^#{1,6} ")} AS headers, {_N(r"!\[[^\]]*\]\([^)]*\)")} AS images, {_N(r"\[[^\]]*\]\([^)]*\)")} AS links, {_N("```")} AS fences, {_N(r"\?")} AS questions, {_N("!")} AS exclamations,
{_N(r"\*\*[^*]+\*\*")} AS bold, {_N(r"`[^`\n]+`")} AS code, {_N("(?m)^[-*+] ")} AS items FROM documents"""


def doc_complexity(spark, d):
    return _docs(spark, d).select("doc_id", T.complexity(C("text")).alias("score"))


COMPLEXITY = rf"""WITH w AS (SELECT doc_id, text, {W} AS w, CAST(len({W}) AS DOUBLE) AS n, len(regexp_split_to_array(text, '[.!?]+')) AS s FROM documents)
SELECT doc_id, round(CASE WHEN n > 0 THEN least(100.0, 25 * (n / s / 20) + 25 * (length(array_to_string(w, '')) / n / 8) + 25 * (len(list_distinct(w)) / n) + 25 * (len(regexp_extract_all(text, '[;:(){{}}\[\]"]')) / length(text) * 1000)) ELSE 0 END, 6) AS score FROM w"""


def keyword_density(spark, d):
    """The ten most frequent keywords of each document with their share of all keywords."""
    top = T.top_tokens(_docs(spark, d), "doc_id", T.keywords(C("text")))
    return top.select("doc_id", "token", "n", F.round(C("n") * 100.0 / C("total"), 6).alias("density"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
KEYWORDS = f"""WITH k AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP}))) AS token FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM k GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS r FROM c)
SELECT doc_id, token, n, round(n * 100.0 / total, 6) AS density FROM a WHERE r <= 10"""


def document_classes(spark, d):
    """Language by script, type, sentiment and token estimate."""
    return _docs(spark, d).select("doc_id", T.language(C("text")).alias("language"), T.doc_type(C("text")).alias("type"), T.sentiment(C("text")).alias("sentiment"), F.round(T.polarity(C("text")), 6).alias("polarity"), T.token_estimate(C("text")).alias("tokens"))


def _any(ws):
    return " OR ".join(f"contains(lower(text), '{w}')" for w in ws)


def _sum(ws):
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws)


_CODE = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{k}', ''))) / {len(k)}" for k in T.CODE)
CLASSES = f"""WITH s AS (SELECT *, greatest(length(text), 1) AS n, len(regexp_extract_all(text, '[가-힣]')) AS h, len(regexp_extract_all(text, '[ぁ-ヿ]')) AS k, len(regexp_extract_all(text, '[一-鿿]')) AS c, {_sum(T.POSITIVE)} - ({_sum(T.NEGATIVE)}) AS p FROM documents)
SELECT doc_id, CASE WHEN h / n > 0.1 THEN 'ko' WHEN k > 0 AND k > c THEN 'ja' WHEN c / n > 0.1 THEN 'zh' ELSE 'en' END AS language,
CASE WHEN {_any(T.TUTORIAL)} THEN 'tutorial' WHEN {_any(T.REFERENCE)} THEN 'reference' WHEN {_CODE} > 5 THEN 'code' WHEN regexp_matches(text, '(?m)^#{{1,6}} ') AND strlen(text) > 1000 THEN 'article' WHEN strlen(text) < 500 THEN 'notes' ELSE 'unknown' END AS type,
CASE WHEN p > 0 THEN 'positive' WHEN p < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, round(greatest(-1.0, least(1.0, p / 10)), 6) AS polarity, CAST(strlen(text) // 4 + 1 AS BIGINT) AS tokens FROM s"""


def writing_advice(spark, d):
    """What each document should be told."""
    s = T.markdown_stats(C("text"))
    rows = _docs(spark, d).select("doc_id", F.size(T.words(C("text"))).alias("w"), s["headers"].alias("h"), T.reading_minutes(C("text")).alias("m"), s["links"].alias("l"))
    return rows.select("doc_id", F.array_join(F.transform(T.recommendations(C("w"), C("h"), C("m"), C("l")), lambda r: F.concat(r["kind"], F.lit(":"), r["severity"])), ";").alias("advice"))


ADVICE = rf"""WITH s AS (SELECT doc_id, len({W}) AS w, {_N("(?m)^#{1,6} ")} AS h, {_N(r"\[[^\]]*\]\([^)]*\)")} AS l FROM documents)
SELECT doc_id, concat_ws(';', CASE WHEN w < 100 THEN 'content_length:high' END, CASE WHEN w > 3000 THEN 'content_length:medium' END, CASE WHEN h = 0 AND w > 200 THEN 'structure:medium' END, CASE WHEN ceil(w / 200) > 10 THEN 'readability:low' END, CASE WHEN w > 500 AND l = 0 THEN 'engagement:low' END) AS advice FROM s"""


def structure_analysis(spark, d):
    """Headings, sections, introduction and conclusion of documents with headings of their source and language put in."""
    t = F.concat(F.lit("# Overview "), C("source"), F.lit("\nA few words\n## Part "), C("lang"), F.lit("\n"), C("text"), F.lit("\n### Wrap up\nend"))
    return _docs(spark, d).select("doc_id", *(v.alias(k) for k, v in T.structure(t).items()))


STRUCTURE = f"SELECT doc_id, 3 AS depth, '1:Overview ' || source || ';2:Part ' || lang || ';3:Wrap up' AS headings, '3,' || CASE WHEN len({W}) > 0 THEN len({W}) || ',' ELSE '' END || '1' AS sections, true AS introduction, true AS conclusion FROM documents"


def whitespace_keywords(spark, d):
    """The ten most frequent words of each document that are no Korean stop words, with their share of all words."""
    w = T.words(C("text"))
    docs = _docs(spark, d).select("doc_id", "text", F.size(w).alias("words"))
    n = T.top_tokens(docs, "doc_id", M.korean_keywords(C("text")))
    return n.join(docs.select("doc_id", "words"), "doc_id").select("doc_id", "token", "n", F.round(C("n") / C("words"), 6).alias("score"))


_KO = ", ".join(f"'{w}'" for w in M.KOREAN_STOP)
WHITESPACE = f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), k AS (SELECT doc_id, len(w) AS words, unnest(list_filter(w, lambda x: length(x) >= 2 AND lower(x) NOT IN ({_KO}))) AS token FROM w)
SELECT doc_id, token, count(*) AS n, round(count(*) / any_value(words), 6) AS score FROM k GROUP BY doc_id, token QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, token) <= 10"""


def titles_and_slugs(spark, d):
    docs = _docs(spark, d).select("doc_id", T.title(C("text")).alias("title"))
    return docs.select("doc_id", "title", T.slug(C("title")).alias("slug"))


TITLES = r"""WITH t AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: trim(string_split(x, '.')[1])), lambda x: length(x) BETWEEN 6 AND 79)[1], '') AS title FROM documents)
SELECT doc_id, title, substr(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS slug FROM t"""


def tags_and_mentions(spark, d):
    """Hash tags and mentions in their order; what a text joins to it for the test is fixed."""
    t = F.concat(C("text"), F.lit(" #Draft see [[Home|start]] and [[A b]] "))
    join = lambda a: F.array_join(a, ";")
    return _docs(spark, d).select("doc_id", join(T.hashtags(t)).alias("tags"), join(T.mentions(t)).alias("mentions"), join(T.wiki_links(t)).alias("links"))


_FIRST = lambda e: f"array_to_string(list_transform(list_sort(list_distinct(list_transform(range(1, len({e}) + 1), lambda i: {{'k': list_position({e}, ({e})[i]), 'v': ({e})[i]}}))), lambda s: s.v), ';')"
TAGS = rf"""WITH t AS (SELECT doc_id, text || ' #Draft see [[Home|start]] and [[A b]] ' AS t FROM documents),
x AS (SELECT doc_id, list_transform(regexp_extract_all(t, '#([A-Za-z][A-Za-z0-9_-]*)', 1), lambda x: lower(x)) AS a, regexp_extract_all(t, '@([A-Za-z0-9_]+)', 1) AS m, list_transform(regexp_extract_all(t, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1), lambda x: trim(x)) AS l FROM t)
SELECT doc_id, {_FIRST("a")} AS tags, {_FIRST("m")} AS mentions, {_FIRST("l")} AS links FROM x"""


def content_hashes(spark, d):
    return _docs(spark, d).select("doc_id", T.content_hash(C("text"), C("lang"), C("source")).alias("hash"))


def line_diff(spark, d):
    """Lines added and removed from each document to the next of its source."""
    from pyspark.sql import Window

    docs = _docs(spark, d).withColumn("old", F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))).where("old is not null")
    return docs.select("doc_id", T.line_changes(C("old"), C("text")).alias("c")).select("doc_id", "c.*")


LINE_DIFF = """WITH p AS (SELECT doc_id, string_split(lag(text) OVER (PARTITION BY source ORDER BY doc_id), chr(10)) AS a, string_split(text, chr(10)) AS b FROM documents),
c AS (SELECT doc_id, len(a) AS m, len(b) AS n, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) AS k FROM p WHERE a IS NOT NULL)
SELECT doc_id, CAST(k + greatest(n - m, 0) AS BIGINT) AS added, CAST(k + greatest(m - n, 0) AS BIGINT) AS removed FROM c"""


def normalised(spark, d):
    """Collapsed white space, escaped markup and an excerpt around a word."""
    return _docs(spark, d).select("doc_id", F.sha2(T.collapsed(C("text")), 256).alias("collapsed"), F.sha2(T.escape_html(C("text")), 256).alias("escaped"), T.excerpt(C("text"), "the", 60).alias("excerpt"))


NORMALISED = r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS collapsed, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped,
CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, 60) || CASE WHEN s + 60 <= length(text) THEN '...' ELSE '' END AS excerpt FROM (SELECT *, CAST(greatest(1, instr(lower(text), 'the') - 30) AS BIGINT) AS s FROM documents)"""


def quality_score(spark, d):
    """Mean of three capped scores: words / 10, lines * 20, questions * 25."""
    s = T.markdown_stats(C("text"))
    cap = lambda x: F.least(F.lit(100.0), x)
    return _docs(spark, d).select("doc_id", F.round((cap(F.size(T.words(C("text"))) / 10) + cap(s["lines"] * 20.0) + cap(s["questions"] * 25.0)) / 3, 6).alias("score"))


QUALITY = rf"SELECT doc_id, round((least(100.0, len({W}) / 10) + least(100.0, len(string_split(text, chr(10))) * 20.0) + least(100.0, len(regexp_extract_all(text, '\?')) * 25.0)) / 3, 6) AS score FROM documents"


def length_anomaly(spark, d):
    """Documents whose length is more than two deviations from the mean of all."""
    docs = _docs(spark, d).select("doc_id", F.length("text").alias("n"))
    m = docs.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("dev"))
    z = (C("n") - C("mean")) / F.greatest(C("dev"), F.lit(1.0))
    return docs.join(F.broadcast(m)).select("doc_id", F.round(z, 6).alias("z")).where("abs(z) > 2")


ANOMALY = "SELECT doc_id, z FROM (SELECT doc_id, round((length(text) - avg(length(text)) OVER ()) / greatest(stddev_pop(length(text)) OVER (), 1), 6) AS z FROM documents) WHERE abs(z) > 2"


def page_titles_links(spark, d):
    """Title and the links of each page."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s+[^>]*href="([^"]*)"'), 1)
    return load(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"), F.array_join(links, ";").alias("links"), F.element_at(F.split(F.parse_url("url", F.lit("PATH")), "/"), -1).alias("name"))


PAGES = r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(l) AS BIGINT) AS n_links, array_to_string(l, ';') AS links, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS name FROM (SELECT *, regexp_extract_all(html, '<a\s+[^>]*href="([^"]*)"', 1) AS l FROM pages)"""


def extension_distribution(spark, d):
    """Pages by the last label of their host."""
    host = F.parse_url("url", F.lit("HOST"))
    return load(spark, d, "pages").groupBy(F.element_at(F.split(host, r"\."), -1).alias("label")).agg(F.count("*").alias("n"))


QUERIES = {
    "content_analysis": (content_analysis, CONTENT),
    "markdown_stats": (markdown_stats, MARKDOWN),
    "doc_complexity": (doc_complexity, COMPLEXITY),
    "keyword_density": (keyword_density, KEYWORDS),
    "document_classes": (document_classes, CLASSES),
    "writing_advice": (writing_advice, ADVICE),
    "structure_analysis": (structure_analysis, STRUCTURE),
    "whitespace_keywords": (whitespace_keywords, WHITESPACE),
    "titles_and_slugs": (titles_and_slugs, TITLES),
    "tags_and_mentions": (tags_and_mentions, TAGS),
    "content_hashes": (content_hashes, "SELECT doc_id, sha256(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')) AS hash FROM documents"),
    "line_diff": (line_diff, LINE_DIFF),
    "normalised_texts": (normalised, NORMALISED),
    "quality_score": (quality_score, QUALITY),
    "length_anomaly": (length_anomaly, ANOMALY),
    "page_titles_links": (page_titles_links, PAGES),
    "extension_distribution": (extension_distribution, "SELECT regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '([^.]*)$', 1) AS label, count(*) AS n FROM pages GROUP BY 1"),
}
