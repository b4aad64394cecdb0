"""Queries of markdown, HTML entities, templates, diffs, backlinks and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernloom.functions import markup as M
from fernloom.functions import text as T
from fernloom.operators import mining, vectors
from fernloom.session import load

C = F.col


def markdown_outline(spark, d):
    md = F.concat(F.lit("# "), C("p_brand"), F.lit("\nSee [type]("), C("p_partkey").cast("string"), F.lit(") and **"), C("p_type"), F.lit("**\n## Sub\n```py\nx = 1\n```\n"))
    rows = load(spark, d, "part").select("p_partkey", md.alias("md"))
    h, k, c = M.headings(C("md")), M.links(C("md")), M.code_blocks(C("md"))
    show = lambda a, f: F.array_join(F.transform(a, f), ";")
    return rows.select("p_partkey", show(h, lambda x: F.concat_ws(":", x["level"], x["text"], x["line"])).alias("headings"), show(k, lambda x: F.concat_ws(":", x["text"], x["url"])).alias("links"), show(c, lambda x: F.concat_ws(":", x["language"], x["code"])).alias("code"), M.plain(C("md")).alias("text"))


OUTLINE = "SELECT p_partkey, '1:' || p_brand || ':0;2:Sub:2' AS headings, 'type:' || p_partkey AS links, 'py:x = 1' || chr(10) AS code, p_brand || chr(10) || 'See type and ' || p_type || chr(10) || 'Sub' || chr(10) || chr(10) AS text FROM part"


def decoded_pages(spark, d):
    """Titles with their references decoded."""
    return load(spark, d, "pages").select("page_id", M.decoded(F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" &amp;lt; &#x41;&#65; &#55296; &#9999999; &eacute; &nope;"))).alias("title"))


DECODED = "SELECT page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;', '&') || ' &lt; AA ' || chr(65533) || ' &#9999999; é &nope;' AS title FROM pages"


def controlled_templates(spark, d):
    t = F.lit(".if{seg == AUTO}car.endif.if{!empty(note)} note={{x}}.endif.foreach{v}in{tags}[{{v}}].endforeach")
    values = F.to_json(F.struct(F.substring("c_mktsegment", 1, 4).alias("seg"), F.lit("a, b").alias("tags"), F.when(C("c_custkey") % 2 == 0, "n").otherwise("").alias("note")))
    return load(spark, d, "customer").select("c_custkey", M.controlled(t, values).alias("text"))


CONTROLLED = "SELECT c_custkey, CASE WHEN substr(c_mktsegment, 1, 4) = 'AUTO' THEN 'car' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ' note={{x}}' ELSE '' END || '[a][b]' AS text FROM customer"


def unified_diffs(spark, d):
    """Diffs between each turn of a thread and the one before."""
    c = load(spark, d, "conversations").withColumn("old", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("old is not null")
    diff = M.unified_diff(C("old"), C("text"))
    return c.select("conv_id", "turn", diff.alias("diff")).select("conv_id", "turn", F.regexp_count("diff", F.lit(r"(?m)^\+")).cast("long").alias("added"), F.regexp_count("diff", F.lit(r"(?m)^-")).cast("long").alias("removed"))


def backlinks(spark, d):
    """Wiki links between documents, resolved by title in any case: the first document of a title is meant. Links to itself and to nothing don't count.

    Each document links to the documents of its first two title words, so that links resolve.
    """
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", F.lower(F.regexp_extract("text", r"^(\S{1,40})", 1)).alias("title"), F.lower(F.regexp_extract("text", r"^\S+\s+(\S{1,40})", 1)).alias("to"))
    target = docs.where("title <> ''").groupBy("title").agg(F.min("doc_id").alias("target"))
    text = F.concat(F.lit("see [["), "to", F.lit("|that]] and [["), "title", F.lit("]]"))
    out = docs.where("to <> ''").select("doc_id", F.explode(T.wiki_links(text)).alias("title"))
    hits = out.join(target, "title").where(C("doc_id") != C("target")).select("doc_id", "target").distinct()
    both = hits.select(C("doc_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(hits.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("links"), F.sum("i").alias("backlinks"))


BACKLINKS = r"""WITH d AS (SELECT doc_id, lower(regexp_extract(text, '^([^ \t\n\r\f\x0B]{1,40})', 1)) AS title, lower(regexp_extract(text, '^[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]+([^ \t\n\r\f\x0B]{1,40})', 1)) AS other FROM documents WHERE text IS NOT NULL),
t AS (SELECT title, min(doc_id) AS target FROM d WHERE title <> '' GROUP BY 1), o AS (SELECT doc_id, unnest([other, title]) AS title FROM d WHERE other <> ''),
h AS (SELECT DISTINCT doc_id, target FROM o JOIN t USING (title) WHERE doc_id <> target AND NOT regexp_matches(title, '[\]|]'))
SELECT node, CAST(sum(o) AS BIGINT) AS links, CAST(sum(i) AS BIGINT) AS backlinks FROM (SELECT doc_id AS node, 1 AS o, 0 AS i FROM h UNION ALL SELECT target, 0, 1 FROM h) GROUP BY 1"""


def korean_and_initials(spark, d):
    t = F.concat(F.lit("그리고 한국어 검색 "), C("p_brand"), F.lit(" 가"))
    return load(spark, d, "part").select("p_partkey", F.array_join(M.korean_keywords(t), ";").alias("keywords"), T.initial_consonants(F.lit("검색")).alias("initials"))


KOREAN = "SELECT p_partkey, '한국어;검색;' || p_brand AS keywords, 'ㄱㅅ' AS initials FROM part"


def dbscan_clusters(spark, d):
    return mining.dbscan(load(spark, d, "embeddings"), 0.35)


COS = "list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))"
DBSCAN = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE round({COS}, 6) >= 0.35),
c AS MATERIALIZED (SELECT a FROM e GROUP BY a HAVING count(*) >= 2), l AS MATERIALIZED (SELECT * FROM e WHERE a IN (FROM c) AND b IN (FROM c)), r AS (SELECT a, a AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS label FROM r GROUP BY a), n AS (SELECT e.a, min(label) AS label FROM e JOIN m ON m.a = e.b WHERE e.a NOT IN (FROM c) GROUP BY e.a)
SELECT vec_id, z.label AS cluster FROM embeddings LEFT JOIN (FROM m UNION ALL FROM n) z ON z.a = vec_id"""


def cluster_quality(spark, d):
    v = load(spark, d, "embeddings")
    return mining.cluster_quality(v, mining.kmeans(v, 4))


def lda_topics(spark, d):
    return mining.topics(load(spark, d, "documents"), 3)


def duplicate_classes(spark, d):
    """Pairs by how alike they are, and whether their label is even."""
    e = vectors.similarity_counts(load(spark, d, "embeddings").withColumn("author", C("vec_id") % 2), 0.2, "author")
    return e.groupBy(mining.duplicate_class(C("upto"), C("same")).alias("class")).agg(F.sum("n").alias("n"))


CLASSES = f"SELECT CASE WHEN s > 0.95 THEN 'exact' WHEN s > 0.8 AND a % 2 = b % 2 THEN 'same_author' WHEN s > 0.8 THEN 'cross_author' WHEN s > 0.6 THEN 'similar' ELSE 'different' END AS class, count(*) AS n FROM (SELECT x.vec_id AS a, y.vec_id AS b, round({COS}, 6) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE s >= 0.2 GROUP BY 1"

QUERIES = {
    "markdown_outline": (markdown_outline, OUTLINE),
    "decoded_pages": (decoded_pages, DECODED),
    "controlled_templates": (controlled_templates, CONTROLLED),
    "unified_diffs": (unified_diffs, None),
    "backlinks": (backlinks, BACKLINKS),
    "korean_and_initials": (korean_and_initials, KOREAN),
    "dbscan_clusters": (dbscan_clusters, DBSCAN),
    "cluster_quality": (cluster_quality, None),
    "lda_topics": (lda_topics, None),
    "duplicate_classes": (duplicate_classes, CLASSES),
}
