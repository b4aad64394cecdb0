"""Queries of copied tables: new keys, checks of the copy, and backups matched with documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernloom.operators import matching, migration
from fernloom.session import load

C = F.col
NAMESPACE = "6f1d9a52-0c3e-4b7a-9d21-5e8f70b3c4aa"


def _key(kind: str, c: str):
    return migration.name_uuid(NAMESPACE, F.concat(F.lit(f"{kind}:"), C(c).cast("string")))


def copied_documents(spark, d):
    """What a second run of a copy adds, where a third of the documents is there already."""
    source = load(spark, d, "documents").select(_key("document", "doc_id").alias("id"), "doc_id", F.sha2("text", 256).alias("text"))
    return migration.to_copy(source, source.where("doc_id % 3 = 0"), ["id"])


def copied_links(spark, d):
    """Links under new keys, each once."""
    links = load(spark, d, "orders").select(_key("customer", "o_custkey").alias("customer"), C("o_orderpriority").alias("tag"))
    return migration.to_copy(links, links.where("tag = '1-URGENT'"), ["customer", "tag"])


def _copy(spark, d):
    """The documents, and a copy in which some are missing, some are changed, some have another's text and some are new."""
    source, n = load(spark, d, "documents").select("doc_id", "text", "lang"), C("doc_id")
    text = F.when(n % 97 == 1, F.concat("text", F.lit("."))).when(n % 89 == 2, F.lit(None)).otherwise(C("text"))
    target = source.where("doc_id % 83 <> 3").withColumn("text", text)
    return source, target.union(source.where("doc_id % 79 = 4").withColumn("doc_id", -n))


def copy_differences(spark, d):
    return migration.differences(*_copy(spark, d), "doc_id", ["text", "lang"])


def copy_parity(spark, d):
    orders = load(spark, d, "orders")
    return migration.parity({"documents": _copy(spark, d), "orders": (orders, orders)})


def backup_matches(spark, d):
    """Backups of documents, told by their id, their title (first word) or their beginning; some may not be seen by who asks."""
    n, title = C("doc_id"), F.regexp_extract("text", r"^(\S*)", 1)
    docs = load(spark, d, "documents").select(n.alias("doc"), (n % 7).alias("owner"), (n % 4 != 0).alias("public"), title.alias("title"), C("text").alias("content"), F.when(n % 3 == 0, n % 50).alias("updated"), (n % 40).alias("created"))
    asked, known = F.when(n % 5 != 0, n % 11), F.when(n % 3 == 0, n)
    named, text = F.when(n % 3 == 1, title), F.when(n % 2 == 0, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("x"), "text"))
    backups = load(spark, d, "documents").select(n.alias("backup_id"), asked.alias("user"), known.alias("id"), named.alias("title"), text.alias("content"))
    return matching.match_backups(backups, docs)


def _uuid(name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || CAST({name} AS BLOB))"
    return f"(SELECT concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], translate(h[17], '0123456789abcdef', '{'89ab' * 4}') || h[18:20], h[21:32]) FROM (SELECT {h} AS h))"


MATCHES = r"""WITH d AS (SELECT doc_id AS doc, doc_id % 7 AS owner, doc_id % 4 <> 0 AS public, regexp_extract(text, '^([^\s]*)', 1) AS title, substr(text, 1, 500) AS s, coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 END, doc_id % 40) AS t FROM documents),
b AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 11 END AS u, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS known, CASE WHEN doc_id % 3 = 1 THEN regexp_extract(text, '^([^\s]*)', 1) END AS title, substr(CASE WHEN doc_id % 2 = 0 THEN text || ' more' ELSE 'x' || text END, 1, 500) AS s FROM documents),
x AS (SELECT b.id, d.doc FROM b JOIN d ON d.doc = b.known AND (d.public OR d.owner = b.u)),
y AS (SELECT b.id, max({'t': d.t, 'doc': d.doc}).doc AS doc FROM b JOIN d ON d.title = b.title AND (d.public OR d.owner = b.u) WHERE b.id NOT IN (SELECT id FROM x) GROUP BY 1),
z AS (SELECT b.id, min(d.doc) AS doc FROM b JOIN d ON d.s = b.s AND (d.public OR d.owner = b.u) WHERE d.s <> '' AND b.id NOT IN (SELECT id FROM x) AND b.id NOT IN (SELECT id FROM y) GROUP BY 1)
SELECT b.id AS backup_id, coalesce(x.doc, y.doc, z.doc) AS doc, CASE WHEN x.doc IS NOT NULL THEN 'id' WHEN y.doc IS NOT NULL THEN 'title' WHEN z.doc IS NOT NULL THEN 'content' END AS matched_by
FROM b LEFT JOIN x USING (id) LEFT JOIN y USING (id) LEFT JOIN z USING (id)"""
_COPY = "t AS (SELECT doc_id, CASE WHEN doc_id % 97 = 1 THEN text || '.' WHEN doc_id % 89 = 2 THEN NULL ELSE text END AS text FROM documents WHERE doc_id % 83 <> 3 UNION ALL SELECT -doc_id, text FROM documents WHERE doc_id % 79 = 4)"
QUERIES = {
    "copied_documents": (copied_documents, f"SELECT {_uuid('(' + chr(39) + 'document:' + chr(39) + ' || doc_id)')} AS id, doc_id, sha256(text) AS text FROM documents WHERE doc_id % 3 <> 0"),
    "copied_links": (copied_links, f"SELECT DISTINCT {_uuid('(' + chr(39) + 'customer:' + chr(39) + ' || o_custkey)')} AS customer, o_orderpriority AS tag FROM orders WHERE o_orderpriority <> '1-URGENT'"),
    "copy_differences": (
        copy_differences,
        f"WITH {_COPY} SELECT coalesce(s.doc_id, t.doc_id) AS key, CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM documents s FULL JOIN t ON s.doc_id = t.doc_id WHERE s.doc_id IS NULL OR t.doc_id IS NULL OR s.text IS DISTINCT FROM t.text",
    ),
    "copy_parity": (
        copy_parity,
        f"WITH {_COPY} SELECT 'documents' AS \"table\", (SELECT count(*) FROM documents) AS source_n, (SELECT count(*) FROM t) AS target_n, (SELECT count(*) FROM documents) = (SELECT count(*) FROM t) AS same UNION ALL SELECT 'orders', count(*), count(*), true FROM orders",
    ),
    "backup_matches": (backup_matches, MATCHES),
}
