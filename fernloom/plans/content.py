"""Queries of uploads, comments, actions, requests, skills, query variants, contexts, exports and semantic chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernloom.functions import content as T
from fernloom.operators import chunking, graph, search
from fernloom.plans import retrieval
from fernloom.session import load

C = F.col
SKILLS = [("reviewer", ["review", "tion"]), ("writer", ["write", "ent"]), ("finder", ["find", "the"])]


def _uploads(spark, d):
    """Documents as uploads under names of several kinds."""
    name = F.concat(F.lit("a_new-"), C("lang"), F.element_at(F.array(*map(F.lit, [".md", ".MD", ".txt", "/x.md", ".Md"])), (C("doc_id") % 5 + 1).cast("int")))
    size = F.when(C("doc_id") % 17 == 0, 0).when(C("doc_id") % 19 == 0, T.MAX_UPLOAD + 1).otherwise(F.octet_length("text"))
    return load(spark, d, "documents").select("doc_id", name.alias("name"), size.alias("size"))


UPLOADS = f"""u AS (SELECT doc_id, 'a_new-' || lang || ['.md', '.MD', '.txt', '/x.md', '.Md'][doc_id % 5 + 1] AS name, CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN {T.MAX_UPLOAD + 1} ELSE strlen(text) END AS size FROM documents),
f AS (SELECT *, CASE WHEN name LIKE '%/%' THEN 'Invalid filename' WHEN lower(name) NOT LIKE '%.md' THEN 'Only .md files are accepted' WHEN size = 0 THEN 'File is empty' WHEN size > {T.MAX_UPLOAD} THEN 'File too large' END AS fault FROM u)"""


def uploads(spark, d):
    u = _uploads(spark, d).withColumn("fault", T.upload_fault(C("name"), C("size")))
    return u.select("doc_id", "fault", F.when(C("fault").isNull(), T.upload_title(C("name"))).alias("title"))


def ingest_report(spark, d):
    """How many files of a batch were ingested, skipped for their size or type, or in error."""
    fault = T.upload_fault(C("name"), C("size"))
    status = F.when(fault.isNull(), "ingested").when(fault.isin("Only .md files are accepted", "File too large"), "skipped").otherwise("error")
    return _uploads(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def scan_estimates(spark, d):
    name = F.concat(F.lit("scan."), C("lang"), F.element_at(F.array(*map(F.lit, [".PDF", ".png", ".webp", ""])), (C("doc_id") % 4 + 1).cast("int")))
    rows = load(spark, d, "documents").select("doc_id", T.extension(name).alias("extension"), T.scan_millis(C("n_chars").cast("long") * 1024).alias("millis"))
    return rows.withColumn("supported", C("extension").isin(T.SCANNED_FORMATS))


def index_texts(spark, d):
    title = F.when(C("doc_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), C("source")))
    return load(spark, d, "documents").select("doc_id", T.indexable(title, C("text")).alias("indexable"), F.octet_length(T.index_text(title, C("text"))).cast("long").alias("n_bytes"))


def comments(spark, d):
    return load(spark, d, "documents").select("doc_id", T.comment_cut(C("text"), 100).alias("comment"), C("text").rlike(r"\S").alias("valid"))


def action_classes(spark, d):
    kinds = {"view": "read", "click": "update", "error": "login_failed", "purchase": "create", "signup": "login"}
    action = F.coalesce(*(F.when(C("event_type") == a, b) for a, b in kinds.items()), C("event_type"))
    n = load(spark, d, "events").groupBy(action.alias("action")).agg(F.count("*").alias("n"))
    return n.select("action", "n", C("action").isin(T.SECURITY_ACTIONS).alias("security"), C("action").isin(T.DOCUMENT_ACTIONS).alias("document"))


def suspicious_pages(spark, d):
    return load(spark, d, "pages").select("page_id", F.array_join(T.suspicious(C("html")).cast("array<string>"), ",").alias("patterns"))


def skill_matches(spark, d):
    return load(spark, d, "documents").select("doc_id", T.first_trigger(C("text"), SKILLS).alias("skill"))


def query_rewrites(spark, d):
    q = F.concat(F.element_at(F.array(*map(F.lit, ["How to fix ", "what is an Error or ", "create a problem with ", "plain "])), (C("p_partkey") % 4 + 1).cast("int")), C("p_name"))
    return load(spark, d, "part").select("p_partkey", F.array_join(T.rewrites(q), "|").alias("queries"))


def query_variants(spark, d):
    """Lines of an answer for each part's name: an echo, a longer, a shorter, a changed and a foreign one."""
    text = F.concat(F.lit("1. large "), C("p_name"), F.lit(" of good steel\n\n"), F.upper("p_name"), F.lit("\r\n- ring\n* "), F.substring_index("p_name", " ", 1), F.lit(" thing\n2) other words"))
    v = load(spark, d, "part").select("p_partkey", F.posexplode(T.parsed_variants(text, C("p_name"))).alias("i", "v"))
    return v.select("p_partkey", "i", "v.query", "v.kind")


VARIANTS = r"""WITH a AS (SELECT p_partkey, p_name, string_split(replace('1. large ' || p_name || ' of good steel' || chr(10) || chr(10) || upper(p_name) || chr(13) || chr(10) || '- ring' || chr(10) || '* ' || string_split(p_name, ' ')[1] || ' thing' || chr(10) || '2) other words', chr(13) || chr(10), chr(10)), chr(10)) AS l FROM part),
b AS (SELECT p_partkey, p_name, list_transform(list_filter(l, lambda x: x <> '' AND lower(x) <> lower(p_name)), lambda x: trim(regexp_replace(x, '^[0-9.*-]+', ''))) AS l FROM a),
c AS (SELECT p_partkey, i, l[i + 1] AS query, string_split(p_name, ' ') AS o, string_split(l[i + 1], ' ') AS e FROM b, range(0, 5) r(i) WHERE i < len(l)),
s AS (SELECT *, len(list_filter(o, lambda w: list_contains(e, w))) AS shared FROM c)
SELECT p_partkey, CAST(i AS INTEGER) AS i, query, CASE WHEN len(e) > len(o) + 1 THEN 'specific' WHEN len(e) < len(o) - 1 THEN 'general' WHEN shared > 0 AND shared >= len(o) // 2 THEN 'synonym' WHEN shared > 0 THEN 'rephrase' ELSE 'related' END AS kind FROM s"""


def document_contexts(spark, d):
    """Each user's place and five annotations of the greatest priority, the earliest first of equal ones."""
    kind = F.element_at(F.array(*map(F.lit, T.ANNOTATION_LABELS)), (C("event_id") % 7 + 1).cast("int"))
    notes = load(spark, d, "events").select(F.concat(F.lit("/users/"), C("user_id").cast("string")).alias("path"), (C("event_id") % 11).alias("priority"), C("event_id").alias("seq"), kind.alias("type"), C("event_type").alias("note"))
    return search.contexts(notes)


CONTEXTS = """WITH n AS (SELECT user_id, event_id, event_id % 11 AS p, ['About', 'Purpose', 'For', 'Topic', 'When', 'Source', 'Note'][event_id % 7 + 1] || ': ' || event_type AS line FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 11 DESC, event_id) <= 5)
SELECT '/users/' || user_id AS path, 'Location: /users/' || user_id || chr(10) || string_agg(line, chr(10) ORDER BY p DESC, event_id) AS context FROM n GROUP BY user_id"""


def graph_export(spark, d):
    """The graph of brands as lines of the two sections of a file."""
    return graph.export_lines(retrieval._graph(spark, d))


EXPORT = f"""WITH {retrieval.GRAPH} SELECT 'nodes' AS section, '"' || a || '",' || count(*) AS line FROM l GROUP BY a UNION ALL SELECT 'edges', '"' || a || '","' || b || '",' || printf('%.4f', weight) FROM e"""


def semantic_chunks(spark, d):
    """Lines as paragraphs, packed up to 64 tokens."""
    docs = load(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.semantic(docs, 64).select("doc_id", "index", "n_tokens", F.sha2("text", 256).alias("hash"))


def full_text(spark, d):
    """Documents with all lexemes of a query; the source as title has weight A, the text B."""
    return search.full_text(load(spark, d, "documents"), {"source": 1.0, "text": 0.4}, "The tioning of bles").select("doc_id", "score")


def full_text_plain(spark, d):
    """The same over one field, all weights equal."""
    docs = load(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "text").alias("both"))
    return search.full_text(docs, {"both": 1.0}, "src8 the thered").select("doc_id", "score")


def formatted_times(spark, d):
    at = C("ts")
    return load(spark, d, "events").select("event_id", T.formatted(at, "%Y-%m-%d").alias("date"), T.formatted(at, "%H:%M:%S").alias("time"), T.formatted(at, "%A, %d %b %y at %I %p, day %j").alias("long"))


def _lexemes(c):
    word = "w"
    for ending, kept in T.LEXEME_ENDINGS:
        word = f"regexp_replace({word}, '{ending}', '{kept.replace('$1', chr(92) + '1')}')"
    stop = ", ".join(f"'{w}'" for w in T.LEXEME_STOP)
    return f"list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w NOT IN ({stop})), lambda w: {word})"


def _full_text(fields, query):
    cols = ", ".join(f"{_lexemes(f'coalesce({c}, chr(32))')} AS f{i}" for i, (c, _) in enumerate(fields))
    score = " + ".join(f"{w} * ln(1 + len(list_filter(f{i}, lambda x: x = t)))" for i, (_, w) in enumerate(fields))
    every = f"list_has_all(list_concat({', '.join(f'f{i}' for i in range(len(fields)))}{', []' if len(fields) == 1 else ''}), q)"
    return f"""WITH w AS (SELECT doc_id, {cols}, list_distinct({_lexemes("'" + query + "'")}) AS q FROM documents), t AS (SELECT *, unnest(q) AS t FROM w WHERE {every})
SELECT doc_id, round(sum({score}), 6) AS score FROM t GROUP BY doc_id"""


QUERIES = {
    "full_text": (full_text, _full_text([("source", 1.0), ("text", 0.4)], "The tioning of bles")),
    "full_text_plain": (full_text_plain, _full_text([("source || ' ' || text", 1.0)], "src8 the thered")),
    "formatted_times": (formatted_times, "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%A, %d %b %y at %I %p, day %j') AS long FROM events"),
    "uploads": (uploads, rf"WITH {UPLOADS} SELECT doc_id, fault, CASE WHEN fault IS NULL THEN translate(regexp_replace(name, '\.(md|MD)$', ''), '-_', '  ') END AS title FROM f"),
    "ingest_report": (ingest_report, f"WITH {UPLOADS} SELECT CASE WHEN fault IS NULL THEN 'ingested' WHEN fault IN ('Only .md files are accepted', 'File too large') THEN 'skipped' ELSE 'error' END AS status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1"),
    "scan_estimates": (scan_estimates, "SELECT doc_id, e AS extension, e IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'bmp') AS supported, (n_chars::BIGINT * 1024 // 1048576 + 1) * 1000 AS millis FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE lang END AS e FROM documents)"),
    "index_texts": (index_texts, r"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS title, regexp_replace(regexp_replace(text, '^[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ''), '[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+$', '') AS x FROM documents) SELECT doc_id, coalesce(title <> '' AND strlen(x) >= 10, false) AS indexable, CAST(strlen(title) + 2 + strlen(x) AS BIGINT) AS n_bytes FROM t"),
    "comments": (comments, r"SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(25, 101), lambda k: strlen(left(text, k)) <= 100))) END AS comment, regexp_matches(text, '[^ \t\n\x0B\f\r]') AS valid FROM documents"),
    "action_classes": (action_classes, "WITH a AS (SELECT CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'update' WHEN 'error' THEN 'login_failed' WHEN 'purchase' THEN 'create' WHEN 'signup' THEN 'login' ELSE event_type END AS action FROM events) SELECT action, count(*) AS n, action IN ('login_failed', 'login', 'logout') AS security, action IN ('create', 'update', 'delete', 'read', 'export') AS document FROM a GROUP BY action"),
    "suspicious_pages": (suspicious_pages, "SELECT page_id, concat_ws(',', " + ", ".join("CASE WHEN regexp_matches(lower(html), '{}') THEN '{}' END".format(p.replace("'", "''"), i) for i, p in enumerate(T.SUSPICIOUS)) + ") AS patterns FROM pages"),
    "skill_matches": (skill_matches, "SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN {name!r}" for name, words in SKILLS) + " END AS skill FROM documents"),
    "query_rewrites": (query_rewrites, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'how to fix ' || p_name || '|guide for fix ' || p_name || '|how to solve ' || p_name WHEN 1 THEN 'what is an error or ' || p_name || '|definition of an error or ' || p_name || '|what is an issue or ' || p_name WHEN 2 THEN 'create a issue with ' || p_name || '|make a problem with ' || p_name ELSE '' END AS queries FROM part"),
    "query_variants": (query_variants, VARIANTS),
    "document_contexts": (document_contexts, CONTEXTS),
    "graph_export": (graph_export, EXPORT),
    "semantic_chunks": (semantic_chunks, None),
}
