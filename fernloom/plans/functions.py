"""Queries of document functions, sources and sinks, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernloom.functions import calls as K
from fernloom.functions import documents as D
from fernloom.operators import ranking
from fernloom.sources import files
from fernloom.session import load
from fernloom.streaming import events as S

C = F.col


def template_expand(spark, d):
    t = F.lit("Dear {{name}}, your balance in {{segment}} is {{balance}} ({{nothing}}).")
    values = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("balance"), C("c_custkey").cast("string"))
    return load(spark, d, "customer").select("c_custkey", D.named(t, values).alias("text"), F.array_join(D.missing(t, values), ",").alias("missing"))


TEMPLATE = "SELECT c_custkey, 'Dear ' || c_name || ', your balance in ' || c_mktsegment || ' is ' || c_custkey || ' ([undefined: nothing]).' AS text, 'nothing' AS missing FROM customer"


def doc_functions(spark, d):
    args = F.concat_ws(",", C("o_orderkey").cast("string"), F.lit(" 2.5"), F.lit("x"), (C("o_custkey") * 2).cast("string"))
    rows = load(spark, d, "orders").withColumn("args", args)
    return rows.select("o_orderkey", *(D.called(n, C("args")).alias(f"f_{n}") for n in ("sum", "avg", "min", "max", "count", "upper", "lower", "len", "join", "split", "nope")), D.called("repeat", F.concat_ws(",", F.lit("ab"), (C("o_orderkey") % 4).cast("string"))).alias("f_repeat"), D.called("repeat", F.lit("ab,x")).alias("f_once"))


FUNCTIONS = """WITH a AS (SELECT o_orderkey, o_orderkey AS x, o_custkey * 2 AS y, o_orderkey || ', 2.5,x,' || (o_custkey * 2) AS args FROM orders)
SELECT o_orderkey, CAST(CAST(x + y + 2.5 AS DOUBLE) AS VARCHAR) AS f_sum, CAST(round(CAST(x + y + 2.5 AS DOUBLE) / 3, 6) AS VARCHAR) AS f_avg, lower(args) AS f_lower, x || ',  2.5, x, ' || y AS f_split, repeat('ab', x % 4) AS f_repeat, 'ab' AS f_once, CASE WHEN least(x, y) > 2.5 THEN '2.5' ELSE CAST(least(x, y) AS VARCHAR) END AS f_min, CAST(greatest(x, y, 3) AS VARCHAR) AS f_max, '4' AS f_count, upper(args) AS f_upper, CAST(strlen(args) AS VARCHAR) AS f_len, x || ', 2.5, x, ' || y AS f_join, '[unknown function: nope]' AS f_nope FROM a"""


def table_of_contents(spark, d):
    md = F.concat(F.lit("# Part "), C("p_brand"), F.lit("\ntext\n## "), C("p_name"), F.lit("\n"))
    return load(spark, d, "part").select("p_partkey", D.contents(md).alias("toc"))


TOC = "SELECT p_partkey, '- [Part ' || p_brand || '](#part-' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || ')' || chr(10) || '  - [' || trim(p_name) || '](#' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || ')' AS toc FROM part"


def answers(spark, d):
    """JSON answers with and without fences, title and confidence."""
    k = C("event_id")
    body = F.concat(F.lit('{"title": "t'), k.cast("string"), F.lit('", '), F.when(k % 3 == 0, "").otherwise('"summary": "s", '), F.lit('"topics": ["a", null], "confidence": '), (k % 5 - 1).cast("string"), F.lit("}"))
    text = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    a = D.answer(text)
    rows = load(spark, d, "events").select("event_id", a.alias("a"))
    return rows.select("event_id", "a.title", F.size("a.topics").alias("topics"), "a.confidence", D.extraction_status(C("a").isNull(), C("a.confidence")).alias("status"))


ANSWERS = "SELECT event_id, CASE WHEN ok THEN 't' || event_id END AS title, CASE WHEN ok THEN 1 END AS topics, CASE WHEN ok THEN c END AS confidence, CASE WHEN NOT ok THEN 'failed' WHEN c < 0.3 THEN 'skipped' ELSE 'completed' END AS status FROM (SELECT event_id, event_id % 3 <> 0 AS ok, CAST(least(1, greatest(0, event_id % 5 - 1)) AS DOUBLE) AS c FROM events)"


def sync_advice(spark, d):
    e = load(spark, d, "events").withColumn("file", C("ts") + F.make_dt_interval(secs=((C("event_id") % 7) - 3) * 40))
    return e.select("event_id", D.sync_advice(C("ts"), C("file"), C("event_id") % 11 == 0).alias("advice"), D.relative_time((C("event_id") * 97) % 200000).alias("age"))


SYNC = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no_change' WHEN abs((event_id % 7 - 3) * 40) < 60 THEN 'conflict' WHEN event_id % 7 > 3 THEN 'update_db' ELSE 'update_file' END AS advice,
CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' h' ELSE (s // 86400) || ' d' END AS age FROM (SELECT event_id, (event_id * 97) % 200000 AS s FROM events)"""


def export_roundtrip(spark, d):
    """Documents written as JSON and CSV and read again."""
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    a, b = files.scratch(spark), files.scratch(spark)
    files.write_export(docs, a, "json")
    files.write_export(docs, b, "csv")
    x = files.read_json(spark, a, "doc_id long, text string, lang string").where("_corrupt is null").drop("_corrupt")
    y = files.read_csv(spark, b, "doc_id long, text string, lang string").select("doc_id", C("text").alias("csv"))
    return x.join(y, "doc_id").select("doc_id", "lang", F.sha2("text", 256).alias("json_hash"), F.sha2("csv", 256).alias("csv_hash"))


def upsert(spark, d):
    """Newer rows win over stored ones of the same key; keys of one side stay."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("v"))
    new = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.lit(2).alias("v"))
    return ranking.latest_wins(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], "v")


UPSERT = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS v FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0"


def backup_names(spark, d):
    name = F.when(C("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_note_"), C("user_id").cast("string"), F.lit("_120000.md"))).when(C("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("_plan.md"))).otherwise("other.md")
    return load(spark, d, "events").select("event_id", files.backup_name(name).alias("b")).select("event_id", "b.date", "b.title")


BACKUP = "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END AS date, CASE event_id % 3 WHEN 0 THEN 'note_' || user_id WHEN 1 THEN 'plan' END AS title FROM events"


def stream_daily_counts(spark, d):
    return S.finished(S.daily_counts(S.read_events(spark, d))).drop("_batch")


def stream_sliding(spark, d):
    return S.finished(S.sliding_counts(S.read_events(spark, d))).drop("_batch")


def stream_sessions(spark, d):
    return S.finished(S.session_counts(S.read_events(spark, d))).drop("_batch")


STREAM_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""


def stream_distinct(spark, d):
    twice = S.read_events(spark, d)
    return S.finished(S.distinct_events(twice.union(twice))).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_rate_limit(spark, d):
    return S.finished(S.limited(S.read_events(spark, d))).drop("_batch")


def edit_fold(spark, d):
    """Each user's events as edits of one text, in order."""
    e = load(spark, d, "events").select(C("user_id").alias("doc"), C("event_id").alias("seq"), F.element_at(F.array(F.lit("insert"), F.lit("delete"), F.lit("replace")), (C("event_id") % 3 + 1).cast("int")).alias("op"), (C("event_id") % 10).cast("int").alias("at"), F.col("event_type").alias("text"))
    return S.folded_edits(e)


def queue_step(spark, d):
    q = load(spark, d, "events").select(C("event_id").alias("id"), (C("user_id") % 3).alias("priority"), (C("event_id") % 4).cast("int").alias("attempts"), F.lit("pending").alias("status"))
    done = load(spark, d, "events").where("event_id % 2 = 0").select(C("event_id").alias("id"), (C("event_id") % 3 == 0).alias("ok"))
    return S.queue_step(q, done)


QUEUE = "SELECT event_id AS id, user_id % 3 AS priority, CAST(event_id % 4 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts, CASE WHEN event_id % 2 = 1 THEN 'pending' WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status FROM events"

def document_calls(spark, d):
    """What looks like a call in the documents, with its place."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(K.calls(C("text"))).alias("place", "c")).select("doc_id", "place", "c.name", F.size("c.arguments").alias("n_arguments"), "c.start", "c.end", "c.raw")


def expanded_documents(spark, d):
    """Documents with a line of calls, expanded with stored and built-in functions and variables."""
    stored = spark.createDataFrame([("Greet", "old", 1), ("greet", "Hello {{1}} of {{0}} ({{args}}) {{2}}", 2), ("com", "commerce", 1)], "name string, template string, version int")
    line = F.concat(F.lit("\n.sum {"), C("doc_id").cast("string"), F.lit("} {2.5}{x}; .greet {"), C("source"), F.lit("}{"), C("lang"), F.lit("} .var { lang }.var {none} .upper {"), C("lang"), F.lit("} .if {x} .join {a, b,c}{-} .repeat {ab} {"), (C("doc_id") % 3).cast("string"), F.lit("} .split {1-2} {-}"))
    text = K.expand(F.concat(F.coalesce("text", F.lit("")), line), F.create_map(F.lit("lang"), "lang"), K.registry(stored))
    return load(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("hash"), F.substring_index(text, "\n", -1).alias("line"))


_CALL = r"\.([a-zA-Z_][a-zA-Z0-9_]*)(?:[ \t\n\x0B\f\r]*\{[^}]*\})*"
CALLS = rf"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '{_CALL}') AS raws, regexp_extract_all(text, '{_CALL}', 1) AS names, regexp_split_to_array(text, '{_CALL}') AS parts FROM documents),
e AS (SELECT doc_id, unnest(raws) AS raw, unnest(names) AS name, unnest(parts[1:len(raws)]) AS before, unnest(range(0, len(raws))) AS place FROM r),
p AS (SELECT *, sum(length(before) + length(raw)) OVER (PARTITION BY doc_id ORDER BY place) AS e FROM e)
SELECT doc_id, CAST(place AS INTEGER) AS place, name, CAST(len(regexp_extract_all(raw, '\{{[^}}]*\}}')) AS INTEGER) AS n_arguments, CAST(e - length(raw) AS INTEGER) AS start, CAST(e AS INTEGER) AS end, raw FROM p"""
EXPANDED = rf"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_CALL}', '[unknown function: \1]', 'g'), '\[unknown function: com\]', 'commerce', 'g') AS t,
  doc_id + 2 || '.5; Hello ' || lang || ' of ' || source || ' (' || source || ', ' || lang || ') {{{{2}}}} ' || lang || '[undefined: none] ' || upper(lang) || ' .if {{x}} a-b-c ' || repeat('ab', doc_id % 3) || ' 1, 2' AS line FROM documents)
SELECT doc_id, sha256(t || chr(10) || line) AS hash, line FROM x"""

QUERIES = {
    "document_calls": (document_calls, CALLS),
    "expanded_documents": (expanded_documents, EXPANDED),
    "template_expand": (template_expand, TEMPLATE),
    "doc_functions": (doc_functions, FUNCTIONS),
    "table_of_contents": (table_of_contents, TOC),
    "model_answers": (answers, ANSWERS),
    "sync_advice": (sync_advice, SYNC),
    "export_roundtrip": (export_roundtrip, "SELECT doc_id, lang, sha256(text) AS json_hash, sha256(text) AS csv_hash FROM documents"),
    "upsert": (upsert, UPSERT),
    "backup_names": (backup_names, BACKUP),
    "stream_daily_counts": (stream_daily_counts, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2"),
    "stream_sliding": (stream_sliding, "SELECT CAST(d AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([CAST(ts AS DATE), CAST(ts AS DATE) - 1]) AS d FROM events) WHERE d + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1"),
    "stream_sessions": (stream_sessions, STREAM_SESSIONS),
    "stream_distinct": (stream_distinct, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "stream_rate_limit": (stream_rate_limit, "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS allowed FROM events"),
    "edit_fold": (edit_fold, None),
    "queue_step": (queue_step, QUEUE),
}
