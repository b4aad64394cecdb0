"""Queries over the event log and the conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernloom.operators import predicates, timeline
from fernloom.session import load
from fernloom.streaming import events as S

AS_OF = "2024-01-31"


def daily_activity(spark, d):
    return timeline.daily_activity(load(spark, d, "events").where(predicates.in_window("ts", f"{AS_OF} 00:00:00", 30)), ["click", "view", "purchase"])


DAILY = f"""SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase
FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1"""


def monthly_histogram(spark, d):
    """Documents by month, the previous month, and growth in percent."""
    n = load(spark, d, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n"))
    return timeline.growth(n)


MONTHLY = """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY month) AS previous FROM m)
SELECT *, CASE WHEN previous > 0 THEN round((n - previous) * 100.0 / previous, 6) END AS growth FROM p"""


def heatmap(spark, d):
    return timeline.heatmap(load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("value")))


HEATMAP = "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS value FROM events GROUP BY 1) SELECT day, value, CAST(least(4, ceil(value / (SELECT max(value) FROM d) * 4)) AS INTEGER) AS level FROM d"


def streaks(spark, d):
    return timeline.streaks(load(spark, d, "events").select("user_id", F.to_date("ts").alias("day")), AS_OF)


STREAKS = f"""WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <= DATE '{AS_OF}' AND CAST(ts AS DATE) > DATE '{AS_OF}' - 365), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM a),
r AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM g GROUP BY 1, 2)
SELECT user_id, coalesce(max(n) FILTER (last >= DATE '{AS_OF}' - 1), 0) AS current, max(n) AS longest FROM r GROUP BY 1"""


def most_active_day(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1)


def contributors(spark, d):
    """Count and last time of each user's events of a kind."""
    return load(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def security_report(spark, d):
    """Events by kind and severity in a window, and the users with most of them."""
    e = load(spark, d, "events").where(predicates.in_window("ts", f"{AS_OF} 00:00:00", 7))
    severe = F.when(F.col("value") > 75, "high").when(F.col("value") > 50, "medium").otherwise("low")
    return e.groupBy("event_type", severe.alias("severity")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


SECURITY = f"""SELECT event_type, CASE WHEN value > 75 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2"""


def json_predicate(spark, d):
    """Events whose properties have a key with a value above a bound."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return load(spark, d, "events").where(k.isNotNull()).groupBy((F.floor(k / 10) * 10).cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


JSON = "SELECT CAST(floor(k / 10) * 10 AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events) WHERE k IS NOT NULL GROUP BY 1"


def sessions(spark, d):
    """Runs of a user's events with less than thirty minutes between them."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp")) >= 30 * 60 * 1_000_000).cast("int"), F.lit(1))
    e = load(spark, d, "events").withColumn("new", gap).withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS begin, max(ts) AS end FROM s GROUP BY 1, 2"""


def sliding_rate_limit(spark, d):
    """Events that a limit of three accepted ones a user within a day rejects."""
    return S.sliding_limited(load(spark, d, "events"), 3, 86_400).where("not accepted").select("event_id", "user_id")


_ORDERED = "o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
SLIDING = f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, i, event_id, ts AS a, CAST(NULL AS TIMESTAMP) AS b, CAST(NULL AS TIMESTAMP) AS c, true AS ok FROM o WHERE i = 1 UNION ALL
SELECT o.user_id, o.i, o.event_id, CASE WHEN k THEN o.ts ELSE r.a END, CASE WHEN k THEN r.a ELSE r.b END, CASE WHEN k THEN r.b ELSE r.c END, k FROM r JOIN (SELECT * FROM o) o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT r.c IS NULL OR o.ts - r.c >= INTERVAL 1 DAY AS k))
SELECT event_id, user_id FROM r WHERE NOT ok"""


def fixed_rate_limit(spark, d):
    """Events beyond the third of a user and calendar day."""
    by = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return load(spark, d, "events").withColumn("place", F.row_number().over(by)).where("place > 3").select("event_id", F.col("place").cast("long").alias("place"))


def lock_out(spark, d):
    """Times until which each failure locks the account: from the fifth since the last success on, fifteen minutes. Errors are failures, purchases successes."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").where("event_type in ('error', 'purchase')").withColumn("run", F.count_if(F.col("event_type") == "purchase").over(by))
    n = F.count_if(F.col("event_type") == "error").over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    return e.withColumn("failures", n).where("event_type = 'error' and failures >= 5").select("event_id", "user_id", "failures", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("locked_until"))


LOCK = """WITH e AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events WHERE event_type IN ('error', 'purchase')),
n AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM e)
SELECT event_id, user_id, failures, ts + INTERVAL 15 MINUTE AS locked_until FROM n WHERE event_type = 'error' AND failures >= 5"""


def debounced(spark, d):
    """A user's events that come at least an hour after the last accepted one."""
    return S.throttled(load(spark, d, "events"), 3600).where("accepted").select("event_id")


DEBOUNCED = f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, i, event_id, ts AS last, true AS ok FROM o WHERE i = 1 UNION ALL
SELECT o.user_id, o.i, o.event_id, CASE WHEN o.ts >= r.last + INTERVAL 1 HOUR THEN o.ts ELSE r.last END, o.ts >= r.last + INTERVAL 1 HOUR FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT event_id FROM r WHERE ok"""


def expired(spark, d):
    """Entries older than their time to live: 20 days for signups, 7 for others."""
    ttl = F.when(F.col("event_type") == "signup", F.expr("INTERVAL 20 DAYS")).otherwise(F.expr("INTERVAL 7 DAYS"))
    return load(spark, d, "events").where(F.col("ts") + ttl < F.to_timestamp_ntz(F.lit(AS_OF))).groupBy("event_type").agg(F.count("*").alias("n"))


EXPIRED = f"SELECT event_type, count(*) AS n FROM events WHERE ts + CASE WHEN event_type = 'signup' THEN INTERVAL 20 DAY ELSE INTERVAL 7 DAY END < TIMESTAMP '{AS_OF}' GROUP BY 1"


def durations(spark, d):
    """Seconds from the first to the last event of each user and day."""
    e = load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return e.select("user_id", "day", "n", F.round((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6, 3).alias("seconds"))


def presence(spark, d):
    """The last state of each user: the last writer wins."""
    return load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("seen"))


PRESENCE = "SELECT user_id, event_type AS state, ts AS seen FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def retention_thirds(spark, d):
    """Mean value of each user's first and last third of events."""
    by = Window.partitionBy("user_id")
    e = load(spark, d, "events").withColumn("i", F.row_number().over(by.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(by)).where("n >= 3")
    third = F.floor(F.col("n") / 3)
    return e.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("i") <= third, F.col("value"))), 6).alias("early"), F.round(F.avg(F.when(F.col("i") > F.col("n") - third, F.col("value"))), 6).alias("late"))


THIRDS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(avg(value) FILTER (i <= n // 3), 6) AS early, round(avg(value) FILTER (i > n - n // 3), 6) AS late FROM e WHERE n >= 3 GROUP BY 1"""


def conversation_stats(spark, d):
    """Messages, speakers and mean bytes of each conversation."""
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_distinct("role").alias("users"), F.round(F.avg(F.octet_length("text")), 6).alias("mean_bytes"))


def thread_worth(spark, d):
    """Threads with at least three messages, 500 bytes and two speakers."""
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("role").alias("users"))
    return c.where("n >= 3 and bytes >= 500 and users >= 2").select("conv_id", "n", "bytes")


def conversation_prompt(spark, d):
    """A thread as lines `[name]: text` in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("]: "), "text").alias("line"))))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("prompt"))


def message_filter(spark, d):
    """The first fifty messages of a speaker in order."""
    return load(spark, d, "conversations").where("role = 'user'").orderBy("conv_id", "turn").limit(50).select("conv_id", "turn")


def notification_digest(spark, d):
    """Users with five or more events of a kind get one digest with a title of the right number, others single ones."""
    n = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    title = F.concat(F.col("n").cast("string"), F.lit(" new "), F.col("event_type"), F.when(F.col("n") == 1, "").otherwise("s"))
    return n.select("user_id", "event_type", title.alias("title"), (F.col("n") >= 5).alias("digest"))


QUERIES = {
    "daily_activity": (daily_activity, DAILY),
    "monthly_histogram": (monthly_histogram, MONTHLY),
    "activity_heatmap": (heatmap, HEATMAP),
    "activity_streaks": (streaks, STREAKS),
    "most_active_day": (most_active_day, "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 1"),
    "contributors": (contributors, "SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1"),
    "security_report": (security_report, SECURITY),
    "json_predicate": (json_predicate, JSON),
    "event_sessions": (sessions, SESSIONS),
    "sliding_rate_limit": (sliding_rate_limit, SLIDING),
    "fixed_rate_limit": (fixed_rate_limit, "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events QUALIFY place > 3"),
    "account_lock_out": (lock_out, LOCK),
    "debounced_events": (debounced, DEBOUNCED),
    "expired_entries": (expired, EXPIRED),
    "durations": (durations, "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY 1, 2"),
    "presence": (presence, PRESENCE),
    "early_late_thirds": (retention_thirds, THIRDS),
    "conversation_stats": (conversation_stats, "SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS users, round(avg(strlen(text)), 6) AS mean_bytes FROM conversations GROUP BY 1"),
    "thread_worth": (thread_worth, "SELECT conv_id, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY 1 HAVING count(*) >= 3 AND sum(strlen(text)) >= 500 AND count(DISTINCT role) >= 2"),
    "conversation_prompt": (conversation_prompt, "SELECT conv_id, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1"),
    "message_filter": (message_filter, "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 50"),
    "notification_digest": (notification_digest, "SELECT user_id, event_type, n || ' new ' || event_type || CASE WHEN n = 1 THEN '' ELSE 's' END AS title, n >= 5 AS digest FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)"),
}
