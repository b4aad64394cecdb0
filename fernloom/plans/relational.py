"""Queries of the knowledge base's dashboards, lists and reports over the star tables.

Customers are users, orders are documents, line items their child rows (comments,
versions), parts tags by brand, nations and regions two levels of categories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernloom.operators import hierarchy, predicates, ranking
from fernloom.session import load

AS_OF = "1998-08-01"


def overview(spark, d):
    """Totals and those of the last 365 days."""
    orders, customer, lineitem = load(spark, d, "orders", "customer", "lineitem")
    recent = predicates.in_window("o_orderdate", AS_OF, 365)
    o = orders.agg(F.count("*").alias("documents"), F.count_if(recent).alias("recent"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count_distinct("o_custkey").alias("owners"))
    return o.join(F.broadcast(customer.agg(F.count("*").alias("users")))).join(F.broadcast(lineitem.agg(F.count("*").alias("comments"))))


OVERVIEW = f"""SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND o_orderdate <= TIMESTAMP '{AS_OF}') AS recent,
round((SELECT sum(o_totalprice) FROM orders), 2) AS total, round((SELECT avg(o_totalprice) FROM orders), 4) AS mean, (SELECT count(DISTINCT o_custkey) FROM orders) AS owners, (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM lineitem) AS comments"""


def active_users_union(spark, d):
    """Distinct users who wrote a document or had an event."""
    orders, events = load(spark, d, "orders", "events")
    return orders.select(F.col("o_custkey").alias("u")).union(events.select("user_id")).distinct().agg(F.count("*").alias("active_users"))


def authors_and_actors(spark, d):
    """Users who did both."""
    orders, events = load(spark, d, "orders", "events")
    return orders.select(F.col("o_custkey").alias("user_id")).intersect(events.select("user_id"))


def top_documents(spark, d):
    """Engagement: quantity + 5 * comments + 3 * distinct tags, best 20."""
    orders, lineitem = load(spark, d, "orders", "lineitem")
    child = lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("views"), F.count("*").alias("comments"), F.count_distinct("l_partkey").alias("versions"))
    score = F.coalesce("views", F.lit(0.0)) + 5 * F.coalesce("comments", F.lit(0)) + 3 * F.coalesce("versions", F.lit(0))
    return orders.join(child, orders["o_orderkey"] == child["l_orderkey"], "left").select("o_orderkey", F.round(score, 2).alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(20)


TOP_DOCUMENTS = """WITH c AS (SELECT l_orderkey, sum(l_quantity) v, count(*) n, count(DISTINCT l_partkey) p FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(coalesce(v, 0) + 5 * coalesce(n, 0) + 3 * coalesce(p, 0), 2) AS score FROM orders LEFT JOIN c ON l_orderkey = o_orderkey ORDER BY score DESC, o_orderkey LIMIT 20"""


def active_users_score(spark, d):
    """10 * documents + 5 * comments + 3 * edits; children are counted before they are joined, so counts don't multiply."""
    customer, orders, lineitem = load(spark, d, "customer", "orders", "lineitem")
    comments = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("e"))
    docs = orders.join(comments, orders["o_orderkey"] == comments["l_orderkey"], "left").groupBy("o_custkey").agg(F.count("*").alias("docs"), F.coalesce(F.sum("c"), F.lit(0)).alias("comments"), F.coalesce(F.sum("e"), F.lit(0)).alias("edits"))
    score = 10 * F.coalesce("docs", F.lit(0)) + 5 * F.coalesce("comments", F.lit(0)) + 3 * F.coalesce("edits", F.lit(0))
    return customer.join(docs, customer["c_custkey"] == docs["o_custkey"], "left").select("c_custkey", F.coalesce("docs", F.lit(0)).alias("docs"), score.alias("score")).orderBy(F.desc("score"), "c_custkey").limit(20)


ACTIVE_USERS_SCORE = """WITH c AS (SELECT l_orderkey, count(*) c, count(*) FILTER (l_returnflag = 'R') e FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, count(*) docs, coalesce(sum(c), 0) c, coalesce(sum(e), 0) e FROM orders LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(docs, 0) AS docs, CAST(10 * coalesce(docs, 0) + 5 * coalesce(c, 0) + 3 * coalesce(e, 0) AS BIGINT) AS score FROM customer LEFT JOIN o ON o_custkey = c_custkey ORDER BY score DESC, c_custkey LIMIT 20"""


def category_stats(spark, d):
    """Users of every category, zeros kept."""
    nation, customer = load(spark, d, "nation", "customer")
    return nation.join(customer, nation["n_nationkey"] == customer["c_nationkey"], "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("balance"))


def _nodes(spark, d) -> DataFrame:
    """Regions as roots (ids from 1000 on), nations below."""
    region, nation = load(spark, d, "region", "nation")
    roots = region.select((F.col("r_regionkey") + 1000).cast("int").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    return roots.unionByName(nation.select(F.col("n_nationkey").cast("int").alias("id"), (F.col("n_regionkey") + 1000).cast("int").alias("parent"), F.col("n_name").alias("name")))


NODES = "nodes AS (SELECT r_regionkey + 1000 AS id, NULL::INTEGER AS parent, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_regionkey + 1000, n_name FROM nation)"


def category_tree_counts(spark, d):
    facts = load(spark, d, "customer").select(F.col("c_nationkey").alias("id"))
    return hierarchy.subtree_counts(_nodes(spark, d), facts)


CATEGORY_TREE_COUNTS = f"""WITH RECURSIVE {NODES}, t AS (SELECT id AS root, id FROM nodes UNION ALL SELECT t.root, n.id FROM t JOIN nodes n ON n.parent = t.id), c AS (SELECT c_nationkey AS id, count(*) n FROM customer GROUP BY 1)
SELECT root AS id, CAST(coalesce(any_value(own.n), 0) AS BIGINT) AS direct, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total FROM t LEFT JOIN c ON c.id = t.id LEFT JOIN c own ON own.id = t.root GROUP BY root"""


def category_paths(spark, d):
    """Descendants with level and path."""
    return hierarchy.descendants(_nodes(spark, d))


CATEGORY_PATHS = f"""WITH RECURSIVE {NODES}, t AS (SELECT id AS root, id, 0 AS level, name AS path FROM nodes UNION ALL SELECT t.root, n.id, t.level + 1, t.path || ' > ' || n.name FROM t JOIN nodes n ON n.parent = t.id) SELECT * FROM t"""


def category_ancestors(spark, d):
    return hierarchy.ancestors(_nodes(spark, d))


CATEGORY_ANCESTORS = f"""WITH RECURSIVE {NODES}, t AS (SELECT id, id AS ancestor, parent, 0 AS distance FROM nodes UNION ALL SELECT t.id, n.id, n.parent, distance + 1 FROM t JOIN nodes n ON n.id = t.parent) SELECT id, ancestor, distance FROM t"""


def category_nested(spark, d):
    """Roots with their children's names in one text."""
    return hierarchy.nested(_nodes(spark, d)).select("id", "name", F.array_join(F.transform("children", lambda c: c["name"]), ";").alias("children"))


def category_reparent(spark, d):
    """The tree after two regions are gone: their nations hang at the root."""
    return hierarchy.reparent(_nodes(spark, d), [1000, 1001])


def category_rollup(spark, d):
    """Documents by year, month and day, with the totals of each level."""
    orders = load(spark, d, "orders").where(predicates.in_date("o_orderdate", "1997"))
    y, m, dd = F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.dayofmonth("o_orderdate").cast("long").alias("d")
    return orders.rollup(y, m, dd).agg(F.count("*").alias("n"))


def tag_stats(spark, d):
    """Totals and the ten most used tags."""
    part, lineitem = load(spark, d, "part", "lineitem")
    used = lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    tags = part.join(used, part["p_partkey"] == used["l_partkey"], "left").groupBy("p_brand").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uses"))
    total = tags.agg(F.count("*").alias("tags"), F.sum("uses").alias("all_uses"))
    return tags.orderBy(F.desc("uses"), "p_brand").limit(10).join(F.broadcast(total))


TAG_STATS = """WITH t AS (SELECT p_brand, CAST(count(l_partkey) AS BIGINT) AS uses FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT *, (SELECT count(*) FROM t) AS tags, CAST((SELECT sum(uses) FROM t) AS BIGINT) AS all_uses FROM t ORDER BY uses DESC, p_brand LIMIT 10"""


def tag_usage_buckets(spark, d):
    """Tags by how much they are used."""
    part, lineitem = load(spark, d, "part", "lineitem")
    used = lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    bucket = F.when(n == 0, "unused").when(n <= 5, "low").when(n <= 20, "medium").otherwise("high")
    return part.join(used, part["p_partkey"] == used["l_partkey"], "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("tags"))


def tag_lists(spark, d):
    """Each recent document's tags in order, documents without any too."""
    orders, lineitem, part = load(spark, d, "orders", "lineitem", "part")
    recent = orders.where(predicates.in_date("o_orderdate", "1998")).select("o_orderkey")
    tags = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"]).select("l_orderkey", "p_brand")
    lists = recent.join(tags, recent["o_orderkey"] == tags["l_orderkey"], "left").groupBy("o_orderkey").agg(F.sort_array(F.collect_set("p_brand")).alias("tags"))
    return lists.select("o_orderkey", F.array_join("tags", ";").alias("tags"), F.size("tags").cast("long").alias("n"))


TAG_LISTS = """SELECT o_orderkey, coalesce(string_agg(DISTINCT p_brand, ';' ORDER BY p_brand), '') AS tags, count(DISTINCT p_brand) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1"""


def contains_all_tags(spark, d):
    """Documents that have both of two tags."""
    lineitem, part = load(spark, d, "lineitem", "part")
    brands = part.select("p_partkey", F.substring("p_brand", 1, 7).alias("tag"))
    return predicates.with_all(lineitem.join(brands, lineitem["l_partkey"] == brands["p_partkey"]), "l_orderkey", "tag", ["Brand#1", "Brand#2"])


CONTAINS_ALL_TAGS = """SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE substr(p_brand, 1, 7) IN ('Brand#1', 'Brand#2') GROUP BY 1 HAVING count(DISTINCT substr(p_brand, 1, 7)) = 2"""


def workflow_analytics(spark, d):
    """Documents by status, and the rate of completed ones."""
    orders = load(spark, d, "orders")
    total = Window.partitionBy(F.lit(0))
    by = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return by.select("o_orderstatus", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(total), 6).alias("rate"))


def overdue(spark, d):
    """Open documents of before the date, by priority."""
    orders = load(spark, d, "orders")
    late = orders.where(~F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1996-01-01"))))
    return late.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def assigned_sorted(spark, d):
    """Documents by priority, then date with missing ones last; the first page of ten."""
    orders = load(spark, d, "orders")
    due = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    rows = orders.withColumn("due", due)
    return rows.orderBy("o_orderpriority", F.asc_nulls_last("due"), "o_orderkey").limit(10).select("o_orderkey", "o_orderpriority", "due")


ASSIGNED_SORTED = """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS due FROM orders ORDER BY o_orderpriority, due NULLS LAST, o_orderkey LIMIT 10"""


def untagged(spark, d):
    """Tags that no document has (anti join)."""
    part, lineitem = load(spark, d, "part", "lineitem")
    return part.join(lineitem.where("l_quantity > 40"), part["p_partkey"] == lineitem["l_partkey"], "left_anti").select("p_partkey")


def accessible(spark, d):
    """Users with a document of high value (semi join)."""
    customer, orders = load(spark, d, "customer", "orders")
    return customer.join(orders.where("o_totalprice > 300000"), customer["c_custkey"] == orders["o_custkey"], "left_semi").select("c_custkey", "c_name")


def orphans(spark, d):
    """Foreign keys without a row, counted by relation."""
    customer, orders, lineitem = load(spark, d, "customer", "orders", "lineitem")
    a = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"], "left_anti").agg(F.lit("lineitem.order").alias("relation"), F.count("*").alias("n"))
    b = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left_anti").agg(F.lit("orders.customer").alias("relation"), F.count("*").alias("n"))
    return a.unionByName(b)


ORPHANS = """SELECT 'lineitem.order' AS relation, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"""


def sync_report(spark, d):
    """Full outer diff of two key sets: tracked, orphan, untracked."""
    orders, lineitem = load(spark, d, "orders", "lineitem")
    disk = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("a"))
    known = lineitem.where("l_linenumber = 2").select(F.col("l_orderkey").alias("b")).distinct()
    state = F.when(F.col("a").isNull(), "orphan").when(F.col("b").isNull(), "untracked").otherwise("tracked")
    return disk.join(known, F.col("a") == F.col("b"), "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


SYNC_REPORT = """SELECT CASE WHEN a IS NULL THEN 'orphan' WHEN b IS NULL THEN 'untracked' ELSE 'tracked' END AS state, count(*) AS n
FROM (SELECT o_orderkey AS a FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem WHERE l_linenumber = 2) ON a = b GROUP BY 1"""


def visible_page(spark, d):
    """The second page of what a user may read, with totals."""
    orders = load(spark, d, "orders").withColumn("is_public", F.col("o_orderstatus") == "P")
    rows = predicates.visible_to(orders, 7, "o_custkey")
    return ranking.page(rows.select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], 2, 20)


VISIBLE_PAGE = """WITH v AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P'), t AS (SELECT count(*) AS total FROM v)
SELECT o_orderkey, o_custkey, total, CAST(ceil(total / 20) AS BIGINT) AS pages, 40 < total AS has_next FROM v, t ORDER BY o_orderkey LIMIT 20 OFFSET 20"""


def optional_filter(spark, d):
    """Optional parameters: status given, priority not, dates given."""
    orders = load(spark, d, "orders")
    rows = predicates.optional_equals(orders, o_orderstatus="O", o_orderpriority=None)
    return rows.where(predicates.in_window("o_orderdate", AS_OF, 30)).select("o_orderkey", "o_orderdate")


def like_filters(spark, d):
    """Contains in any case, prefix, and any of several tokens."""
    part = load(spark, d, "part")
    return part.where(predicates.contains_ci("p_type", "steel") | F.col("p_brand").startswith("Brand#1") | predicates.contains_any("p_name", ["green", "blue"])).select("p_partkey")


LIKE_FILTERS = "SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%' OR starts_with(p_brand, 'Brand#1') OR p_name ILIKE '%green%' OR p_name ILIKE '%blue%'"


def folded_tags(spark, d):
    """Names merged in any case, the least spelling wins, sorted by folded name."""
    part = load(spark, d, "part")
    spell = part.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("tag"))
    return spell.groupBy(F.lower("tag").alias("folded")).agg(F.min("tag").alias("tag"), F.count("*").alias("n"))


FOLDED_TAGS = "SELECT lower(t) AS folded, min(t) AS tag, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS t FROM part) GROUP BY 1"


def latest_version(spark, d):
    """The newest version of each document."""
    lineitem = load(spark, d, "lineitem")
    return ranking.newest(lineitem, ["l_orderkey"], [F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_quantity"), F.desc("l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey")


LATEST_VERSION = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1"


def versions_beyond_newest(spark, d):
    """Retention: how many versions of each document are older than its newest two."""
    lineitem = load(spark, d, "lineitem")
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), F.desc("l_partkey"))
    return lineitem.withColumn("r", F.row_number().over(by)).where("r > 2").groupBy("l_orderkey").agg(F.count("*").alias("old"))


VERSIONS_BEYOND = "SELECT l_orderkey, count(*) - 2 AS old FROM lineitem GROUP BY 1 HAVING count(*) > 2"


def previous_version(spark, d):
    """Each version's number, the one before, and whether it is a snapshot (every tenth)."""
    c = load(spark, d, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.lag("turn").over(by).alias("previous"), (F.row_number().over(by) % 10 == 0).alias("snapshot"))


PREVIOUS_VERSION = "SELECT conv_id, turn, lag(turn) OVER w AS previous, row_number() OVER w % 10 = 0 AS snapshot FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def next_version(spark, d):
    """The number a new version gets: 1 where there is none."""
    orders, lineitem = load(spark, d, "orders", "lineitem")
    top = lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    return orders.join(top, orders["o_orderkey"] == top["l_orderkey"], "left").select("o_orderkey", (F.coalesce("m", F.lit(0)) + 1).cast("int").alias("next"))


NEXT_VERSION = "SELECT o_orderkey, CAST(coalesce(max(l_linenumber), 0) + 1 AS INTEGER) AS next FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


def queue_position(spark, d):
    """Pending documents by priority and age: each one's place in the queue, by sorting once."""
    orders = load(spark, d, "orders").where("o_orderstatus = 'P'")
    return ranking.placed(orders.select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority", F.trunc("o_orderdate", "month")], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "place")


QUEUE_POSITION = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'"


def version_stats(spark, d):
    """Mean, population deviation and greatest of the documents' version counts."""
    n = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("deviation"), F.max("n").alias("most"), F.percentile("n", 0.5).alias("median"))


def facets(spark, d):
    """The twenty categories and the fifty tags that most hits have."""
    hits, nation, orders, lineitem, part = load(spark, d, "customer", "nation", "orders", "lineitem", "part")
    cats = hits.join(nation, hits["c_nationkey"] == nation["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("n")).select(F.lit("category").alias("facet"), F.col("n_name").alias("term"), "n")
    tags = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n")).select(F.lit("tag").alias("facet"), F.col("p_brand").alias("term"), "n")
    return cats.orderBy(F.desc("n"), "term").limit(20).unionByName(tags.orderBy(F.desc("n"), "term").limit(50))


FACETS = """(SELECT 'category' AS facet, n_name AS term, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 ORDER BY n DESC, term LIMIT 20)
UNION ALL (SELECT 'tag', p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2 ORDER BY n DESC, p_brand LIMIT 50)"""


def ratings(spark, d):
    """Mean of two decimals, count and histogram of ratings by language."""
    labels, docs = load(spark, d, "labels", "documents")
    r = labels.withColumn("rating", 1 + 2 * F.col("quality") + F.col("toxic"))
    return r.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.round(F.avg("rating"), 2).alias("mean"), F.count("*").alias("n"), *(F.count_if(F.col("rating") == i).alias(f"r{i}") for i in range(1, 6)))


RATINGS = "SELECT lang, round(avg(r), 2) AS mean, count(*) AS n, " + ", ".join(f"count(*) FILTER (r = {i}) AS r{i}" for i in range(1, 6)) + " FROM (SELECT lang, 1 + 2 * quality + toxic AS r FROM labels JOIN documents USING (doc_id)) GROUP BY lang"


def storage_totals(spark, d):
    """Bytes by owner: UTF-8 length of texts."""
    return load(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))


#: Rows that a task gets where they are dealt out by number.
TASK_ROWS = 1 << 20


def _dealt(df, rows: int, *keys: str):
    """df by keys in so many partitions that a task's share doesn't grow with the rows; partitions by number aren't joined again, however few bytes they have."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS), *keys)


def expertise(spark, d):
    """Distinct documents by user and tag with a level; the three best tags of a user and how many share them."""
    orders, lineitem, part = load(spark, d, "orders", "lineitem", "part")
    rows = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).join(part, lineitem["l_partkey"] == part["p_partkey"])
    n = _dealt(rows.select("o_custkey", "p_brand", "o_orderkey"), lineitem.count(), "o_custkey", "p_brand").groupBy("o_custkey", "p_brand").agg(F.count_distinct("o_orderkey").alias("n"))
    shared = n.groupBy("p_brand").agg(F.count("*").alias("users"))
    level = F.when(F.col("n") >= 10, "expert").when(F.col("n") >= 5, "advanced").when(F.col("n") >= 2, "intermediate").otherwise("beginner")
    best = ranking.newest(n.withColumn("level", level), ["o_custkey"], [F.desc("n"), F.col("p_brand")], 3)
    return best.join(shared, "p_brand")


EXPERTISE = """WITH n AS (SELECT o_custkey, p_brand, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
s AS (SELECT p_brand, count(*) AS users FROM n GROUP BY 1)
SELECT n.*, CASE WHEN n >= 10 THEN 'expert' WHEN n >= 5 THEN 'advanced' WHEN n >= 2 THEN 'intermediate' ELSE 'beginner' END AS level, users FROM n JOIN s USING (p_brand) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_brand) <= 3"""


def transitions(spark, d):
    """Which pairs of a document's following states the workflow allows."""
    states = F.element_at(F.array(*(F.lit(s) for s in predicates.TRANSITIONS)), (F.col("value").cast("int") % 7 + 1).cast("int"))
    e = load(spark, d, "events").select("user_id", "ts", "event_id", states.alias("state"))
    pairs = e.withColumn("old", F.lag("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("old is not null")
    return pairs.groupBy("old", "state", predicates.transition_allowed(F.col("old"), F.col("state")).alias("allowed")).agg(F.count("*").alias("n"))


TRANSITIONS = (
    "WITH t AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, bs in predicates.TRANSITIONS.items() for b in bs)
    + ") x(old, state)), e AS (SELECT user_id, ts, event_id, ["
    + ", ".join(f"'{s}'" for s in predicates.TRANSITIONS)
    + "][CAST(trunc(value) AS INTEGER) % 7 + 1] AS state FROM events), p AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, state FROM e) "
    "SELECT p.old, p.state, t.old IS NOT NULL AS allowed, count(*) AS n FROM p LEFT JOIN t ON t.old = p.old AND t.state = p.state WHERE p.old IS NOT NULL GROUP BY ALL"
)


def first_reviewer(spark, d):
    """For each document the first active one of its reviewers in order of preference."""
    lineitem, supplier = load(spark, d, "lineitem", "supplier")
    active = supplier.where("s_acctbal > 0").select("s_suppkey")
    prefer = lineitem.select("l_orderkey", "l_suppkey", "l_linenumber").join(active, F.col("l_suppkey") == F.col("s_suppkey"))
    return prefer.groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("reviewer"))


FIRST_REVIEWER = "SELECT l_orderkey, l_suppkey AS reviewer FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) = 1"

def best_annotation(spark, d):
    """The path of each document's annotation of the highest priority, or one made of its key."""
    orders, lineitem = load(spark, d, "orders", "lineitem")
    best = lineitem.groupBy("l_orderkey").agg(F.max_by(F.concat(F.lit("notes/"), F.col("l_partkey").cast("string")), F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"))).alias("path"))
    return orders.join(best, orders["o_orderkey"] == best["l_orderkey"], "left").select("o_orderkey", F.coalesce("path", F.concat(F.lit("doc://"), F.col("o_orderkey").cast("string"))).alias("path"))


BEST_ANNOTATION = """SELECT o_orderkey, coalesce(path, 'doc://' || o_orderkey) AS path FROM orders LEFT JOIN
(SELECT l_orderkey, 'notes/' || l_partkey AS path FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) = 1) ON l_orderkey = o_orderkey"""

#: Sort orders by name: each takes whether it falls.
SORTS = {
    "created": lambda falls: F.desc_nulls_last("o_orderdate") if falls else F.asc_nulls_last("o_orderdate"),
    "views": lambda falls: F.desc_nulls_last("o_totalprice") if falls else F.asc_nulls_last("o_totalprice"),
    "title": lambda falls: F.desc_nulls_last(F.lower("o_orderpriority")) if falls else F.asc_nulls_last(F.lower("o_orderpriority")),
}


def sorted_by(spark, d):
    """The first pages of five by each sort order, both ways."""
    orders = load(spark, d, "orders")
    pages = [orders.orderBy(order(falls), "o_orderkey").limit(5).select(F.lit(name).alias("by"), F.lit(falls).alias("falls"), "o_orderkey") for name, order in SORTS.items() for falls in (False, True)]
    return reduce(lambda x, y: x.union(y), pages)


SORTED_BY = " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS by, {'true' if f else 'false'} AS falls, o_orderkey FROM orders ORDER BY {c}{' DESC' if f else ''} NULLS LAST, o_orderkey LIMIT 5)" for n, c in (("created", "o_orderdate"), ("views", "o_totalprice"), ("title", "lower(o_orderpriority)")) for f in (False, True))


def root_folders(spark, d):
    """Folders that lie in no other listed folder: an anti join on all their parents."""
    path = F.parse_url("url", F.lit("PATH"))
    roots = load(spark, d, "pages").select(F.regexp_replace(path, "/+$", "").alias("path")).where("path <> ''").distinct()
    n = F.size(F.split("path", "/"))
    above = roots.select("path", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).select("path", F.expr("substring_index(path, '/', i)").alias("parent"))
    nested = above.join(roots.select(F.col("path").alias("parent")), "parent", "left_semi").select("path").distinct()
    return roots.join(nested, "path", "left_anti").select("path", n.cast("long").alias("depth"))


ROOT_FOLDERS = r"""WITH r AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT path, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM r WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM r x WHERE x.path <> '' AND starts_with(r.path, x.path || '/'))"""


def trend_summary(spark, d):
    """Documents of the last seven and thirty days up to a date, the five authors with most, and the day with most."""
    orders = load(spark, d, "orders").where("o_orderdate <= timestamp_ntz'1998-08-02 00:00:00'")
    since = lambda n: F.count_if(F.col("o_orderdate") > F.expr(f"timestamp_ntz'1998-08-02 00:00:00' - interval {n} days"))
    counts = orders.agg(F.count("*").alias("n"), since(7).alias("last_7"), since(30).alias("last_30"))
    authors = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(5)
    authors = authors.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "o_custkey"))), lambda s: s["o_custkey"].cast("string")), ",").alias("authors"))
    peak = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("m")).agg(F.max_by("day", F.struct("m", -F.unix_date("day"))).alias("peak"))
    return counts.crossJoin(authors).crossJoin(peak)  # one row each


TREND = """WITH o AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1998-08-02'), a AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5), p AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, day LIMIT 1)
SELECT count(*) AS n, count(*) FILTER (o_orderdate > TIMESTAMP '1998-08-02' - INTERVAL 7 DAY) AS last_7, count(*) FILTER (o_orderdate > TIMESTAMP '1998-08-02' - INTERVAL 30 DAY) AS last_30,
(SELECT string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY n DESC, o_custkey) FROM a) AS authors, (SELECT day FROM p) AS peak FROM o"""

QUERIES = {
    "best_annotation": (best_annotation, BEST_ANNOTATION),
    "sorted_by": (sorted_by, SORTED_BY),
    "root_folders": (root_folders, ROOT_FOLDERS),
    "trend_summary": (trend_summary, TREND),
    "overview": (overview, OVERVIEW),
    "active_users_union": (active_users_union, "SELECT count(*) AS active_users FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events)"),
    "authors_and_actors": (authors_and_actors, "SELECT o_custkey AS user_id FROM orders INTERSECT SELECT user_id FROM events"),
    "top_documents": (top_documents, TOP_DOCUMENTS),
    "active_users_score": (active_users_score, ACTIVE_USERS_SCORE),
    "category_stats": (category_stats, "SELECT n_name, count(c_custkey) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "category_tree_counts": (category_tree_counts, CATEGORY_TREE_COUNTS),
    "category_paths": (category_paths, CATEGORY_PATHS),
    "category_ancestors": (category_ancestors, CATEGORY_ANCESTORS),
    "category_nested": (category_nested, "SELECT r_regionkey + 1000 AS id, r_name AS name, coalesce(string_agg(n_name, ';' ORDER BY n_name), '') AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "category_reparent": (category_reparent, f"WITH {NODES} SELECT id, CASE WHEN parent IN (1000, 1001) THEN NULL ELSE parent END AS parent, name FROM nodes WHERE id NOT IN (1000, 1001)"),
    "category_rollup": (category_rollup, "SELECT y, m, d, count(*) AS n FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders WHERE year(o_orderdate) = 1997) GROUP BY ROLLUP (y, m, d)"),
    "tag_stats": (tag_stats, TAG_STATS),
    "tag_usage_buckets": (tag_usage_buckets, "SELECT CASE WHEN n = 0 THEN 'unused' WHEN n <= 5 THEN 'low' WHEN n <= 20 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS tags FROM (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) GROUP BY 1"),
    "tag_lists": (tag_lists, TAG_LISTS),
    "contains_all_tags": (contains_all_tags, CONTAINS_ALL_TAGS),
    "workflow_analytics": (workflow_analytics, "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS rate FROM orders GROUP BY 1"),
    "overdue": (overdue, "SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus NOT IN ('F', 'P') AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1"),
    "assigned_sorted": (assigned_sorted, ASSIGNED_SORTED),
    "untagged": (untagged, "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)"),
    "accessible": (accessible, "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "orphans": (orphans, ORPHANS),
    "sync_report": (sync_report, SYNC_REPORT),
    "visible_page": (visible_page, VISIBLE_PAGE),
    "optional_filter": (optional_filter, f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND o_orderdate <= TIMESTAMP '{AS_OF}'"),
    "like_filters": (like_filters, LIKE_FILTERS),
    "folded_tags": (folded_tags, FOLDED_TAGS),
    "latest_version": (latest_version, LATEST_VERSION),
    "versions_beyond_newest": (versions_beyond_newest, VERSIONS_BEYOND),
    "previous_version": (previous_version, PREVIOUS_VERSION),
    "next_version": (next_version, NEXT_VERSION),
    "queue_position": (queue_position, QUEUE_POSITION),
    "version_stats": (version_stats, "SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation, max(n) AS most, median(n) AS median FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"),
    "facets": (facets, FACETS),
    "ratings": (ratings, RATINGS),
    "storage_totals": (storage_totals, "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY 1"),
    "expertise": (expertise, EXPERTISE),
    "workflow_transitions": (transitions, TRANSITIONS),
    "first_reviewer": (first_reviewer, FIRST_REVIEWER),
}

