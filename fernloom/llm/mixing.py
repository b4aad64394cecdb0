"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The corpus is a tree: domains, languages in them, sources in those. The token
budget goes down the tree by weight. A node gets no more than its documents can
give in `epochs` passes; what it lacks goes to its siblings by weight, up to what
they can give, and only what no sibling can take shows up one level higher, where
the parent's own capacity is the sum of its children's (water filling).

Each leaf then takes a prefix of its documents in seeded order: whole epochs, and
of the next epoch the documents up to the remaining tokens. The order is that of
a hash of seed and doc_id. To find where the prefix ends without sorting a leaf
in one task, tokens are summed by hash bucket first; only the bucket in which the
prefix ends is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernloom.llm.common import sent, table

#: Part of the corpus's tokens that the mix has, passes over a leaf at most, and the seed of the order.
BUDGET, EPOCHS, SEED = 0.5, 2, 20240229
#: Whole-number weights by level and name; what isn't named has weight 1.
WEIGHTS = {"domain": {"d1": 2}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 2}, "source": {"src0": 3}}
#: Hexadecimal digits of the hash by which a leaf is summed: 4096 buckets of a leaf.
DIGITS = 3

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """Production rule: the last digit of the source's number names one of four domains."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "([0-9])$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def filled(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """nodes (weight, cap) with got: the parent's budget by weight, none above its cap.

    Nodes in order of cap / weight fill up one after another; a node is full if its
    share of what is left, by weight, is at least its cap.
    """
    order = [F.col("cap") / F.col("weight"), F.col("node")]
    by = Window.partitionBy(*parent)
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = nodes.withColumn("share", left / weight)
    full = level.withColumn("full", F.col("share") * F.col("weight") >= F.col("cap"))
    # the level of the first node that is not full holds for all after it
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("node"), F.col("share")))).over(by)
    return full.withColumn("rest", rest).withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("rest.share") * F.col("weight")))).drop("share", "full", "rest")


def leaf_budgets(leaves: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(domain, lang, source, tokens, got) of leaves (domain, lang, source, tokens). weights: whole numbers by level and name."""
    weights = WEIGHTS if weights is None else weights
    weight = lambda level: reduce(lambda w, kv: F.when(F.col(level) == kv[0], kv[1]).otherwise(w), weights.get(level, {}).items(), F.lit(1))
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = Window.partitionBy(F.lit(0))
    # the budget is a part of all tokens, in whole tokens
    domains = domains.withColumn("weight", weight("domain")).withColumn("node", F.col("domain")).withColumn("all", F.floor(F.sum("cap").over(total) / epochs * budget))
    domains = filled(domains.withColumn("top", F.lit(0)), ["top"], "all").select("domain", F.col("got").alias("given"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight("lang")).withColumn("node", F.col("lang"))
    langs = filled(langs.join(domains, "domain"), ["domain"], "given").select("domain", "lang", F.col("got").alias("given"))
    sources = caps.withColumn("weight", weight("source")).withColumn("node", F.col("source"))
    return filled(sources.join(langs, ["domain", "lang"]), ["domain", "lang"], "given").select(*LEVELS, "tokens", "got")


def mix(documents: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of the chosen documents.

    copies is how many epochs take the document. Tokens are words
    `[^\\x20\\x09-\\x0D]+`; texts without any, null ones too, are never chosen, nor are
    rows without doc_id. A null language or source is a node named by the empty
    text. Of an epoch's documents in seeded order those are taken whose first token
    lies before the budget's end, so a leaf passes its budget by less than one
    document. Rows that repeat a doc_id share its place and are ordered by length.
    Other columns are left out.
    """
    docs = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("n_tokens")
    ).where("doc_id is not null and n_tokens > 0")
    docs = docs.withColumn("domain", domain_of(F.col("source"))).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))))
    docs = docs.withColumn("bucket", F.substring("key", 1, DIGITS))
    # the rows without texts: small, read three times
    docs = table(docs.select("doc_id", *LEVELS, "n_tokens", "key", "bucket"))
    leaf = list(LEVELS)
    sums = docs.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("sum"))
    budgets = leaf_budgets(sums.groupBy(*leaf).agg(F.sum("sum").alias("tokens")), budget, epochs, weights)
    budgets = budgets.withColumn("whole", F.floor(F.col("got") / F.col("tokens"))).withColumn("part", F.col("got") - F.col("whole") * F.col("tokens")).drop("tokens", "got")
    upto = Window.partitionBy(*leaf).orderBy("bucket")
    placed = sums.withColumn("end", F.sum("sum").over(upto)).join(budgets, leaf)
    # the bucket in which the prefix ends, and what of the part is left for it: a row for each leaf at most
    edge = placed.where((F.col("end") - F.col("sum") < F.col("part")) & (F.col("end") >= F.col("part"))).select(*leaf, "bucket", (F.col("part") - F.col("end") + F.col("sum")).alias("left"))
    within = Window.partitionBy(*leaf, "bucket").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = table(edge)
    cut = docs.join(sent(edge), [*leaf, "bucket"]).withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("before < left")
    cut = cut.groupBy(*leaf).agg(F.max(F.struct("key", "n_tokens")).alias("last"))
    limits = table(budgets.join(cut, leaf, "left").select(*leaf, "whole", "last"))
    taken = docs.join(sent(limits), leaf).withColumn("copies", (F.col("whole") + F.when(F.struct("key", "n_tokens") <= F.col("last"), 1).otherwise(0)).cast("int"))
    return taken.where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB: the same budgets; prefixes by sorting each leaf."""
    weight = lambda level, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"

    def fill(name: str, nodes: str, parent: str, node: str) -> str:
        order = f"PARTITION BY {parent} ORDER BY cap / weight, {node}"
        before = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"""{name}1 AS (SELECT *, (given - coalesce(sum(cap) {before}, 0)) / (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) {before}, 0)) AS share FROM ({nodes})),
{name}2 AS (SELECT *, share * weight >= cap AS is_full FROM {name}1),
{name}3 AS (SELECT *, first_value(CASE WHEN NOT is_full THEN share END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rest FROM {name}2),
{name} AS (SELECT * EXCLUDE (given), CAST(CASE WHEN is_full THEN cap ELSE floor(rest * weight) END AS BIGINT) AS given FROM {name}3)"""

    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS INTEGER) % 4, 0) AS VARCHAR) AS domain, md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS key
  FROM {documents} WHERE doc_id IS NOT NULL),
e AS (SELECT * FROM d WHERE n_tokens > 0),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {EPOCHS} AS cap FROM e GROUP BY ALL),
{fill("x", f"SELECT domain, 0 AS top, CAST(sum(cap) AS BIGINT) AS cap, {weight('domain', 'domain')} AS weight, CAST(floor(CAST(sum(sum(cap)) OVER () AS BIGINT) / {EPOCHS} * {BUDGET}) AS BIGINT) AS given FROM l GROUP BY domain", "top", "domain")},
{fill("y", f"SELECT l.domain, lang, CAST(sum(l.cap) AS BIGINT) AS cap, {weight('lang', 'lang')} AS weight, any_value(given) AS given FROM l JOIN x USING (domain) GROUP BY l.domain, lang", "domain", "lang")},
{fill("z", f"SELECT l.domain, l.lang, source, tokens, l.cap, {weight('source', 'source')} AS weight, given FROM l JOIN y USING (domain, lang)", "domain, lang", "source")},
b AS (SELECT *, given // tokens AS whole, given % tokens AS part FROM z),
o AS (SELECT e.*, whole, part, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN before < part THEN 1 ELSE 0 END AS INTEGER) AS copies FROM o WHERE whole > 0 OR before < part
"""


OP4_SQL = mixing_sql()
