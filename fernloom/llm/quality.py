r"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one statistic of a text with a cutoff. Cutoffs come from labelled
good documents, for each stratum (language), in two halves told by a hash of doc_id.
The first half proposes: for each of a row of shares, every rule's strictest candidate
cutoff that rejects no more than this share of it. The second half decides: from the
least share on, the verdict of all rules together is tested at a false rejection of
EPSILON, by an exact binomial test at the level DELTA divided by the number of strata
(Bonferroni), until a test fails (fixed sequence, which needs no further correction).
So with probability 1 - DELTA no stratum loses more than EPSILON of its good documents.
A stratum in which the first test fails rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernloom.llm.common import table

#: Share of a stratum's good documents that all rules together may reject, and the chance that those of any stratum reject more.
EPSILON, DELTA = 0.05, 0.05
#: Shares of the first half that a rule's proposed cutoff may reject, in the order of the tests.
SHARES = (0.0, 0.001, 0.002, 0.004, 0.008, 0.016)
#: Candidate cutoffs of each statistic; a text fails if its value is above the cutoff.
CUTOFFS = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5),
    "dup_line_ratio": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "short_words": (0.2, 0.25, 0.3, 0.35, 0.4),
    "long_words": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0),
}
WORD = r"[^\x20\x09-\x0D]+"


def base_statistics(documents: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    r"""documents with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of each row's text.

    Words are `[^\x20\x09-\x0D]+`; null texts count as empty. n_repeat_words counts the
    words in 3-word windows that the text has twice or more, n_dup_lines the lines
    with a word that equal a line before. Names get the prefix; columns of those
    names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in [prefix + m for m in made]]
    t = F.coalesce(F.col(text), F.lit(""))
    w, g, s = "_fernloom_w", "_fernloom_g", "_fernloom_s"
    df = documents.select(*kept, F.regexp_extract_all(t, F.lit(WORD), 0).alias(w))
    n = F.size(w)
    # hashes of the 3-word windows, and whether any of them occurs twice
    triples = F.when(n >= 3, F.arrays_zip(F.slice(w, 1, n - 2).alias("a"), F.slice(w, 2, n - 2).alias("b"), F.slice(w, F.lit(3), n - 2).alias("c")))
    df = df.withColumn(g, F.transform(triples, lambda x: F.xxhash64(x["a"], x["b"], x["c"])))
    # only texts with a repeated window are sorted; equal windows are then neighbours
    pairs = F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn(s, pairs)
    m = F.size(s)
    beside = F.filter(F.arrays_zip(F.slice(s, 1, m - 1).alias("x"), F.slice(s, 2, m - 1).alias("y")), lambda p: p["x"]["h"] == p["y"]["h"])
    at = F.array_distinct(F.flatten(F.transform(beside, lambda p: F.array(p["x"]["i"], p["x"]["i"] + 1, p["x"]["i"] + 2, p["y"]["i"], p["y"]["i"] + 1, p["y"]["i"] + 2))))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.ltrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    stats = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col(s).isNull(), 0).otherwise(F.size(at)),
    }
    return df.select(*kept, *(v.cast("long").alias(prefix + k) for k, v in stats.items()))


def base_failed(p: str = "") -> Column:
    n = F.col(f"{p}n_words")
    return (n < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * n)


def ratios(p: str = "") -> dict[str, Column]:
    """The statistics that rules compare with cutoffs."""
    n = F.greatest(F.col(f"{p}n_words"), F.lit(1)).cast("double")
    mean = F.col(f"{p}word_chars") / n
    return {
        "symbol_ratio": F.col(f"{p}n_symbols") / n,
        "repeat_ratio": F.col(f"{p}n_repeat_words") / n,
        "dup_line_ratio": F.col(f"{p}n_dup_lines") / n,
        "short_words": 1 / F.greatest(mean, F.lit(0.01)),
        "long_words": mean,
    }


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X of n trials, summed from its term k downwards."""
    log_term = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        n * math.log1p(-p),
        lambda acc, i: acc + F.log((n - i + 1) / i) + math.log(p / (1 - p)),
    )
    tail = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("term"), (acc["sum"] + acc["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("sum")),
    )["sum"]
    return F.exp(log_term) * tail


def cutoffs(statistics: DataFrame, labels: DataFrame, stratum: str = "lang", epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """(stratum, one column a rule): the cutoffs of the last proven proposal, null where none is.

    statistics has doc_id, the stratum and base_statistics; labels doc_id and
    quality (1: good). Only labelled good documents that pass the base rules are
    trials. A doc_id labelled twice counts by its greatest label; a null stratum
    is its own stratum.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    r = ratios()
    held = statistics.join(good, "doc_id", "left_semi").where(~base_failed()).select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("first"), *(v.alias(k) for k, v in r.items()))
    # the first half's documents above each candidate: one row a stratum, summed before the shuffle
    above = [F.count_if(F.col(k) > c).alias(f"{k}_{i}") for k, cs in CUTOFFS.items() for i, c in enumerate(cs)]
    counted = held.where("first").groupBy("stratum").agg(F.count("*").alias("n"), *above)
    least = lambda k, share: F.array_min(F.filter(F.array(*(F.when(F.col(f"{k}_{i}") <= F.floor(F.col("n") * share), F.lit(c)) for i, c in enumerate(CUTOFFS[k]))), lambda x: x.isNotNull()))
    proposed = counted.select("stratum", *(least(k, share).alias(f"{k}_{j}") for j, share in enumerate(SHARES) for k in CUTOFFS))
    rejects = lambda j: reduce(lambda x, y: x | y, [F.coalesce(F.col(k) > F.col(f"{k}_{j}"), F.lit(False)) for k in CUTOFFS])
    rest = held.where("not first").join(proposed, "stratum").groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(rejects(j)).alias(f"k_{j}") for j in range(len(SHARES))))
    rest = rest.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row for each stratum
    # the test needs the binomial only where the rejected share is below epsilon
    proven = lambda k: (k <= F.col("n") * epsilon) & (at_most(F.least(k, F.floor(F.col("n") * epsilon)), F.col("n"), epsilon) <= delta / F.col("strata"))
    passed = rest.select("stratum", F.array(*(proven(F.col(f"k_{j}")) for j in range(len(SHARES)))).alias("proven"))
    # how many tests pass before the first that fails
    steps = passed.select("stratum", F.coalesce(F.nullif(F.array_position("proven", False), F.lit(0)) - 1, F.lit(len(SHARES))).alias("steps"))
    chosen = lambda k: F.get(F.array(*(F.col(f"{k}_{j}") for j in range(len(SHARES)))), F.col("steps").cast("int") - 1)
    return proposed.join(steps, "stratum").select("stratum", *(F.when(F.col("steps") > 0, chosen(k)).alias(f"max_{k}") for k in CUTOFFS))


def verdict(p: str = "") -> Column:
    """Whether no cutoff is exceeded; a rule without cutoff rejects nothing."""
    out = F.lit(True)
    for k, r in ratios(p).items():
        out = out & F.coalesce(r <= F.col(f"max_{k}"), F.lit(True))
    return out


def quality_rules(documents: DataFrame, labels: DataFrame, stratum: str = "lang", epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row.

    base_failed: fewer than 50 words, or more than half of them in repeated
    windows. kept: neither that nor above a cutoff of the row's stratum. A null or
    empty text has no words and fails. Repeated rows are judged each; without
    labels only the base rules reject.
    """
    # the statistics without the texts: small, read for the cutoffs and for the result
    stats = table(base_statistics(documents.select("doc_id", F.col(stratum).alias("stratum"), "text")).drop("text"))
    limits = cutoffs(stats, labels, "stratum", epsilon, delta)
    out = stats.withColumn("_s", F.coalesce("stratum", F.lit(""))).join(limits.withColumnRenamed("stratum", "_s"), "_s", "left")
    failed = base_failed()
    return out.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict()).alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.drop("stratum")


def _sql() -> str:
    """DuckDB: words and windows as rows; the same proposals and binomial sums."""
    ratio = {"symbol_ratio": "n_symbols / n", "repeat_ratio": "n_repeat_words / n", "dup_line_ratio": "n_dup_lines / n", "short_words": "1 / greatest(word_chars / n, 0.01)", "long_words": "word_chars / n"}
    cand = ", ".join(f"('{k}', CAST({c} AS DOUBLE))" for k, cs in CUTOFFS.items() for c in cs)
    shares = ", ".join(f"({j}, CAST({x} AS DOUBLE))" for j, x in enumerate(SHARES))
    values = " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS rule, {v} AS v FROM r" for k, v in ratio.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(greatest(n_words, 1) AS DOUBLE) AS n FROM s),
r AS (SELECT f.* FROM f WHERE NOT base_failed),
v AS ({values}),
good AS (SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS first FROM labels GROUP BY doc_id HAVING max(quality) = 1),
c AS (SELECT * FROM (VALUES {cand}) AS x(rule, cut)),
j AS (SELECT * FROM (VALUES {shares}) AS x(j, share)),
k AS (SELECT lang, c.rule, cut, count(*) AS n, count(*) FILTER (v > cut) AS k FROM v JOIN good USING (doc_id) JOIN c ON c.rule = v.rule WHERE first GROUP BY ALL),
p AS (SELECT lang, j, rule, min(cut) AS cut FROM k, j WHERE k <= floor(n * share) GROUP BY ALL),
h AS (SELECT r.lang, r.doc_id FROM r JOIN good USING (doc_id) WHERE NOT first AND r.lang IN (SELECT lang FROM k)),
x AS (SELECT DISTINCT h.lang, p.j, h.doc_id FROM h JOIN v USING (doc_id) JOIN p ON p.lang = h.lang AND p.rule = v.rule AND v.v > p.cut),
t AS (SELECT lang, j, any_value(n) AS n, count(x.doc_id) AS k FROM (SELECT lang, count(*) AS n FROM h GROUP BY lang) CROSS JOIN j LEFT JOIN x USING (lang, j) GROUP BY lang, j),
z AS (SELECT *, (SELECT count(DISTINCT lang) FROM h) AS strata FROM t),
b AS (SELECT lang, j, k <= n * {EPSILON} AND coalesce(list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i:
  exp(n * ln(1 - {EPSILON}) + i * ln({EPSILON} / (1 - {EPSILON})) + coalesce(list_sum(list_transform(range(1, i + 1), lambda m: ln((n - m + 1) / m))), 0)))), 0) <= {DELTA} / strata AS ok FROM z),
y AS (SELECT lang, max(j) AS j FROM (SELECT lang, j, bool_and(ok) OVER (PARTITION BY lang ORDER BY j) AS ok FROM b) WHERE ok GROUP BY lang),
q AS (SELECT p.lang, p.rule, p.cut FROM p JOIN y USING (lang, j)),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN q ON q.lang = v.lang AND q.rule = v.rule WHERE v.v > q.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM f LEFT JOIN bad USING (doc_id)
"""


OP8_SQL = _sql()
