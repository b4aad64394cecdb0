"""Keyword search, rank fusion and query expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernloom.functions.content import ANNOTATION_LABELS, fuzzy_hits, lexemes
from fernloom.functions.text import ascii_words
from fernloom.operators.ranking import decayed
from fernloom.operators.vectors import nearest

#: Synonyms of parts of a query, in the order in which they are tried.
SYNONYMS = {
    "error": ["issue", "problem", "bug", "failure"],
    "fix": ["solve", "resolve", "repair", "correct"],
    "create": ["make", "build", "generate", "add"],
    "delete": ["remove", "drop", "clear", "erase"],
    "update": ["modify", "change", "edit", "revise"],
    "find": ["search", "locate", "discover", "get"],
    "how to": ["guide", "tutorial", "steps to", "way to"],
    "what is": ["definition", "meaning of", "explain"],
}
#: Words that a more general query leaves out.
QUALIFIERS = "very extremely really specific exact best top latest new old quickly easily simply just".split()


def postings(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index (term, doc, tf, n): n is the document's words. Counts are summed before the shuffle."""
    words = documents.select(doc, ascii_words(F.col(text)).alias("w"))
    terms = words.select(doc, F.size("w").alias("n"), F.explode("w").alias("term"))
    return terms.groupBy("term", doc).agg(F.count("*").alias("tf"), F.max("n").alias("n"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(documents: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, doc: str = "doc_id") -> DataFrame:
    """(doc, score) of documents with any of the terms. Only the terms' postings are shuffled."""
    words = documents.select(doc, ascii_words(F.col("text")).alias("w")).select(doc, F.size("w").alias("n"), *(F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = words.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    rows = words.where(reduce(lambda a, c: a | c, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))
    idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    tf = lambda i: F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return rows.select(doc, F.round(sum((idf(i) * tf(i) for i in range(len(terms))), F.lit(0.0)), 6).alias("score"))


def token_score(title: Column, body: Column, tokens: list[str]) -> Column:
    """3 for each token in the title and 1 for each occurrence in the body."""
    count = lambda t: (F.length(body) - F.length(F.replace(body, F.lit(t)))) / len(t)
    return sum((F.when(F.contains(title, F.lit(t)), 3).otherwise(0) + count(t) for t in tokens), F.lit(0.0))


def ranked(df: DataFrame, score: str = "score", doc: str = "doc_id") -> DataFrame:
    """df (doc, score) as (doc, rank), the best rank of a document that comes twice."""
    r = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), doc)))
    return r.groupBy(doc).agg(F.min("rank").alias("rank"))


def fused(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, bonus: float = 0.1, doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of bounded hit lists (doc, rank): the sum of weight / (k + rank), the bonus for a document of every list, over the best score."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select(doc, (F.lit(w) / (k + F.col("rank"))).alias("part")) for x, w in zip(lists, weights, strict=True)]
    total = reduce(DataFrame.unionByName, parts).groupBy(doc).agg((F.sum("part") + F.when(F.count("*") == len(lists), bonus).otherwise(0.0)).alias("score"))
    return total.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy(F.lit(0))), 6))


def by_mode(index, query: str, rows: DataFrame, vector: list[float], mode: str = "hybrid", limit: int = 20, threshold: float = 0.2) -> DataFrame:
    """(doc, score) of at most limit documents of at least the threshold: keyword by the full-text index, vector by the vectors' rows (vec_id, embedding), hybrid by both fused, deep by both with expansions of the query and a decay by place.

    Each list is twice as long as the result before it is fused and cut. An expanded
    query asks for the stems of all its forms.
    """
    if mode not in ("keyword", "vector", "hybrid", "deep"):
        raise ValueError("mode must be keyword, vector, hybrid or deep")
    lists = []
    if mode != "vector":
        more = rows.sparkSession.range(1).select(expansions(F.lit(query)).alias("q")).first()["q"] if mode == "deep" else []
        lists.append(index.ranked(" ".join([query, *more])).orderBy(F.desc("score"), "doc").limit(2 * limit))
    if mode != "keyword":
        lists.append(nearest(rows, vector, 2 * limit, -1.0).select(F.col("vec_id").alias("doc"), F.round("similarity", 6).alias("score")))
    found = lists[0]
    if len(lists) == 2:
        found = fused([ranked(x, doc="doc") for x in lists], doc="doc")
    if mode == "deep":
        found = decayed(found, "score", [F.desc("score"), F.col("doc")]).select("doc", F.round("score", 6).alias("score"))
    return found.where(F.col("score") >= threshold).orderBy(F.desc("score"), "doc").limit(limit)


def expansions(query: Column) -> Column:
    """Three at most: the lower-case query with a known part replaced by each of its first two synonyms, then the query without qualifiers if that leaves two words."""
    low = F.lower(query)
    swapped = [F.when(F.contains(low, F.lit(k)), F.replace(low, F.lit(k), F.lit(x))) for k, xs in SYNONYMS.items() for x in xs[:2]]
    rest = F.filter(F.split(F.trim(F.regexp_replace(low, r"\s+", " ")), " "), lambda w: ~w.isin(QUALIFIERS))
    general = F.when(F.size(rest) >= 2, F.array_join(rest, " "))
    return F.slice(F.filter(F.array(*swapped, general), lambda x: x.isNotNull() & (x != low)), 1, 3)


def matched_terms(query: Column) -> Column:
    """The lower-case words of more than two bytes."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.octet_length(w) > 2)


def snippet(text: Column, tokens: list[str], most: int = 200) -> Column:
    """The sentence of at least ten characters with most of the tokens, the first of equal ones, cut."""
    sentences = F.filter(F.transform(F.split(text, "[.!?]", -1), lambda s: F.trim(s)), lambda s: F.length(s) >= 10)
    hits = lambda s: sum((F.contains(F.lower(s), F.lit(t)).cast("int") for t in tokens), F.lit(0))
    best = F.array_min(F.transform(sentences, lambda s, i: F.struct((-hits(s)).alias("minus"), i.alias("i"), s.alias("s"))))
    return F.substring(F.coalesce(best["s"], F.lit("")), 1, most)


def autocomplete(names: DataFrame, column: str, prefix: str, k: int = 10) -> DataFrame:
    """Names that start with the prefix in any case, by how often they come, with the count of all matches."""
    hits = names.where(F.lower(F.col(column)).startswith(prefix.lower())).groupBy(column).agg(F.count("*").alias("n"))
    first = hits.orderBy(F.desc("n"), column).limit(k).withColumn("all", F.lit(True))
    # one row, which each of the first meets
    total = hits.groupBy(F.lit(True).alias("all")).agg(F.count("*").alias("matches"))
    return first.join(F.broadcast(total), "all").drop("all")


def boosted(documents: DataFrame, boosts: dict[str, float], terms: list[str], doc: str = "doc_id") -> DataFrame:
    """(doc, score) of documents with a word near one of the terms: the best field's hits by its boost. Null fields have none."""
    fields = documents.select(doc, *(F.array_distinct(ascii_words(F.col(c))).alias(c) for c in boosts))
    parts = [fuzzy_hits(F.col(c), terms) * b for c, b in boosts.items()]
    score = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return fields.select(doc, F.round(score, 6).alias("score")).where("score > 0")


def contexts(annotations: DataFrame, most: int = 5) -> DataFrame:
    """(path, context): the place and the annotations (path, seq, priority, type, note) of greatest priority, by seq where it is equal."""
    order = Window.partitionBy("path").orderBy(F.desc("priority"), "seq")
    top = annotations.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    label = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in ANNOTATION_LABELS.items()), F.lit("Note"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat(label, F.lit(": "), F.col("note")).alias("line")))), lambda x: x["line"])
    return top.groupBy("path").agg(F.array_join(F.concat(F.array(F.concat(F.lit("Location: "), F.col("path"))), lines), "\n").alias("context"))


def full_text(documents: DataFrame, weights: dict[str, float], query: str, doc: str = "doc_id") -> DataFrame:
    """(doc, score) of documents with every lexeme of the query in one of the weighted fields.

    The score adds, for each lexeme and field, the weight by the logarithm of one more
    than its occurrences; their distance is not looked at. A query without lexemes finds nothing.
    """
    asked = F.array_distinct(lexemes(F.lit(query)))
    fields = documents.select(doc, asked.alias("_asked"), *(lexemes(F.col(c)).alias(c) for c in weights))
    every = F.size(F.array_except("_asked", F.concat(*weights))) == 0

    def part(field: str, weight: float) -> Column:
        found = lambda t: F.size(F.filter(field, lambda x: x == t))
        return F.aggregate("_asked", F.lit(0.0), lambda acc, t: acc + weight * F.log1p(found(t)))

    score = sum((part(c, w) for c, w in weights.items()), F.lit(0.0))
    return fields.where((F.size("_asked") > 0) & every).select(doc, F.round(score, 6).alias("score"))
