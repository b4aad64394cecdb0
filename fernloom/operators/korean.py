"""Search by syllables, letters and initial consonants, and an index of prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.functions.korean import letters, only_initials
from fernloom.functions.text import initial_consonants

MODES = ("exact", "chosung", "jamo", "morpheme")


def _value(spark: SparkSession, c: Column):
    """What an expression of literals is."""
    return spark.range(1).select(c.alias("value")).first()["value"]


def prepared(documents: DataFrame) -> DataFrame:
    """documents (doc, title, content, category, updated) with the initials and letters of title and content.

    Meant to be written once: a search in one mode then reads two of these columns.
    Texts are in lower case there, as comparison ignores case.
    """
    forms = {"plain": F.lower, "initials": lambda c: F.lower(initial_consonants(c)), "letters": lambda c: F.lower(letters(c))}
    return documents.select("doc", "title", "content", "category", "updated", *(of(F.col(c)).alias(f"{c}_{form}") for form, of in forms.items() for c in ("title", "content")))


def search(index: DataFrame, query: str, mode: str = "exact", category: str | None = None, limit: int = 20) -> DataFrame:
    """(doc, title, snippet, score, matched_term, match_type) of documents that contain the query, newest first, at most 100.

    exact and morpheme compare texts as they are, chosung the initial consonants of
    both, jamo the letters of both, so that a syllable without its final is found in
    one with it. Null texts contain nothing. Of equal times the least doc comes first.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    form = {"chosung": "initials", "jamo": "letters"}.get(mode, "plain")
    wanted = _value(index.sparkSession, {"chosung": initial_consonants, "jamo": letters}.get(mode, lambda c: c)(F.lit(query)))
    low = F.lower(F.lit(wanted))
    hit = F.coalesce(F.contains(f"title_{form}", low), F.lit(False)) | F.coalesce(F.contains(f"content_{form}", low), F.lit(False))
    found = index.where(hit if category is None else hit & (F.col("category") == category))
    kind = {"chosung": "chosung", "morpheme": "morpheme"}.get(mode, "exact")
    top = found.orderBy(F.desc("updated"), "doc").limit(min(limit, 100))
    return top.select("doc", "title", F.substring("content", 1, 200).alias("snippet"), F.lit(1.0).alias("score"), F.lit(wanted).alias("matched_term"), F.lit(kind).alias("match_type"))


def write_prefixes(titles: DataFrame, path: str) -> None:
    """Writes (title, n, low, initials) of the distinct titles under two folders, each sorted by what it is looked up by.

    titles: title. Files have narrow ranges of low (lower case) or initials, by which
    a prefix skips all but a few. Null titles are left out.
    """
    each = titles.where("title is not null").groupBy("title").agg(F.count("*").alias("n"))
    each = each.select("title", "n", F.lower("title").alias("low"), initial_consonants(F.col("title")).alias("initials"))
    for by in ("low", "initials"):
        each.repartitionByRange(by, "title").sortWithinPartitions(by).write.mode("overwrite").parquet(f"{path}/{by}")


def complete(spark: SparkSession, path: str, prefix: str, limit: int = 10, initials: bool = True) -> DataFrame:
    """(text, completion, score, match_type, frequency): distinct titles that begin with the prefix, in any case, at most 20.

    A prefix of initial consonants alone asks for titles by their initials, unless
    initials is false. frequency counts all titles that match, repeated ones too, and
    so is the same in every row; titles come in their own order.
    """
    by_initials = initials and _value(spark, only_initials(F.lit(prefix)))
    by = "initials" if by_initials else "low"
    found = spark.read.parquet(f"{path}/{by}").where(F.startswith(by, F.lit(prefix if by_initials else prefix.lower())))
    kind = F.lit("chosung" if by_initials else "exact").alias("match_type")
    top, total = found.orderBy("title").limit(min(limit, 20)).select("title", kind), found.groupBy(kind).agg(F.sum("n").alias("frequency"))
    return top.join(F.broadcast(total), "match_type").select(F.lit(prefix).alias("text"), F.col("title").alias("completion"), F.lit(1.0).alias("score"), "match_type", "frequency")
