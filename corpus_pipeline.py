"""The corpus pipeline: five stages, each on all rows that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.llm.common import sent, table
from fernloom.llm.decontaminate import decontaminate
from fernloom.llm.line_dedup import line_dedup
from fernloom.llm.mixing import mix
from fernloom.llm.ngram_join import ngram_components
from fernloom.llm.quality import quality_rules


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in gone."""
    return docs.join(sent(table(gone.select("doc_id").distinct())), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the base rules or a proven cutoff reject go; rows without doc_id stay."""
    return _without(docs, quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that a line before is similar to go; documents of which no word is left go."""
    kept = line_dedup(docs)
    text = F.col("kept")
    out = kept.select(*(text.alias("text") if c == "text" else F.length(text).cast(kept.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns), (F.col("n_removed") > 0).alias("_cut"))
    return out.where(~F.col("_cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("_cut")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component of near duplicates the document of least doc_id stays."""
    return _without(docs, ngram_components(docs).where("doc_id <> component_id"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a window of a benchmark item go."""
    return _without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents that fill the budgets of the source tree, and how often each is read."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contamination),
    ("mixing to target weights", mixture),
]

#: SQL can't express line dedup, which the tests hold against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table; each stage's rows are a table for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
