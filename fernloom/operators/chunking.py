"""Texts cut into chunks for retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.functions.text import words


def fixed(documents: DataFrame, size: int = 100, overlap: int = 20, doc: str = "doc_id") -> DataFrame:
    """(doc, index, text, n_words): windows of words; a text without words has none, the last window may be short."""
    if size <= 0:
        return documents.select(doc, F.lit(0).alias("index"), F.lit("").alias("text"), F.lit(0).alias("n_words")).limit(0)
    step = max(1, size - overlap)
    w = documents.select(doc, words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    # a window starts at each step until one reaches the end
    last = F.when(F.size("_w") <= size, 0).otherwise(F.ceil((F.size("_w") - size) / step)).cast("int")
    at = w.select(doc, "_w", F.explode(F.sequence(F.lit(0), last)).alias("index"))
    part = F.slice("_w", F.col("index") * step + 1, F.lit(size))
    return at.select(doc, "index", F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))


def sentences(text: Column) -> Column:
    """Sentences between `.`, `!`, `?` and white space, each with a period at its end."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]+\s+", -1), lambda s: F.trim(F.regexp_replace(s, r"[.!?]+$", ""))), lambda s: F.length(s) > 0)
    return F.transform(parts, lambda s: F.concat(s, F.lit(".")))


def paragraphs(documents: DataFrame, least: int = 100, doc: str = "doc_id") -> DataFrame:
    """(doc, index, text): paragraphs between blank lines; ones shorter than `least` characters join those before them."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n", -1), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    start = F.array().cast("array<string>")
    n = lambda acc: F.size(acc)
    merged = F.aggregate(
        parts,
        start,
        lambda acc, p: F.when((n(acc) > 0) & (F.length(p) < least), F.concat(F.slice(acc, 1, n(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n\n"), p)))).otherwise(F.array_append(acc, p)),
    )
    return documents.select(doc, F.posexplode(merged).alias("index", "text"))


def _tokens(n_bytes: int) -> int:
    return n_bytes // 4 + 1


def packed(pieces: list[tuple[str, str]], most: int, between: str) -> Iterator[tuple[str, int]]:
    """(text, tokens) of runs of pieces (what counts, what is written) within `most` tokens; a longer piece is a run of its own."""
    run, size = [], 0
    for counted, written in pieces:
        if run and _tokens(size) + _tokens(len(counted.encode())) > most:
            yield between.join(run), _tokens(size)
            run, size = [], 0
        size += len(written.encode()) + len(between) * bool(run)
        run.append(written)
    if run:
        yield between.join(run), _tokens(size)


def semantic_chunks(text: str, most: int) -> Iterator[tuple[str, int]]:
    """Paragraphs between empty lines packed up to `most` tokens; the sentences of a longer paragraph are packed by themselves."""
    run = []
    for p in (p.strip() for p in text.split("\n\n")):
        if p and _tokens(len(p.encode())) > most:
            yield from packed(run, most, "\n\n")
            run = []
            yield from packed([(s, s + ".") for s in (s.strip() for s in re.split(r"[.!?]+\s+", p)) if s], most, " ")
        elif p:
            run.append((p, p))
    yield from packed(run, most, "\n\n")


def semantic(documents: DataFrame, most: int = 512, doc: str = "doc_id") -> DataFrame:
    """(doc, index, text, n_tokens): see semantic_chunks; a token is four bytes. Null and blank texts have none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                rows = list(semantic_chunks(text.as_py() or "", most))
                if rows:
                    at = batch.column(0).take(pa.array([i] * len(rows)))
                    yield pa.record_batch({doc: at, "index": pa.array(range(len(rows)), pa.int32()), "text": pa.array([t for t, _ in rows], pa.string()), "n_tokens": pa.array([n for _, n in rows], pa.int32())})

    kind = dict(documents.dtypes)[doc]
    return documents.select(doc, "text").mapInArrow(of, f"{doc} {kind}, index int, text string, n_tokens int")
