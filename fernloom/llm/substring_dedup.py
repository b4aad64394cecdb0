"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of each run of 50 words the least hash of its
20-word shingles, so that a passage of 50 words shared by two documents gives
both the same anchor. Documents are joined on the anchors that several of them
have. From such a seed the match is extended both ways: every window of 50 words
around it is compared with those of the documents before, and windows that
repeat one of a smaller doc_id and touch or overlap make a maximal repeat, which
is at least 50 words long. Its words go.

Windows are grouped by their content with partial sums before the shuffle, so a
passage that a third of the documents share costs its windows, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fernloom.llm.common import SPACED, Texts, Words, in_sorted, lists, signed, starts_within, table, texts, window_hashes, window_min, words

#: Least length of a repeat, and of the shingles of which the anchors are chosen, in words.
LENGTH, SEED = 50, 20


def _windows(x: Texts, length: int, seed: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words; where windows within one row start; the anchor of each window."""
    w = words(x, SPACED)
    ok = starts_within(w, length)
    anchor = window_min(window_hashes(w.hashes, seed), length - seed + 1)
    return w, np.flatnonzero(ok), anchor[ok]


def _anchors(documents: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, doc_id), each anchor once a document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in texts(batch):
                w, at, anchor = _windows(x, length, seed)
                rows = w.rows()[at]
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
                yield pa.record_batch({"anchor": signed(anchor[new]), "doc_id": batch.column(0).take(pa.array(rows[new] + x.first))})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(of, f"anchor bigint, doc_id {kind}")


def repeated_windows(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, starts): the windows of each document, by number of their first word, that a document of smaller doc_id has too."""
    docs = documents.select("doc_id", "text").where("doc_id is not null")
    anchors = table(_anchors(docs, length, seed))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    seeds = anchors.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("anchor")).alias("seeds"))

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(2)
            at_seed, of_seed = known.offsets.to_numpy(), known.flatten().to_numpy()
            at_seed = at_seed - at_seed[0]
            for x in texts(batch):
                w, at, anchor = _windows(x, length, seed)
                rows = w.rows()[at]
                cut = np.searchsorted(rows, np.arange(len(x.at)))
                anchor = signed(anchor)
                hit = np.concatenate([np.zeros(0, bool), *(in_sorted(anchor[cut[i] : cut[i + 1]], of_seed[at_seed[x.first + i] : at_seed[x.first + i + 1]]) for i in range(len(x.at) - 1))])
                at, rows, second = at[hit], rows[hit], (anchor[hit] >> 32).astype(np.int32)
                full = signed(window_hashes(w.hashes, length))[at]
                yield pa.record_batch(
                    {"win": full, "second": second, "doc_id": batch.column(0).take(pa.array(rows + x.first)), "start": pa.array(at - w.bounds[rows], pa.int32())}
                )

    kind = dict(documents.dtypes)["doc_id"]
    # a window's hash and half of its anchor: 96 bits to tell windows by
    around = table(docs.join(seeds, "doc_id").mapInArrow(extended, f"win bigint, second int, doc_id {kind}, start int"))
    first = around.groupBy("win", "second").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("win", "second", "lo")
    return around.join(first, ["win", "second"]).where("doc_id > lo").groupBy("doc_id").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def substring_dedup(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Each row of documents with kept (the text without repeats, words joined by one space), n_words and n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of length
    words covers it whose sequence also starts in a document of smaller doc_id;
    windows are judged on the input. Null or empty texts have no words and kept is
    empty. Documents are told apart by doc_id: the windows of rows that repeat one
    count for that id, so identical rows lose nothing by each other. A row without
    doc_id neither removes nor loses. Extra columns stay, but for those named like
    a new one, which it replaces.
    """
    made = ["kept", "n_words", "n_removed"]
    names = [c for c in documents.columns if c not in made]
    documents = documents.select(*names)
    starts = repeated_windows(documents, length, seed).withColumnRenamed("starts", "_fernloom_starts")
    docs = documents.join(starts, "doc_id", "left").select(*names, "_fernloom_starts")
    s = len(names)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(s)
            for x in texts(batch, "text"):
                w = words(x, SPACED)
                kept, gone = [], []
                for i in range(len(x.at) - 1):
                    lo, hi = w.bounds[i], w.bounds[i + 1]
                    own = starts[x.first + i].values
                    if own is None or not len(own):
                        kept.append(b" ".join(x.data[x.at[i] : x.at[i + 1]].tobytes().split()).decode(errors="replace"))
                        gone.append(0)
                        continue
                    # rows that repeat a doc_id with another text may be shorter
                    first = own.to_numpy()
                    first = first[first + length <= hi - lo]
                    depth = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + length, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    data = x.data[x.at[i] : x.at[i + 1]].tobytes()
                    a, b = w.starts[lo:hi][keep] - x.at[i], w.ends[lo:hi][keep] - x.at[i]
                    kept.append(b" ".join(data[p:q] for p, q in zip(a.tolist(), b.tolist(), strict=True)).decode(errors="replace"))
                    gone.append(int((~keep).sum()))
                m = len(kept)
                cols = [batch.column(j).slice(x.first, m) for j in range(s)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(np.diff(w.bounds), pa.int64()), pa.array(gone, pa.int64())], [*names, "kept", "n_words", "n_removed"])

    return docs.mapInArrow(removed, StructType([*documents.schema.fields, *StructType().add("kept", "string").add("n_words", "long").add("n_removed", "long").fields]))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: every window of 50 words and the least doc_id that has it.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM i),
f AS (SELECT g, min(doc_id) AS lo FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
b AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (g) WHERE doc_id > lo),
r AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM p ANTI JOIN b USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
