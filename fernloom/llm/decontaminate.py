"""Benchmark decontamination as a prefix-filtered set join.

An item window (10 words) is contained in a document only if all its shingles
are, so its necessary prefix is one shingle: the rarest one in the corpus, whose
count is taken over all documents. Documents are joined on that shingle alone;
position and length bound the alignment, and the words of the whole window are
compared before a hit counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernloom.llm.common import ALNUM_LOWER, SEND_ROWS, in_sorted, shingles, signed, starts_within, table, texts, window_hashes, words

#: Words of an item window, and of a shingle in it; shorter items have shingles of one word.
WINDOW, SHINGLE = 10, 5


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window binary, words array, keys array of shingle hashes in order), distinct."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in texts(batch):
                w, rows = words(x, ALNUM_LOWER), []
                for i in range(len(x.at) - 1):
                    own = [x.data[a:b].tobytes().decode(errors="backslashreplace").translate(_LOWER) for a, b in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]], strict=True)]
                    h = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    size = min(window, len(own))
                    k = shingle if size >= shingle else 1
                    keys = signed(window_hashes(h, k))
                    rows += [(batch.column(0)[x.first + i].as_py(), own[j : j + size], keys[j : j + size - k + 1].tolist(), k) for j in range(len(own) - size + 1 if own else 0)]
                yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "words", "keys", "k"), r, strict=True)) for r in rows], pa.schema([("item_id", batch.schema.field(0).type), ("words", pa.list_(pa.string())), ("keys", pa.list_(pa.int64())), ("k", pa.int32())]))

    kind = dict(benchmark.dtypes)["item_id"]
    return benchmark.select("item_id", "text").mapInArrow(of, f"item_id {kind}, words array<string>, keys array<bigint>, k int").distinct()


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _known(keys: DataFrame) -> dict[int, np.ndarray] | None:
    """The keys by shingle length as sorted arrays, if they are few enough to send; else None, and all shingles take part in the join."""
    rows = keys.limit(SEND_ROWS + 1).collect()
    if len(rows) > SEND_ROWS:
        return None
    return {k: np.sort(np.array([r["key"] for r in rows if r["k"] == k], np.int64)) for k in {r["k"] for r in rows}}


def _found(batch: pa.RecordBatch, known: dict[int, np.ndarray] | None, shingle: int):
    """For each step: the texts, their words, and the (positions, keys, k) of the shingles that are known."""
    for x in texts(batch):
        w = words(x, ALNUM_LOWER)
        found = []
        for k in (shingle, 1) if known is None else known:
            h, ok = signed(window_hashes(w.hashes, k)), starts_within(w, k)
            at = np.flatnonzero(ok & in_sorted(h, known[k]) if known is not None else ok)
            found.append((at, h[at], k))
        yield x, w, found


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z went to lower case. A
    word is hit if it lies in an occurrence of an item window; n_items counts the
    items with such windows. Null or empty texts have no words and no hits; null
    item texts have no windows. Bytes that are no UTF-8 belong to words and are equal
    to the same bytes alone. Each row is its own, rows that repeat a doc_id, with
    the same text or another, and null ids too. Other columns are left out.
    """
    items = table(item_windows(benchmark, window, shingle))
    grams = items.select("words", "k", F.posexplode("keys").alias("off", "key")).distinct()
    known = _known(grams.select("key", "k").distinct())
    docs = documents.select("doc_id", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found in _found(batch, known, shingle):
                for _, h, k in found:
                    key, n = np.unique(h, return_counts=True)
                    yield pa.record_batch({"key": key, "k": np.full(len(key), k, np.int32), "n": n})

    if known is None:
        few = grams.select("key", "k").distinct()
        counts = docs.mapInArrow(counted, "key bigint, k int, n bigint").groupBy("key", "k").agg(F.sum("n").alias("n")).join(few, ["key", "k"], "left_semi")
    else:
        counts = docs.mapInArrow(counted, "key bigint, k int, n bigint").groupBy("key", "k").agg(F.sum("n").alias("n"))
    rare = Window.partitionBy("words").orderBy("n", "off")
    # a window with a shingle that no document has can't occur at all
    every = Window.partitionBy("words")
    owners = items.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    chosen = table(
        grams.join(counts, ["key", "k"], "left").withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(every)).where("least > 0").withColumn("rank", F.row_number().over(rare)).where("rank = 1").select("words", "k", "key", "off").join(owners, "words")
    )
    wanted = _known(chosen.select("key", "k").distinct())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, w, found in _found(batch, wanted, shingle):
                n, rows = len(x.at) - 1, w.rows()
                at, keys, ks = (np.concatenate([np.zeros(0, np.int64), *y]) for y in ([f[0] for f in found], [f[1] for f in found], [np.full(len(f[0]), f[2]) for f in found]))
                order = np.argsort(at, kind="stable")
                at, keys, ks = at[order].astype(np.int64), keys[order].astype(np.int64), ks[order]
                row = rows[at] if len(at) else np.zeros(0, np.int64)
                lo, hi = np.maximum(at - window + 1, w.bounds[row]), np.minimum(at + window, w.bounds[row + 1])
                near = [[x.data[w.starts[j] : w.ends[j]].tobytes().decode(errors="backslashreplace").translate(_LOWER) for j in range(a, b)] for a, b in zip(lo, hi, strict=True)]
                hits = pa.StructArray.from_arrays(
                    [pa.array(at - w.bounds[row], pa.int32()), pa.array(keys, pa.int64()), pa.array(ks, pa.int32()), pa.array(at - lo, pa.int32()), pa.array(near, pa.list_(pa.string()))], ["pos", "key", "k", "before", "near"]
                )
                ids = batch.column(0).slice(x.first, n)
                text = batch.column(1).slice(x.first, n)
                yield pa.record_batch(
                    {
                        "doc_id": ids,
                        "copy": pa.array([None if t is None else hash_text(t) for t in _bytes(x, text)], pa.binary()),
                        "n_words": pa.array(np.diff(w.bounds), pa.int64()),
                        "hits": pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), hits),
                    }
                )

    kind = dict(documents.dtypes)["doc_id"]
    per_doc = docs.mapInArrow(candidates, f"doc_id {kind}, copy binary, n_words bigint, hits array<struct<pos:int,key:bigint,k:int,before:int,near:array<string>>>")
    doc = ["doc_id", "copy", "n_words"]
    hit = per_doc.select(*doc, F.posexplode_outer("hits").alias("i", "hit")).select(*doc, F.when(F.coalesce("i", F.lit(0)) == 0, 1).alias("row"), "hit.*")
    # documents without hits are dealt out by themselves; no window has 0 words in its shingles
    hit = hit.withColumn("key", F.coalesce("key", F.xxhash64("doc_id", "copy"))).withColumn("k", F.coalesce("k", F.lit(0)))
    hit = hit.join(chosen, ["key", "k"], "left").withColumn(
        "start",
        # position and length: the window must begin and end in the document; then all its words are compared
        F.when((F.col("before") >= F.col("off")) & (F.col("before") - F.col("off") + F.size("words") <= F.size("near")) & (F.expr("slice(near, before - off + 1, size(words))") == F.col("words")), F.col("pos") - F.col("off")),
    )
    found = hit.groupBy(*doc).agg(
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", F.size("words").alias("size")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("start").isNotNull(), F.col("items"))))).alias("items"),
        F.sum("row").alias("rows"),
    )
    found = found.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["start"] + s["size"]).alias("end")),
    )["n"]
    return found.select(
        "doc_id",
        "n_words",
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>"))), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def hash_text(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _bytes(x, text: pa.Array) -> Iterator[bytes | None]:
    valid = text.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(valid)):
        yield x.data[x.at[i] : x.at[i + 1]].tobytes() if valid[i] else None


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB: all windows of the items against all windows of the documents.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM di),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
