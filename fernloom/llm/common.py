"""What several operators share: words as hashes, tables between steps, connected components.

Words are hashed for a whole Arrow batch at once, over its byte buffer, so that
no Python object is made for a word. Hashes have 64 bits; where a result depends
on their equality, a second independent key or the words themselves are compared.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Ids or hashes (8 bytes each) up to which a table is sent to every executor; beyond, it is joined by shuffle.
SEND_ROWS = 1 << 20

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NEXT = np.uint64(0xD1342543DE82EF95)
#: Bytes whose words are hashed at once.
_STEP_WORDS = 1 << 16


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in a local session where none is set."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def table(df: DataFrame) -> DataFrame:
    """Writes df in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/fernloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int = SEND_ROWS) -> DataFrame:
    """df for a join: broadcast if its counted rows are few, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """64 random bits for each byte of a word, 0 for a separator."""
    codes = _BYTE.copy()
    if lower:
        codes[65:91] = codes[97:123]
    codes[list(separators)] = 0
    return codes


#: Words `[^\x20\x09-\x0D]+`, as they are and with A-Z in lower case.
SPACED = byte_table(b" \t\n\x0b\x0c\r", lower=False)
SPACED_LOWER = byte_table(b" \t\n\x0b\x0c\r", lower=True)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z went to lower case.
ALNUM_LOWER = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


class Texts(NamedTuple):
    """Some rows of a batch: their first row, their bytes, and where each row's bytes start (one more at the end)."""

    first: int
    data: np.ndarray
    at: np.ndarray


class Words(NamedTuple):
    """Hash and byte range of each word; words bounds[i] to bounds[i + 1] are those of row i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[Texts]:
    """The rows of a batch in steps of bounded size; null is an empty text."""
    col = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
        yield Texts(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(x: Texts, codes: np.ndarray) -> Words:
    """The words of every row; a word ends with its row."""
    inside = (codes != 0)[x.data]
    firsts = x.at[:-1][x.at[:-1] < x.at[1:]]
    edge = np.empty(len(inside), bool)
    edge[:1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    edge[firsts] = True
    marks = np.flatnonzero(edge)
    keep = inside[marks] if len(marks) else np.zeros(0, bool)
    starts, ends = marks[keep], np.append(marks[1:], len(inside))[keep]
    bounds = np.searchsorted(starts, x.at)
    out = np.empty(len(starts), np.uint64)
    a, least = 0, min(len(x.data), _STEP_WORDS)
    up, down = powers(_BASE, least + 1), powers(_INVERSE, least + 1)
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _STEP_WORDS, "right")))
        seg = codes[x.data[starts[a] : ends[b - 1]]]
        # differences of running sums of byte times power, moved back to the word's first byte
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * (up[: len(seg)] if len(seg) < len(up) else powers(_BASE, len(seg))), out=sums[1:])
        rel = starts[a:b] - starts[a]
        out[a:b] = (sums[ends[a:b] - starts[a]] - sums[rel]) * down[rel]
        a = b
    return Words(mixed(out), starts, ends, bounds)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes, whatever row they are in, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, part, size = np.zeros(len(h) - k + 1, np.uint64), 0, h, 1
    by, weight = int(_NEXT), 1
    while True:
        if k & size:
            out = out + part[done : done + len(out)] * np.uint64(weight)
            done, weight = done + size, weight * by % 2**64
        if size * 2 > k:
            return mixed(out)
        part, by, size = part[: len(part) - size] + part[size:] * np.uint64(by), by * by % 2**64, size * 2


def window_min(h: np.ndarray, k: int) -> np.ndarray:
    """Least of each k consecutive values."""
    if len(h) < k:
        return h[:0]
    size = 1
    while size * 2 <= k:
        h, size = np.minimum(h[: len(h) - size], h[size:]), size * 2
    return np.minimum(h[: len(h) - (k - size)], h[k - size :]) if k > size else h


def starts_within(w: Words, k: int) -> np.ndarray:
    """Which of the windows of k words lie in one row."""
    rows = w.rows()
    return rows[: max(0, len(rows) - k + 1)] == rows[k - 1 :]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the k-word shingles; a row of fewer words, but not none, is one shingle."""
    ok = starts_within(w, k)
    h, rows = window_hashes(w.hashes, k)[ok], w.rows()[: len(ok)][ok]
    counts = np.diff(w.bounds)
    if len(short := np.flatnonzero((counts > 0) & (counts < k))):
        more = [window_hashes(w.hashes[w.bounds[i] : w.bounds[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in short]
        h, rows = np.append(h, mixed(np.array(more, np.uint64))), np.append(rows, short)
        order = np.argsort(rows, kind="stable")
        h, rows = h[order], rows[order]
    return h, rows


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, for the nodes of the edges (a, b).

    Each round takes the least label of the neighbours and then the label of that
    label, so that chains shorten by half; labels are a table in the shared folder.
    """
    both = table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = table(step.join(up, "component").select("node", F.least("component", "top").alias("component"), "before"))
        if not new.where("component <> before").limit(1).count():
            return new.select("node", "component")
        label = new.select("node", "component")
