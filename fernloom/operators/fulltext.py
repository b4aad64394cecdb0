"""A stored positional index of words, and ranked, marked and fuzzy search over it.

The index is three tables in one folder: a row for each word of a document's field with
its places there, in directories by a hash of the word and sorted by word, so that a
search reads its own words alone; the distinct words with their stems; and, for fuzzy search, the words by
each of their thirds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fernloom.functions.stemming import STOP_WORDS, stem, stems

WORD = r"[\p{L}\p{N}]+"
#: Words that a headline has at most and at least.
MOST_WORDS, LEAST_WORDS = 50, 20
_MOST_FORMS = 1 << 12
#: Documents whose words are brought together in one step.
STEP_DOCUMENTS = 1 << 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _thirds(length: int) -> list[tuple[int, int]]:
    return [(i * length // 3, (i + 1) * length // 3) for i in range(3)]


def segments(word: Column) -> Column:
    """A word's thirds that aren't empty, each with the word's length and its number: three at most, however long the word."""
    n = F.length(word)
    start = lambda i: F.floor(i * n / 3)
    third = lambda i: F.concat_ws(":", n.cast("string"), i.cast("string"), F.substring(word, (start(i) + 1).cast("int"), (start(i + 1) - start(i)).cast("int")))
    return F.transform(F.filter(F.array(*map(F.lit, range(3))), lambda i: start(i + 1) > start(i)), third)


def may_differ(term: str) -> int:
    """Letters in which a word near the term may differ."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def asked_segments(term: str) -> list[str]:
    """The segments of which a word near the term has one: an edit changes one third at most, so one is left, moved by as many letters as may differ."""
    most, keys = may_differ(term), {}
    for n in range(max(1, len(term) - most), len(term) + most + 1):
        for i, (a, b) in enumerate(_thirds(n)):
            for at in range(max(0, a - most), min(len(term) - (b - a), a + most) + 1):
                if b > a:
                    keys[f"{n}:{i}:{term[at : at + b - a]}"] = None
    return list(keys)


@dataclass(frozen=True)
class FullTextIndex:
    """An index in a folder: path, the weight of each field in order, and the number of directories."""

    spark: SparkSession
    path: str
    weights: tuple[float, ...]
    buckets: int

    def places(self) -> DataFrame:
        """(word, doc, field, pos, first, bucket): all places of a word in a document's field; first marks the first of its fields."""
        return self.spark.read.parquet(f"{self.path}/occurrences")

    def occurrences(self) -> DataFrame:
        """(word, doc, field, pos, bucket): pos goes on from field to field."""
        return self.places().select("word", "doc", "field", F.explode("pos").alias("pos"), "bucket")

    def words(self) -> DataFrame:
        """(word, stem, uses, docs)."""
        return self.spark.read.parquet(f"{self.path}/words")

    def of(self, words: list[str]) -> DataFrame:
        """The occurrences of some words, read from their own directories."""
        own = self.spark.createDataFrame([(w,) for w in words], "word string").select(_bucket(F.col("word"), self.buckets).alias("b")).distinct()
        return self.occurrences().where(F.col("bucket").isin([r["b"] for r in own.collect()]) & F.col("word").isin(words))

    def forms(self, query: str) -> list[list[str]]:
        """For each different stem of the query, less function words, the words of the index that have it."""
        asked = [r["w"] for r in self.spark.range(1).select(F.explode(words_of(F.lit(query))).alias("w")).collect()]
        wanted = list(dict.fromkeys(stem(w) for w in asked if w not in STOP_WORDS))
        found = self.words().where(F.col("stem").isin(wanted)).select("stem", "word").limit(_MOST_FORMS + 1).collect() if wanted else []
        if len(found) > _MOST_FORMS:
            raise ValueError(f"more than {_MOST_FORMS} words have a stem of the query")
        return [sorted(r["word"] for r in found if r["stem"] == s) for s in wanted]

    def ranked(self, query: str) -> DataFrame:
        """(doc, score) of the documents with every stem of the query, by cover density.

        A cover is a shortest run of words with every stem; it counts the stems' words in
        it, over the sum of the reciprocals of their fields' weights, over one more than
        the other words in it, and a document's score is the sum of its covers. A query
        of function words alone finds nothing, as does one with a stem that no word has.
        """
        forms = self.forms(query)
        if not forms or not all(forms):
            return self.occurrences().limit(0).select("doc", F.lit(0.0).alias("score"))
        at = Window.partitionBy("doc").orderBy("pos")
        so_far = at.rowsBetween(Window.unboundedPreceding, 0)
        cost = reduce(lambda c, i: F.when(F.col("field") == i, 1 / self.weights[i]).otherwise(c), range(len(self.weights)), F.lit(1.0))
        hits = self.of([w for f in forms for w in f]).select("doc", "pos", "word", cost.alias("cost"))
        hits = hits.withColumn("i", F.row_number().over(at)).withColumn("sum", F.sum("cost").over(so_far))
        here = F.struct("i", "pos", "sum", "cost")
        # the last place of each stem so far; the first of these begins the shortest run that ends here
        last = [F.max(F.when(F.col("word").isin(f), here)).over(so_far).alias(f"l{k}") for k, f in enumerate(forms)]
        hits = hits.select("doc", "i", "pos", "sum", *last)
        begin = [F.col(f"l{k}") for k in range(len(forms))]
        every = reduce(lambda a, c: a & c, [c.isNotNull() for c in begin])
        runs = hits.where(every).withColumn("from", F.least(*begin) if len(begin) > 1 else begin[0])
        runs = runs.withColumn("before", F.lag("from.i").over(at)).where(F.col("before").isNull() | (F.col("from.i") > F.col("before")))
        size = F.col("i") - F.col("from.i")
        score = (size + 1) / (F.col("sum") - F.col("from.sum") + F.col("from.cost")) / (1 + F.col("pos") - F.col("from.pos") - size)
        return runs.groupBy("doc").agg(F.round(F.sum(score), 6).alias("score"))

    def headlines(self, query: str, documents: DataFrame, doc: str, text: str, k: int = 10) -> DataFrame:
        """(doc, score, headline) of the k best documents; only their texts are read for the headline."""
        best = self.ranked(query).orderBy(F.desc("score"), "doc").limit(k)
        forms = self.forms(query)
        made = F.pandas_udf(lambda t: t.map(lambda x: headline(x or "", forms)), StringType())
        rows = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(F.broadcast(best), "doc")
        return rows.select("doc", "score", made("text").alias("headline"))

    def near(self, terms: list[str]) -> DataFrame:
        """(term, word, distance) of the index's words near a term; only words that share a third with it are compared.

        No letter may differ from a term of up to two letters, one of up to five, else two.
        """
        asked = self.spark.createDataFrame([(t, may_differ(t), k) for t in dict.fromkeys(terms) for k in asked_segments(t)], "term string, most int, segment string")
        asked = asked.withColumn("bucket", _bucket(F.col("segment"), self.buckets))
        found = self.spark.read.parquet(f"{self.path}/segments").join(F.broadcast(asked), ["bucket", "segment"])
        found = found.withColumn("distance", F.levenshtein("term", "word")).where(F.col("distance") <= F.col("most"))
        return found.select("term", "word", "distance").distinct()

    def fuzzy(self, terms: list[str], boosts: list[float]) -> DataFrame:
        """(doc, score): the best field's boost by its hits, which add for each term 1 less the share of its letters in which the nearest word differs."""
        near = self.near(terms).select("term", "word", (1 - F.col("distance") / F.length("term")).alias("share"), _bucket(F.col("word"), self.buckets).alias("bucket"))
        hits = self.places().join(F.broadcast(near), ["bucket", "word"])
        # a document's words of one term meet before they are shuffled
        each = hits.groupBy("doc", "field", "term").agg(F.max("share").alias("share"))
        fields = each.groupBy("doc", "field").agg(F.sum("share").alias("share"))
        boost = F.element_at(F.array(*map(F.lit, boosts)), F.col("field") + 1)
        return fields.groupBy("doc").agg(F.round(F.max(boost * F.col("share")), 6).alias("score"))


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a list of words for each field, as rows (word, doc, field, pos, first) of each word of a field."""
    for whole in batches:
        for at in range(0, len(whole), STEP_DOCUMENTS):
            batch = whole.slice(at, STEP_DOCUMENTS)
            begin, values, rows, places, fields = np.zeros(len(batch), np.int64), [], [], [], []
            for i in range(1, batch.num_columns):
                column = batch.column(i)
                n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
                values.append(pc.list_flatten(column))
                rows.append(np.repeat(np.arange(len(batch)), n))
                places.append(np.arange(n.sum()) + np.repeat(begin + 1 - (np.cumsum(n) - n), n))
                fields.append(np.full(n.sum(), i - 1, np.int32))
                begin += n
            coded = pa.concat_arrays(values).dictionary_encode()
            row, word, field = np.concatenate(rows), coded.indices.to_numpy(), np.concatenate(fields)
            # places are in order in each field, and fields in order
            order = np.lexsort((word, row))
            row, word, field, place = row[order], word[order], field[order], np.concatenate(places)[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
            new = first.copy()
            new[1:] |= field[1:] != field[:-1]
            cut = np.flatnonzero(new)
            pos = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.record_batch({"word": coded.dictionary.take(pa.array(word[cut])), "doc": batch.column(0).take(pa.array(row[cut])), "field": pa.array(field[cut], pa.int32()), "pos": pos, "first": pa.array(first[cut])})


def build_index(documents: DataFrame, path: str, fields: dict[str, float], doc: str = "doc_id", buckets: int = 32, spread: int = 4) -> FullTextIndex:
    """Writes the index of the fields, each with its weight, of the documents in path.

    Rows of a word go to its directory from `spread` tasks, so that a word of very
    many documents isn't one task's. A null field has no words; a null id keeps its rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc).alias("doc"), *(words_of(F.col(c)).alias(f"w{i}") for i, c in enumerate(fields)))
    kind = dict(rows.dtypes)["doc"]
    every = rows.mapInArrow(_by_word, f"word string, doc {kind}, field int, pos array<int>, first boolean")
    every = every.withColumn("bucket", _bucket(F.col("word"), buckets)).withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(spread))).repartition("bucket", "part")
    if documents.groupBy(doc).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # rows that repeat an id, or have none, are one document
        of = Window.partitionBy("bucket", "part", "word", "doc").orderBy("field")
        every = every.withColumn("first", F.row_number().over(of) == 1)
    # rows are sorted by the word alone, whose first letters Spark compares as numbers, and go to their directories in this order
    confs = {"spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": str(buckets)}
    before = {c: spark.conf.get(c) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        every.drop("part").sortWithinPartitions("word", "doc", "field").write.partitionBy("bucket").parquet(f"{path}/occurrences")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    index = FullTextIndex(spark, path, tuple(fields.values()), buckets)
    words = index.places().groupBy("word").agg(F.sum(F.size("pos")).alias("uses"), F.count_if("first").alias("docs"))
    words.select("word", stems("word").alias("stem"), "uses", "docs").write.parquet(f"{path}/words")
    thirds = index.words().select("word", F.explode(segments(F.col("word"))).alias("segment")).withColumn("bucket", _bucket(F.col("segment"), buckets))
    thirds.repartition("bucket").sortWithinPartitions("bucket", "segment").write.partitionBy("bucket").parquet(f"{path}/segments")
    return index


def headline(text: str, forms: list[list[str]]) -> str:
    """The shortest run of words with a form of each, the first of equal ones, with words after and before it up to LEAST_WORDS, cut at MOST_WORDS; forms are marked.

    Without such a run, the first 200 characters.
    """
    of = {w: k for k, f in enumerate(forms) for w in f}
    found = [(m.start(), m.end(), of.get(m[0].lower())) for m in re.finditer(r"[^\W_]+", text)]
    last: dict[int, int] = {}
    best = None
    for i, (_, _, k) in enumerate(found):
        if k is not None:
            last[k] = i
            if len(last) == len(forms) and (best is None or i - min(last.values()) < best[1] - best[0]):
                best = (min(last.values()), i)
    if best is None:
        return text[:200]
    a, b = best[0], min(best[1], best[0] + MOST_WORDS - 1)
    b = max(b, min(len(found), a + LEAST_WORDS) - 1)
    a = min(a, max(0, b + 1 - LEAST_WORDS))
    out, at = [], found[a][0]
    for s, e, k in found[a : b + 1]:
        out += [text[at:s], f"<mark>{text[s:e]}</mark>" if k is not None else text[s:e]]
        at = e
    return "".join(out)
