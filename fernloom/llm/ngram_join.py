"""N-gram Jaccard join as a grouped prefix join.

Documents are sets of 5-word shingles; equal sets are one class, represented by
its least doc_id. Shingles are ordered by class count (rarity). A class's prefix
has n - ceil(0.75 n) + 1 shingles; two linked classes share one in their prefixes.
Shingles of one class only can't be shared and go at once, and with them every
class whose whole prefix they are. Classes with the same prefix and size become
one group, and group pairs come from the postings of the prefix shingles: first
neighbours by size in each posting, and its least edited class with all others,
which connects families of near copies without all their pairs; then, of what those links have not yet connected,
the pairs that share a shingle in the shorter prefix that their two sizes allow
and pass the length and position bounds. Surviving pairs are expanded to members and verified on whole sets.

To know rarity without moving every shingle, the order puts the shingles whose
hash lies in the first half of the hash range before the others; only those, and
what a short document lacks for its prefix, are counted. Any fixed order of all
shingles gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernloom.llm.common import SPACED_LOWER, components, lists, sent, shingles, signed, table, texts, words

#: Words of a shingle; two documents are linked if 100 * intersection >= 75 * union.
SHINGLE, PERCENT = 5, 75


def _late(whole: bool):
    """Whether a token is of the second half of the hash range: hashes are signed numbers in tables."""
    return F.lit(False) if whole else F.col("token") < 0


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text."""
    for x in texts(batch):
        h, rows = shingles(words(x, SPACED_LOWER), k)
        at = np.searchsorted(rows, np.arange(len(x.at)))
        for i in range(len(x.at) - 1):
            yield x.first + i, np.unique(h[at[i] : at[i + 1]])


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def need(n, percent: int = PERCENT):
    """Least intersection of a set of n with a linked one: ceil(percent/100 * n)."""
    return (percent * n + 99) // 100


def document_classes(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, cls): cls is a 128-bit digest of the set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = zip(*((len(s), _digest(s)) for _, s in _sets(batch, k)), strict=True) if batch.num_rows else ((), ())
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary())})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n_shingles bigint, cls binary")


def _counted(documents: DataFrame, k: int, percent: int, whole: bool) -> DataFrame:
    """(rep, n, m, token): the shingles of each class that take part in the count.

    m is the number of the class's shingles in the first half of the hash range; for
    a shingle of the second half it is its rank in the order of the class. If whole,
    every shingle is counted, as if all were in the first half.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), {"row": [], "n": [], "m": [], "cls": [], "tokens": []}
            size = 0

            def block(out=out, ids=ids):
                bounds = np.cumsum([0, *map(len, out["tokens"])])
                values = signed(np.concatenate([np.zeros(0, np.uint64), *out["tokens"]]))
                return pa.record_batch({"doc_id": ids.take(pa.array(out["row"], pa.int64())), "n": pa.array(out["n"], pa.int32()), "m": pa.array(out["m"], pa.int32()), "cls": pa.array(out["cls"], pa.binary()), "tokens": lists(values, bounds, pa.int64())})

            for row, s in _sets(batch, k):
                if len(s) and ids[row].is_valid:
                    n = len(s)
                    m = n if whole else int(np.searchsorted(s, np.uint64(1 << 63)))
                    own = s[: max(m, n - need(n, percent) + 1)]
                    for name, v in zip(out, (row, n, m, _digest(s), own), strict=True):
                        out[name].append(v)
                    size += len(own)
                    if size > 1 << 19:
                        yield block()
                        out.update({name: [] for name in out})
                        size = 0
            yield block()

    kind = dict(documents.dtypes)["doc_id"]
    sets = documents.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n int, m int, cls binary, tokens array<bigint>")
    one = sets.groupBy("n", "m", "cls").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"))
    one = one.select("rep", "n", "m", F.posexplode("tokens").alias("pos", "token"))
    return one.select("rep", "n", F.when(_late(whole), F.col("pos") + 1).otherwise(F.col("m")).alias("m"), "token")


def _prefixes(documents: DataFrame, k: int, percent: int, whole: bool = False) -> DataFrame:
    """(rep, n, token, rank, alone): the prefix shingles that another class has too.

    rank counts from 1 in the order of all shingles of the class; alone is how many
    before it are known to be of this class only.
    """
    by_token = Window.partitionBy("token")
    shared = _counted(documents, k, percent, whole).withColumn("df", F.count("*").over(by_token)).where("df > 1")
    by_rep = Window.partitionBy("rep")
    late = _late(whole)
    early = F.when(~late, 1)
    ranked = shared.withColumn("alone", F.when(late, 0).otherwise(F.col("m") - F.count(early).over(by_rep)))
    ranked = ranked.withColumn("rank", F.when(late, F.col("m")).otherwise(F.col("alone") + F.row_number().over(by_rep.orderBy(late, "df", "token"))))
    return ranked.where(F.col("rank") <= F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).select("rep", "n", "token", "rank", "alone")


def _verified(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) whose whole sets are alike enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, s in _sets(batch, k):
                yield pa.record_batch({"doc_id": batch.column(0).slice(row, 1), "tokens": lists(signed(s), np.array([0, len(s)]), pa.int64())})

    kind = dict(documents.dtypes)["doc_id"]
    sets = table(documents.select("doc_id", "text").join(sent(ids), "doc_id", "left_semi").mapInArrow(of, f"doc_id {kind}, tokens array<bigint>").dropDuplicates(["doc_id"]))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("p") + F.col("q") - F.col("common"))).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _before(key: str, *order: str):
    """The row before in the key's order."""
    return F.lag(F.struct("rep", "n")).over(Window.partitionBy(key).orderBy(*order))


def _first_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) to verify first, a few for each row: neighbours by size in each posting, and all of it with its least edited class.

    The class of a posting with the fewest shingles of its own is the least edited
    one, and most of its near copies are linked with it.
    """
    along = rows.withColumn("last", _before("token", "n", "rep")).where("last is not null")
    least_edited = F.first(F.struct("rep", "n")).over(Window.partitionBy("token").orderBy("alone", "rep"))
    around = rows.withColumn("last", least_edited).where(F.col("last.rep") != F.col("rep"))
    both = [x.where(100 * F.least("n", "last.n") >= percent * F.greatest("n", "last.n")).select(*_pair("rep", "last.rep")) for x in (along, around)]
    return both[0].union(both[1])


def ngram_components(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of documents.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z went to lower case. A text of fewer
    than k words is one shingle; null, empty and blank texts have none, link with
    nothing and are their own component. A component is named by its least doc_id.
    doc_id names a document: rows that repeat one with another text are each
    placed by their own text. Rows without doc_id stay, with no component unless
    a document with an id has the same set.
    """
    prefix = table(_prefixes(documents, k, percent))
    # groups: classes with the same prefix and size
    groups = prefix.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("prefix"))
    groups = table(groups.withColumn("group", F.xxhash64("n", F.to_json("prefix"))).withColumn("group", F.min("rep").over(Window.partitionBy("n", "group", F.sha2(F.to_json("prefix"), 256)))).select("rep", "n", "group"))
    leaders = prefix.join(groups.where("rep = group").select("rep"), "rep", "left_semi")
    inside = groups.withColumn("last", _before("group", "rep")).where("last is not null").select(*_pair("rep", "last.rep"))
    pairs = table(inside.union(_first_pairs(leaders, percent)).distinct())
    edges = table(_verified(pairs, documents, k, percent))
    comp = table(_labels(prefix, edges))
    # the classes with a shingle that not yet connected ones share: their rarity is counted anew, among them and
    # on all shingles, so that what an edit made unique counts in full
    post = prefix.join(comp, "rep")
    open_tokens = post.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    loose = table(post.join(open_tokens, "token", "left_semi").select(F.col("rep").alias("doc_id")).distinct())
    again = _prefixes(documents.join(sent(loose), "doc_id", "left_semi").select("doc_id", "text"), k, percent, whole=True)
    again = table(again)
    more = _first_pairs(again, percent).distinct()
    for end in ("a", "b"):
        more = more.join(comp.select(F.col("rep").alias(end), F.col("comp").alias(f"c{end}")), end)
    more = table(more.where("ca <> cb").select("a", "b"))
    if more.limit(1).count():
        edges = table(edges.union(_verified(more, documents, k, percent)))
        comp = table(_labels(prefix, edges))
    post = table(again.join(comp, "rep").select("token", "rep", "n", "comp", "rank", "alone"))
    x = post.select("token", F.col("rep").alias("a"), F.col("n").alias("p"), F.col("comp").alias("ca"), F.col("rank").alias("i"), F.col("alone").alias("ua"))
    y = post.select("token", F.col("rep").alias("b"), F.col("n").alias("q"), F.col("comp").alias("cb"), F.col("rank").alias("j"), F.col("alone").alias("ub"))
    ordered = (F.col("p") < F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("a") < F.col("b")))
    length = 100 * F.col("p") >= percent * F.col("q")
    least = F.ceil((F.col("p") + F.col("q")) * percent / (100 + percent))  # shared shingles that a link of these sizes has
    prefix_of_pair = (F.col("i") <= F.col("p") - least + 1) & (F.col("j") <= F.col("q") - least + 1)
    position = F.least(F.col("i") - F.col("ua"), F.col("j") - F.col("ub")) + F.least(F.col("p") - F.col("i"), F.col("q") - F.col("j")) >= least
    cross = table(x.join(y, (x["token"] == y["token"]) & (F.col("ca") != F.col("cb")) & ordered & length & prefix_of_pair & position).select("a", "b").distinct())
    if cross.limit(1).count():
        edges = table(edges.union(_verified(cross, documents, k, percent)))
        comp = table(_labels(prefix, edges))
    docs = document_classes(documents, k)
    classes = docs.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "cls").agg(F.min("doc_id").alias("rep"))
    placed = classes.join(comp, "rep", "left").select("n_shingles", "cls", F.coalesce("comp", "rep").alias("component_id"))
    out = docs.join(placed, ["n_shingles", "cls"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _labels(prefix: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, comp) of every class that has a prefix shingle."""
    reps = prefix.select("rep").distinct()
    if not edges.limit(1).count():
        return reps.select("rep", F.col("rep").alias("comp"))
    return reps.join(components(edges).select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB: shingles as text, all pairs that share one, and reachability.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
