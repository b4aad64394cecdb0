r"""Line dedup as an exact set-similarity self-join.

A line's tokens are its distinct words. Lines with the same set are one class,
represented by the first of them; its other lines go without any join. Tokens are
ordered by rarity: those of the bounded table of the most frequent ones come last,
by their count over all texts, the others first, by hash. Two sets with a Jaccard of
at least 0.75 share a token in prefixes whose lengths follow from the two sizes
(prefix filter); their sizes differ by at most a quarter (length filter), and from
the place of the first shared token on each must have enough tokens left
(positional filter). A parity of each set (90 bits, of larger sets 218) bounds the
symmetric difference from below, which drops most pairs of unlike lines inside the
join. Pairs are verified on whole sets. A line goes if a line before it is similar enough.

Only whether such a line exists counts, so a family of near copies isn't expanded
into pairs: each line is first verified against one line before it, of the first
and the least edited ones with two of the same least hashes the one of the nearest
parity, or where that fails against another. Only the lines that this leaves open are
joined with all: a token's lines come to one task, which compares those of fitting sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.llm.common import SPACED_LOWER, Texts, Words, lists, mixed, sent, signed, table, texts, words

#: Jaccard of two lines from which the later one goes.
PERCENT = 75
#: The most frequent tokens, whose order by count is known everywhere: 8 bytes each.
FREQUENT = 1 << 18
#: Distinct tokens that a task counts before it passes the counts on.
COUNTED = 1 << 22
#: Least hashes of a set, by two of which a first line to compare with is looked up; they leave out the more frequent three eighths of the set.
SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
#: Bits that number the groups which one sort puts in order; with more groups it takes three.
GROUP_BITS = 18
#: Tokens of sets from which 90 bits of parity say little: 64 of these are then told apart by thirds of the tokens.
WIDE = 96
#: Tokens of sets that are too large for any of their parities to say much, and how many prefix tokens, of prefixes longer by as many less one, two of them must share.
LONG, SHARED = 256, 3
#: Lines of a key that a line is compared with where the first and the least edited one differ too much.
PICKS = 3
#: Bits of a set's size, beside which it has 26 of the parity, and of a place in it; larger sizes count as the greatest and aren't bounded by place.
SIZE_BITS, PLACE_BITS = 20, 18
#: Bits of the place that a posting has beside its token and size; larger places count as the greatest.
POST_BITS = 12
#: Postings of a part (50 bytes each), parts at least, and pairs that are compared at once.
POSTS, PARTS, PAIRS = 1 << 19, 64, 1 << 19
#: Removed or repeated lines (16 bytes each) up to which they are sent to the executors; beyond, they are joined by shuffle.
SEND_LINES = 1 << 20
#: Keys of families (60 bytes each) up to which they are sent.
SEND_KEYS = 1 << 18


class LineSets(NamedTuple):
    """Rows and numbers of the lines that have words; their token sets, each sorted by rarity; where each set starts."""

    row: np.ndarray
    line: np.ndarray
    tokens: np.ndarray
    ranks: np.ndarray
    cuts: np.ndarray

    def within(self) -> np.ndarray:
        """Place of each token in its set."""
        return np.arange(len(self.tokens)) - np.repeat(self.cuts[:-1], np.diff(self.cuts))


class Frequent:
    """Where each of the most frequent tokens stands in their order, least frequent first, by a hash table of twice their number at least."""

    def __init__(self, order: np.ndarray):
        bits = max(4, (2 * len(order)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.tokens, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.flatnonzero(order), order[order != 0] & self.mask
        while len(left):
            free, first = np.unique(slot, return_index=True)
            first = first[self.ranks[free] < 0]
            self.tokens[slot[first]], self.ranks[slot[first]] = order[left[first]], left[first]
            stays = np.ones(len(left), bool)
            stays[first] = False
            left, slot = left[stays], slot[stays] + np.uint64(1) & self.mask

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each token, -1 for the others."""
        slot = tokens & self.mask
        there = self.tokens[slot]
        rank = np.where(there == tokens, self.ranks[slot], -1)
        left = np.flatnonzero((there != tokens) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = slot + np.uint64(1) & self.mask
            there = self.tokens[slot]
            same = there == tokens[left]
            rank[left[same]] = self.ranks[slot[same]]
            on = ~same & (there != 0)
            left, slot = left[on], slot[on]
        return rank


def _sets(group: np.ndarray, tokens: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each group (numbers that don't fall), rare ones first, their ranks (-1: none), and where each group starts."""
    order = None
    if len(group) and group[-1] < 1 << GROUP_BITS:
        # one sort by group, rank and the upper bits of the hash will do where no two hashes have the same ones
        low = 63 - GROUP_BITS
        key = np.where(rank < 0, tokens >> np.uint64(65 - low), rank.astype(np.uint64) | np.uint64(1 << low - 1))
        key |= group.astype(np.uint64) << np.uint64(low)
        order = np.argsort(key)
        if ((key[order[1:]] == key[order[:-1]]) & (tokens[order[1:]] != tokens[order[:-1]])).any():
            order = None
    if order is None:
        order = np.lexsort((tokens, rank, group))
    group, tokens, rank = group[order], tokens[order], rank[order]
    keep = np.ones(len(tokens), bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])
    group, tokens, rank = group[keep], tokens[keep], rank[keep]
    return tokens, rank, np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64), len(tokens))


def _line_sets(x: Texts, w: Words, frequent: Frequent) -> LineSets:
    """The line sets of some texts. w: the words of x."""
    breaks = np.flatnonzero(x.data == 10)
    line, row = np.searchsorted(breaks, w.starts), w.rows()
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    tokens, rank, cuts = _sets(np.cumsum(new), w.hashes, frequent.of(w.hashes))
    return LineSets(row[at], line[at] - np.searchsorted(breaks, x.at[:-1])[row[at]], tokens, rank, cuts)


def frequent_tokens(documents: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The most frequent tokens, least frequent first. Which they are changes only the order.

    Every text is counted; a task passes on what it has counted twice or more, so a
    count is short by at most one for each task.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, size = [], [], 0

        def summed():
            key, back = np.unique(np.concatenate(tokens), return_inverse=True)
            return key, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for x in texts(batch):
                key, n = np.unique(words(x, SPACED_LOWER).hashes, return_counts=True)
                tokens.append(key)
                counts.append(n)
                size += len(key)
                if size > COUNTED:
                    key, n = summed()
                    if len(key) > COUNTED // 2:
                        yield pa.record_batch({"token": signed(key)[n > 1], "n": n[n > 1]})
                        key, n = key[:0], n[:0]
                    tokens, counts, size = [key], [n], len(key)
        if tokens:
            key, n = summed()
            yield pa.record_batch({"token": signed(key)[n > 1], "n": n[n > 1]})

    counts = documents.select("text").mapInArrow(of, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()["token"].to_numpy()
    return top[::-1].astype(np.int64).view(np.uint64)


def _lines(documents: DataFrame, percent: int, order: np.ndarray) -> DataFrame:
    """(n, c1, c2, parity, size, thirds, edits, keys, doc_id, line, prefix) of each line with a word.

    c1 and c2 are two digests of its set, parity 64 bits of the set's parity and size
    another 26 with the number of its tokens; thirds is null for sets below WIDE, else has the
    parities of two thirds of the tokens, of which the third one's follows; edits grows with the rarity of the words; keys are pairs of least hashes,
    of which similar sets mostly share some; prefix has 31 bits of each of the prefix tokens.
    """
    # by rank: how rare a token is, the last one for tokens without rank
    rarity = np.log2(1 + np.append(np.arange(len(order))[::-1], len(order)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(order)
        for batch in batches:
            for x in texts(batch):
                s = _line_sets(x, words(x, SPACED_LOWER), frequent)
                if not len(s.tokens):
                    continue
                n, begin, t = np.diff(s.cuts), s.cuts[:-1], s.tokens
                digests = [np.add.reduceat(mixed(t * np.uint64(c) + np.uint64(c)), begin) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                # a token turns one of the bits of the two numbers
                third, bit = np.divmod(t, np.uint64(128 - SIZE_BITS - PLACE_BITS))
                own, turned = bit < 64, np.uint64(1) << bit % np.uint64(64)
                parity, extra = (np.bitwise_xor.reduceat(np.where(some, turned, np.uint64(0)), begin) for some in (own, ~own))
                wide = np.flatnonzero(n >= WIDE)
                in_wide = np.repeat(n >= WIDE, n)
                own, turned, third = own[in_wide], turned[in_wide], third[in_wide] % np.uint64(3)
                at = np.append(0, np.cumsum(n[wide]))[:-1]
                thirds = [np.bitwise_xor.reduceat(np.where(own & (third == k), turned, np.uint64(0)), at) if len(wide) else np.zeros(0, np.uint64) for k in (0, 1)]
                bounds = np.append(0, np.cumsum(n >= WIDE))
                size = extra << np.uint64(SIZE_BITS + PLACE_BITS) | np.minimum(n, (1 << SIZE_BITS) - 1).astype(np.uint64)
                within = s.within()
                some = np.minimum(n, n - (percent * n + 99) // 100 + 1 + np.where(n >= LONG, SHARED - 1, 0))
                prefix = within < np.repeat(some, n)
                common = np.where(within < np.repeat(np.maximum(1, 5 * n // 8), n), np.uint64(0), np.uint64(1 << 63))
                least = [np.minimum.reduceat(mixed(t ^ np.uint64(c)) >> np.uint64(1) | common, begin) for c in SEEDS]
                keys = [mixed(a * np.uint64(0x9E3779B97F4A7C15) + b) for a, b in combinations(least, 2)]
                # the mean rarity of a line's words: in a family of near copies the less a line is edited, the less
                edits = 1000 * np.add.reduceat(rarity[s.ranks], begin) / n
                yield pa.record_batch(
                    {
                        "n": pa.array(n, pa.int32()),
                        "c1": signed(digests[0]),
                        "c2": signed(digests[1]),
                        "parity": signed(parity),
                        "size": signed(size),
                        "thirds": pa.StructArray.from_arrays([pa.array(signed(x)).take(pa.array(bounds[:-1], mask=n < WIDE)) for x in thirds], ["p", "q"], mask=pa.array(n < WIDE)),
                        "edits": pa.array(edits.astype(np.int32), pa.int32()),
                        "keys": lists(signed(np.stack(keys, 1).ravel()), len(keys) * np.arange(len(n) + 1), pa.int64()),
                        "doc_id": batch.column(0).take(pa.array(s.row + x.first)),
                        "line": pa.array(s.line, pa.int32()),
                        "prefix": lists((t[prefix] >> np.uint64(33)).astype(np.int32), np.append(0, np.cumsum(some)), pa.int32()),
                    }
                )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(of, f"n int, c1 bigint, c2 bigint, parity bigint, size bigint, thirds struct<p: bigint, q: bigint>, edits int, keys array<bigint>, doc_id {kind}, line int, prefix array<int>")


def _bits(c: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << n) - 1))


def _n(side: str) -> Column:
    """Tokens of a side's set."""
    return _bits(F.col(f"{side}.size"), 0, SIZE_BITS)


def _apart(thirds: bool = False) -> Column:
    """Tokens that the sets of a pair don't share, at least; thirds: told by p and q too where both sets are large."""
    low = SIZE_BITS + PLACE_BITS
    parity, p, q = (F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in ("parity", "p", "q"))
    of = F.coalesce(F.bit_count(p) + F.bit_count(q) + F.bit_count(parity.bitwiseXOR(p).bitwiseXOR(q)), F.bit_count(parity)) if thirds else F.bit_count(parity)
    return of + F.bit_count(F.shiftrightunsigned(F.col("x.size"), low).bitwiseXOR(F.shiftrightunsigned(F.col("y.size"), low)))


def _common(percent: int) -> Column:
    """Tokens that the sets of a pair must share."""
    return F.ceil((_n("x") + _n("y")) * percent / (100 + percent))


def _alike(percent: int, thirds: bool = False) -> Column:
    """The length filter, and what the parities leave possible."""
    length = 100 * F.least(_n("x"), _n("y")) >= percent * F.greatest(_n("x"), _n("y"))
    return length & (_apart(thirds) <= _n("x") + _n("y") - 2 * _common(percent))


def _before() -> Column:
    return (F.col("x.doc_id") < F.col("y.doc_id")) | ((F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.line") < F.col("y.line")))


def _pair() -> list[Column]:
    return [F.col("x.doc_id").alias("a"), F.col("x.line").alias("al"), F.col("y.doc_id").alias("b"), F.col("y.line").alias("bl")]


def _keyed(rows: DataFrame) -> DataFrame:
    """The lines under each of their keys in their size class, where another line has the key too."""
    keyed = rows.select("doc_id", "line", "parity", "size", "edits", F.floor(F.log("n") / F.log(F.lit(4 / 3))).alias("class"), F.explode("keys").alias("key"))
    keyed = keyed.select("doc_id", "line", "parity", "size", "edits", F.xxhash64("class", "key").alias("key"))
    shared = table(keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"))
    return table(keyed.join(sent(shared, SEND_KEYS), "key", "left_semi"))


def _some_pairs(asked: DataFrame, keyed: DataFrame, by: list[Column], percent: int) -> DataFrame:
    """Pairs of the asked lines with lines before that are the least of their key, by any of some columns, with what the parities say."""
    least = [F.min(F.struct(c.alias("by"), "doc_id", "line", "parity", "size")).dropFields("by").alias(f"x{i}") for i, c in enumerate(by)]
    first = keyed.groupBy("key").agg(*least)
    first = table(first.select("key", F.explode(F.array_distinct(F.array(*(f"x{i}" for i in range(len(by)))))).alias("x")).select("key", "x.*"))
    near = asked.alias("y").join(sent(first, SEND_KEYS).alias("x"), "key").where(_before() & _alike(percent))
    return near.select(*_pair(), _apart().alias("apart"))


def later_lines(documents: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, line): the lines of each document, numbered from 0, that a line before is similar to."""
    docs = documents.select("doc_id", "text").where("doc_id is not null")
    order = frequent_tokens(docs, frequent)
    lines = table(_lines(docs, percent, order))
    here = ["doc_id", "line"]
    many = table(lines.groupBy("n", "c1", "c2").agg(F.count("*").alias("many")).where("many > 1").drop("many"))
    same = table(lines.select("n", "c1", "c2", *here).join(sent(many, SEND_LINES), ["n", "c1", "c2"]))
    first = same.groupBy("n", "c1", "c2").agg(F.min(F.struct(*here)).alias("at"))
    copies = table(same.join(first, ["n", "c1", "c2"]).where(F.struct(*here) != F.col("at")).select(*here, "c1"))
    rows = lines.join(sent(copies, SEND_LINES), [*here, "c1"], "left_anti")
    keyed = _keyed(rows)

    def nearest(found: DataFrame) -> DataFrame:
        """Of each line's pairs that of the nearest parity."""
        return table(found.groupBy("b", "bl").agg(F.min(F.struct("apart", "a", "al")).alias("x")).select("x.a", "x.al", "b", "bl"))

    # a line before under the same keys: of the first and the least edited ones that of the nearest parity
    tried = nearest(_some_pairs(keyed, keyed, [F.struct(*here), F.col("edits")], percent))
    gone = table(_verified(tried, docs, percent).distinct())
    # where that one differs too much, the nearest of some others that hashes pick
    asked = table(tried.select(F.col("b").alias("doc_id"), F.col("bl").alias("line")).join(sent(gone, SEND_LINES), here, "left_anti"))
    asked = table(keyed.join(sent(asked, SEND_LINES), here, "left_semi"))
    pairs = _some_pairs(asked, keyed.join(sent(table(asked.select("key").distinct())), "key", "left_semi"), [F.xxhash64(*here, F.lit(i)) for i in range(PICKS)], percent)
    pairs = nearest(pairs.join(sent(tried), ["a", "al", "b", "bl"], "left_anti"))
    gone = table(gone.union(_verified(pairs, docs, percent)).distinct())
    # then the lines that this leaves open with each other and with those that went
    posts = rows.join(sent(gone.withColumn("went", F.lit(True)), SEND_LINES), here, "left")
    parts = int(lines.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100 // POSTS
    parts = max(PARTS, parts)
    near = _verified(table(_sharing(posts, percent, parts)), docs, percent)
    return copies.select(*here).union(gone).union(near).distinct()


def _sharing(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, al, b, bl) of the pairs of lines, the later one not among those that went, that share enough prefix tokens and of which no filter says that they differ too much.

    A token's lines come to one task, where each is compared with those of fitting sizes
    alone.
    """
    n, low = _bits(F.col("size"), 0, SIZE_BITS), SIZE_BITS + PLACE_BITS
    place = F.least(F.col("i"), F.lit((1 << POST_BITS) - 1)).cast("long")
    key = F.shiftleft(F.col("token").cast("long"), SIZE_BITS + POST_BITS).bitwiseOR(F.shiftleft(n, POST_BITS)).bitwiseOR(place)
    # beside the line's number whether it went, and the rest of its parity
    line = F.shiftleft(_bits(F.col("size"), low, 64 - low), low).bitwiseOR(F.when(F.col("went"), 1 << 32).otherwise(0)).bitwiseOR(F.col("line").cast("long"))
    posts = rows.select("doc_id", line.alias("line"), "parity", "size", *(F.coalesce(f"thirds.{c}", F.lit(0)).alias(c) for c in ("p", "q")), F.posexplode("prefix").alias("i", "token"))
    posts = posts.select("line", key.alias("key"), "parity", "doc_id", "p", "q").repartition(parts, F.shiftright("key", SIZE_BITS + POST_BITS))
    kind = dict(rows.dtypes)["doc_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = list(batches)
        if part:
            yield from _shared_tokens(pa.Table.from_batches(part).combine_chunks(), percent)

    found = posts.mapInArrow(of, f"a {kind}, al int, a_went boolean, b {kind}, bl int, b_went boolean, least int")
    x, y = (F.struct(F.col(d).alias("doc_id"), F.col(f"{d}l").alias("line"), F.col(f"{d}_went").alias("went")) for d in ("a", "b"))
    found = found.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "least").where("not y.went")
    found = found.groupBy(*_pair(), "least").agg(F.count("*").alias("shared"))
    return found.where("shared >= least").select("a", "al", "b", "bl")


def _shared_tokens(posts: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, al, a_went, b, bl, b_went, least): the pairs of lines that share a token of both prefixes, once for each; least: how many must be shared."""
    key = posts["key"].to_numpy()
    order = np.argsort(key)
    key, line = key[order], posts["line"].to_numpy()[order]
    parity, p, q = (posts[c].to_numpy()[order].view(np.uint64) for c in ("parity", "p", "q"))
    extra, went, line = line.view(np.uint64) >> np.uint64(SIZE_BITS + PLACE_BITS), line & 1 << 32 != 0, line.astype(np.int32)
    doc = posts["doc_id"].combine_chunks()
    n, place, token = key >> POST_BITS & (1 << SIZE_BITS) - 1, key & (1 << POST_BITS) - 1, key >> SIZE_BITS + POST_BITS
    # of each line the smaller ones, or equal ones before it, of fitting sizes
    begin = np.searchsorted(key, token << SIZE_BITS + POST_BITS | -(-n * percent // 100) << POST_BITS)
    upto = np.append(0, np.cumsum(np.arange(len(key)) - begin))
    i = 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
        y = np.repeat(np.arange(i, j), np.diff(upto[i : j + 1]))
        x = begin[y] + np.arange(len(y)) - (upto[y] - upto[i])
        for test in (
            lambda: np.bitwise_count(parity[x] ^ parity[y]) + np.bitwise_count(extra[x] ^ extra[y]).astype(np.int64) <= n[x] + n[y] - 2 * _must_share(n[x], n[y], percent),
            lambda: ~(went[x] & went[y]),
            lambda: _within(n[x], n[y], place[x], percent) & _within(n[y], n[x], place[y], percent),
            lambda: (np.minimum(n[x], n[y]) < WIDE) | (_thirds_apart(parity[x] ^ parity[y], p[x] ^ p[y], q[x] ^ q[y]) + np.bitwise_count(extra[x] ^ extra[y]) <= n[x] + n[y] - 2 * _must_share(n[x], n[y], percent)),
        ):
            ok = test()
            x, y = x[ok], y[ok]
        # two tokens of one line may have the same 31 bits
        a, b = (doc.take(pa.array(order[at])) for at in (x, y))
        other = (line[x] != line[y]) | pc.not_equal(a, b).to_numpy(zero_copy_only=False)
        least = np.where(np.minimum(n[x], n[y]) >= LONG, SHARED, 1)
        found = pa.record_batch({"a": a, "al": line[x], "a_went": went[x], "b": b, "bl": line[y], "b_went": went[y], "least": pa.array(least, pa.int32())})
        if len(found):
            yield found.filter(pa.array(other))
        i = j


def _must_share(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that sets of n and m must share."""
    return -(-(n + m) * percent // (100 + percent))


def _within(n: np.ndarray, m: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Whether from a place in sets of n on enough tokens are left to share with sets of m."""
    shared = np.where(np.minimum(n, m) >= LONG, SHARED, 1)
    return (n == (1 << SIZE_BITS) - 1) | (place < n - _must_share(n, m, percent) + shared)


def _thirds_apart(parity: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(c).astype(np.int64) for c in (p, q, parity ^ p ^ q))


def _verified(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line) of the later line of those pairs whose sets are alike enough."""
    wanted = pairs.select(F.col("a").alias("doc_id"), F.col("al").alias("line")).union(pairs.select("b", "bl")).distinct()
    wanted = table(wanted.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("lines")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in texts(batch):
                w = words(x, SPACED_LOWER)
                tokens, _, cuts = _sets(w.rows(), w.hashes, np.full(len(w.hashes), -1))
                some = pa.array(np.unique(w.rows()) + x.first)
                yield pa.record_batch({"doc_id": batch.column(0).take(some), "line": batch.column(1).take(some), "tokens": lists(signed(tokens), cuts, pa.int64())})

    kind = dict(documents.dtypes)["doc_id"]
    # the wanted lines alone go to Python
    numbered = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i.alias("line"), t.alias("text")))
    picked = documents.join(sent(wanted), "doc_id").select("doc_id", F.explode(F.filter(numbered, lambda s: F.array_contains("lines", s["line"]))).alias("s")).select("doc_id", "s.*")
    sets = picked.mapInArrow(of, f"doc_id {kind}, line int, tokens array<bigint>").repartition("doc_id", "line").distinct()
    both = pairs.join(sets.toDF("a", "al", "s"), ["a", "al"]).join(sets.toDF("b", "bl", "t"), ["b", "bl"])
    both = both.select("b", "bl", F.size("s").alias("p"), F.size("t").alias("q"), F.size(F.array_intersect("s", "t")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("p") + F.col("q") - F.col("common"))).select(F.col("b").alias("doc_id"), F.col("bl").alias("line"))


def line_dedup(documents: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    r"""Each row of documents with kept (its text without later similar lines), n_lines and n_removed.

    Lines end at \n; words are `[^\x20\x09-\x0D]+` after A-Z went to lower case. A
    line with a word goes if a line before it, in a document of smaller doc_id or
    above it in its own, has a Jaccard of distinct words of percent/100 or more;
    lines are judged on the input. Lines without a word stay. Null texts have no
    line and kept is null; an empty text has one empty line, which stays. Rows that
    repeat a doc_id are judged as one document: a line at the same place in both
    is the same line, which goes if it does in either. Rows without doc_id stay as
    they are. Extra columns stay, but for those named like a new one, which it
    replaces.
    """
    made = ["kept", "n_lines", "n_removed"]
    names = [c for c in documents.columns if c not in made]
    documents = documents.select(*names)
    gone = table(later_lines(documents, percent, frequent))
    few = gone.limit(SEND_LINES + 1).count() <= SEND_LINES
    gone = gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("_fernloom_lines"))
    gone = F.broadcast(gone) if few else gone
    lines = F.split("text", "\n", -1)
    stay = F.when(F.col("_fernloom_lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_fernloom_lines", i)), "\n"))
    out = documents.join(gone, "doc_id", "left")
    return out.select(
        *names, stay.alias("kept"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("_fernloom_lines").isNull(), 0).otherwise(F.size("_fernloom_lines")).cast("long").alias("n_removed")
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB: word sets of the lines, pairs that share a word of both prefixes, whole sets compared.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
i AS (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM d WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(translate(l[i + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM i),
c AS MATERIALIZED (SELECT w, min({'d': doc_id, 'i': i}) AS pos, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
f AS (SELECT word, count(*) AS df FROM (SELECT unnest(w) AS word FROM c) GROUP BY word),
u AS (SELECT pos, n, word, row_number() OVER (PARTITION BY pos ORDER BY df, word) AS r FROM (SELECT pos, n, unnest(w) AS word FROM c) JOIN f USING (word)),
p AS MATERIALIZED (SELECT pos, n, word FROM u WHERE r <= n - (75 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT x.pos AS a, y.pos AS b FROM p x JOIN p y ON x.word = y.word AND x.pos < y.pos AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)),
g AS (SELECT DISTINCT b FROM q JOIN c x ON x.pos = a JOIN c y ON y.pos = b WHERE 100 * len(list_intersect(x.w, y.w)) >= 75 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
r AS (SELECT s.doc_id, s.i FROM s JOIN c USING (w) LEFT JOIN g ON g.b = c.pos WHERE c.pos <> {'d': s.doc_id, 'i': s.i} OR g.b IS NOT NULL),
k AS (SELECT doc_id, count(*) FILTER (r.i IS NOT NULL) AS gone, string_agg(l[i + 1], chr(10) ORDER BY i) FILTER (r.i IS NULL) AS kept FROM i LEFT JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
