r"""Personal data by a skip-chain conditional random field over digit groups and addresses.

Base expressions find e-mail and IP addresses, card and phone numbers. They also
label, as distant supervision, a bounded sample of documents, on which the field is
trained. Its nodes are the addresses of a document and its runs of digit groups,
joined over spaces, brackets, dots and hyphens. A node's features are its shape, its
checksum and the words before and after it. Neighbouring nodes share a transition
potential. Nodes that are equal or alike (the same last seven digits, the same local
part) share a skip potential however far apart they are. All potentials are learned.
Loopy message passing over both kinds of edges makes labels agree over the whole
document, so a number written once as a phone number is found where it stands
without its sign or area code. Nodes that the field marks add spans, in documents
without base spans too; base spans always stay.

Equal nodes are linked in a ring of neighbours, not in all pairs, so the work is
linear in the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fernloom.llm.common import texts
from fernloom.llm.secrets import SPANS, joined

KINDS = ("email", "ip", "card", "phone")
#: Documents of which the field is trained, those of least hash of doc_id; a bound, whatever the input.
SAMPLE = 4000
#: Belief from which a node that no base expression covers is added.
SURE = 0.9
#: Log odds against the other labels of a node that a base expression covers.
KNOWN = 20.0
#: Digits at the end that make two numbers alike, and digits beyond which a run is taken apart at its spaces.
ALIKE, MOST_DIGITS = 7, 19
#: Hashes of the patterns of digit groups and of the words on each side.
PATTERNS, CONTEXT = 64, 128

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
# a run of digits that fails at its start fails further on too
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_@])\+?\(?[0-9]+(?:[\x20().-]{1,2}[0-9]+)*(?![A-Za-z0-9_@])")
_GROUP = re.compile("[0-9]+")
_PART = re.compile(r"[^\x20]+")
_HOST = re.compile(r"@[A-Za-z0-9.-]+")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*$")
_WORD_AFTER = re.compile(r"^[^\w]*([^\W\d_]+)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base expressions, sorted."""
    out, end = [], 0
    # an e-mail address starts with the whole run of its characters before the at sign, from the last match's end on
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Nodes(NamedTuple):
    """The candidates of a text: their ranges, features (a row of 0 and 1 each), and keys by which equal and similar ones are linked."""

    starts: list[int]
    ends: list[int]
    features: np.ndarray
    keys: list[str | None]


SHAPES = ("bias", "at", "host_dot", "dotted_four", "bytes", "plus", "bracket", "hyphen", "space", "checksum", "digits4", "digits6", "digits8", "digits11", "digits14", "digits16", "digits19", "groups1", "groups2", "groups3", "groups4", "groups5")
N_FEATURES = len(SHAPES) + PATTERNS + 2 * CONTEXT


def _hashed(value: str, n: int) -> int:
    return zlib.crc32(value.encode("utf-8", "replace")) % n


def _ranges(text: str) -> list[tuple[int, int]]:
    """Where the candidates stand."""
    out, end = [], 0
    for m in _HOST.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        end = m.start() + len(m.group().rstrip(".-"))
        if start < m.start():
            out.append((start, end))
    for m in _NUMBER.finditer(text):
        if sum("0" <= c <= "9" for c in m.group()) > MOST_DIGITS:
            out += [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m.group())]
        else:
            out.append(m.span())
    out.sort()
    # the digits of an address are no node of their own
    return [r for i, r in enumerate(out) if i == 0 or r[0] >= out[i - 1][1]]


def nodes(text: str) -> Nodes:
    starts, ends, rows, keys = [], [], [], []
    for a, b in _ranges(text):
        t = text[a:b]
        groups = _GROUP.findall(t)
        digits = "".join(groups)
        on = {"bias"}
        if "@" in t:
            on |= {"at"} | ({"host_dot"} if "." in t[t.index("@") :] else set())
            local = t[: t.index("@")].lower()
            keys.append(f"@{local}" if len(local) > 2 else None)
        else:
            dotted = t.count(".") == 3 and len(groups) == 4 and t.replace(".", "").isdigit()
            on |= {name for name, there in (("dotted_four", dotted), ("bytes", dotted and all(len(g) <= 3 and int(g) <= 255 for g in groups)), ("plus", t[0] == "+"), ("bracket", "(" in t), ("hyphen", "-" in t), ("space", " " in t), ("checksum", 12 <= len(digits) <= 19 and luhn(digits))) if there}
            on |= {next((f"digits{k}" for k in (4, 6, 8, 11, 14, 16) if len(digits) <= k), "digits19"), f"groups{min(len(groups), 5)}"}
            keys.append(t if dotted else digits[-ALIKE:] if len(digits) >= ALIKE else None)
        row = np.zeros(N_FEATURES)
        row[[SHAPES.index(x) for x in on]] = 1
        row[len(SHAPES) + _hashed("@" if "@" in t else ",".join(str(len(g)) for g in groups), PATTERNS)] = 1
        for i, m in enumerate((_WORD_BEFORE.search(text[max(0, a - 24) : a]), _WORD_AFTER.search(text[b : b + 24]))):
            if m:
                row[len(SHAPES) + PATTERNS + i * CONTEXT + _hashed(m[1].lower(), CONTEXT)] = 1
        starts.append(a)
        ends.append(b)
        rows.append(row)
    return Nodes(starts, ends, np.array(rows).reshape(len(rows), N_FEATURES), keys)


def edges(n: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbours, and skip edges from each node to the one before of the same key."""
    chain = [(i - 1, i) for i in range(1, len(n.starts))]
    last: dict[str, int] = {}
    skip = []
    for i, k in enumerate(n.keys):
        if k is not None:
            if k in last:
                skip.append((last[k], i))
            last[k] = i
    return np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2)


class Field(NamedTuple):
    """Log potentials: features by label (none, then KINDS), transitions, and agreement of skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def beliefs(n: Nodes, field: Field, observed: np.ndarray | None = None, rounds: int = 10) -> np.ndarray:
    """Label probabilities of each node by loopy message passing. observed: labels that are known, 0 where none is."""
    own = n.features @ field.unary
    if observed is not None:
        known = np.flatnonzero(observed)
        own[known] = -KNOWN
        own[known, observed[known]] = 0
    chain, skip = edges(n)
    pairs = np.concatenate([chain, skip])
    if len(n.starts) == 0 or not len(pairs):
        return np.exp(own - np.logaddexp.reduce(own, 1, keepdims=True))
    potential = np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)])
    to = np.concatenate([pairs[:, 1], pairs[:, 0]])
    of = np.concatenate([pairs[:, 0], pairs[:, 1]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(to), own.shape[1]))
    for _ in range(rounds):
        total = own.copy()
        np.add.at(total, to, message)
        new = np.logaddexp.reduce((total[of] - message[back])[:, :, None] + potential, 1)
        message = 0.5 * message + 0.5 * (new - np.logaddexp.reduce(new, 1, keepdims=True))
    np.add.at(own, to, message)
    return np.exp(own - np.logaddexp.reduce(own, 1, keepdims=True))


def labels(n: Nodes, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each node from the spans that cover it; 0 is none."""
    out = np.zeros(len(n.starts), int)
    j = 0
    for i, (a, b) in enumerate(zip(n.starts, n.ends, strict=True)):
        while j < len(spans) and spans[j][2] <= a:
            j += 1
        k = j
        while k < len(spans) and spans[k][0] < b:
            if spans[k][2] > a:
                out[i] = spans[k][1] + 1
                break
            k += 1
    return out


class Labelled(NamedTuple):
    """A sampled document: features and labels of its nodes (-1: like a covered node, but not covered itself), chain and skip edges."""

    features: np.ndarray
    labels: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def labelled(text: str) -> Labelled:
    n = nodes(text)
    y = labels(n, base_spans(text))
    covered = {k for k, label in zip(n.keys, y, strict=True) if k and label}
    y[[i for i, k in enumerate(n.keys) if k in covered and not y[i]]] = -1
    return Labelled(n.features, y, *edges(n))


def _log_ratios(counts: np.ndarray, share: np.ndarray, most: float) -> np.ndarray:
    """How much more often two labels meet on edges than they would by their shares of all nodes; nothing without edges."""
    if not counts.any():
        return counts
    counts = counts + counts.T + 0.5
    return np.clip(np.log(counts / counts.sum() / np.outer(share, share)), -most, most)


def _agreement(counts: np.ndarray, share: np.ndarray, most: float) -> np.ndarray:
    """The same for agreement alone, one number for all labels: linked nodes are too few to tell labels apart."""
    if not counts.any():
        return counts
    agree, chance = (np.trace(counts) + 1) / (counts.sum() + 2), (share**2).sum()
    same, other = np.clip(np.log([agree / chance, (1 - agree) / (1 - chance)]), -most, most)
    return np.where(np.eye(len(counts)) > 0, same, other)


def train(sample: list[Labelled], steps: int = 300) -> Field:
    """Unary weights by penalised softmax regression, pair potentials by log ratios of the counts of edges whose ends are both known."""
    m = len(KINDS) + 1
    pairs, skips = np.zeros((m, m)), np.zeros((m, m))
    for d in sample:
        for table, e in ((pairs, d.chain), (skips, d.skip)):
            y = d.labels[e]
            y = y[(y >= 0).all(1)]
            np.add.at(table, (y[:, 0], y[:, 1]), 1)
    x, y = np.concatenate([np.zeros((0, N_FEATURES)), *(d.features for d in sample)]), np.concatenate([np.zeros(0, int), *(d.labels for d in sample)])
    x, y = x[y >= 0], y[y >= 0]
    w = np.zeros((N_FEATURES, m))
    if len(y):
        target = np.eye(m)[y]
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - np.logaddexp.reduce(z, 1, keepdims=True))
            w += 0.5 * (x.T @ (target - p) / len(y) - 1e-3 * w)
    share = (np.bincount(y, minlength=m) + 1) / (len(y) + m)
    return Field(w, _log_ratios(pairs, share, 1.0), _agreement(skips, share, 8.0))


def training_sample(documents: DataFrame, most: int = SAMPLE) -> list[Labelled]:
    """The nodes of the documents of least hash, whole texts: training material of bounded rows."""
    keyed = documents.where("text is not null").select(F.xxhash64("doc_id").alias("h"), F.col("text"))
    # first the bound of the hashes alone, then the nodes of the texts below it
    last = [r["h"] for r in keyed.select("h").orderBy("h").limit(most).collect()]
    if not last:
        return []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled((t.as_py() or b"").decode(errors="replace")) for t in batch.column(1).cast(pa.binary())]
            rows = [(h, len(d.labels), np.packbits(d.features.astype(bool)).tobytes(), d.labels.astype(np.int8).tobytes(), d.chain.astype(np.int32).tobytes(), d.skip.astype(np.int32).tobytes()) for h, d in zip(batch.column(0).to_pylist(), found, strict=True) if len(d.labels)]
            names = ("h", "n", "features", "labels", "chain", "skip")
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    rows = keyed.where(F.col("h") <= max(last)).mapInArrow(of, "h bigint, n int, features binary, labels binary, chain binary, skip binary").orderBy("h", "n", "features").limit(most).collect()
    ints = lambda b: np.frombuffer(b, np.int32).reshape(-1, 2).astype(int)
    return [Labelled(np.unpackbits(np.frombuffer(r["features"], np.uint8), count=r["n"] * N_FEATURES).reshape(-1, N_FEATURES).astype(float), np.frombuffer(r["labels"], np.int8).astype(int), ints(r["chain"]), ints(r["skip"])) for r in rows]


def tag(text: str, field: Field) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of a text, by start and kind."""
    out = [(a, k, b, True) for a, k, b in base_spans(text)]
    n = nodes(text)
    observed = labels(n, [s[:3] for s in out])
    if (observed == 0).any():
        p = beliefs(n, field, observed)
        for i in np.flatnonzero((observed == 0) & (p[:, 1:].max(1) >= SURE)):
            out.append((n.starts[i], int(p[i, 1:].argmax()), n.ends[i], False))
    return sorted(out)


def find_pii(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Each row of documents with found: an array of (kind, start, end, base), in code points, end exclusive, by start and kind.

    A null or empty text has no spans; bytes that are no UTF-8 count as replacement
    characters. Extra columns stay, but one named found is replaced. Repeated rows are each searched. Without a field one is trained on
    SAMPLE documents of the input; an empty input gives no rows.
    """
    field = field or train(training_sample(documents))
    names = [c for c in documents.columns if c != "found"]
    documents = documents.select(*names)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in texts(batch):
                n = len(x.at) - 1
                found = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in tag(x.data[x.at[i] : x.at[i + 1]].tobytes().decode(errors="replace"), field)] for i in range(n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(x.first, n) for j in range(len(names))), pa.array(found, pa.list_(kind))], [*names, "found"])

    return documents.mapInArrow(tagged, StructType([*documents.schema.fields, StructField("found", SPANS)]))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda s: (s["kind"] == k) & s["base"])).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
