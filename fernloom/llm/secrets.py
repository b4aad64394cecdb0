r"""Secret scan through a trigram inverted index.

Every rule's expression gives a Boolean trigram query. A block of texts (some
megabytes of the rows of a task) gets an inverted index from the trigrams that
the queries name to the rows that have them, in one vectorised pass over its
bytes; a rule's postings are intersected within an alternative and united over
alternatives, and only those rows are searched with the expression. The rule for
runs of hexadecimal digits has no mandatory trigram: it scans every row.

The index is made where the texts are and goes with its block: no text moves, and
a lost executor costs its blocks only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from fernloom.llm.common import Texts, texts
from fernloom.llm.trigrams import of_rule


class Rule(NamedTuple):
    """A kind of secret: an expression, the group whose length counts, the least length, and the group that is the secret."""

    kind: str
    pattern: re.Pattern
    group: int
    least: int
    span: int = 0


BASE = (
    Rule("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # `[0-9a-f]+` of 24 or more characters: the same runs
    Rule("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
def _more(kind: str, pattern: str, least: int) -> Rule:
    return Rule(kind, re.compile(pattern, re.ASCII), 0, least)


#: Added to the base: published forms that hardly anything else has. Fixed values.
MORE = (
    _more("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,20}PRIVATE KEY-----", 60),
    _more("age", r"AGE-SECRET-KEY-1[0-9A-Z]{58}", 74),
    _more("atlassian", r"ATATT3xFfGF0[A-Za-z0-9_=-]{40,}", 52),
    _more("azure_storage", r"AccountKey=[A-Za-z0-9+/]{86}==", 99),
    _more("databricks", r"dapi[0-9a-f]{32}", 36),
    _more("digitalocean", r"do[opr]_v1_[a-f0-9]{64}", 71),
    _more("discord_hook", r"discord(?:app)?\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,}", 100),
    _more("docker", r"dckr_pat_[A-Za-z0-9_-]{27,}", 36),
    _more("facebook", r"EAACEdEose0cBA[0-9A-Za-z]+", 20),
    _more("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    _more("github_fine", r"github_pat_[A-Za-z0-9_]{70,}", 81),
    _more("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 26),
    _more("google_key", r"AIza[0-9A-Za-z_-]{35}", 39),
    _more("google_oauth", r"ya29\.[0-9A-Za-z_-]{20,}", 25),
    _more("grafana", r"glsa_[A-Za-z0-9]{32}_[A-Fa-f0-9]{8}", 46),
    _more("huggingface", r"hf_[A-Za-z0-9]{34,}", 37),
    # of a run of these characters, only the first eyJ is tried: what follows the run is the same for all
    Rule("jwt", re.compile(r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"), 1, 36, 1),
    _more("linear", r"lin_api_[A-Za-z0-9]{40}", 48),
    _more("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}", 36),
    _more("mailgun", r"key-[0-9a-z]{32}", 36),
    _more("newrelic", r"NRAK-[A-Z0-9]{27}", 32),
    _more("npm", r"npm_[A-Za-z0-9]{36}", 40),
    _more("planetscale", r"pscale_tkn_[A-Za-z0-9_.=-]{32,}", 43),
    _more("postman", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}", 64),
    _more("pulumi", r"pul-[0-9a-f]{40}", 44),
    _more("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", 70),
    _more("rubygems", r"rubygems_[0-9a-f]{48}", 57),
    _more("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 69),
    _more("sentry", r"sntrys_[A-Za-z0-9+/=_-]{40,}", 47),
    _more("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", 38),
    _more("slack", r"xox[abprs]-[0-9]+-[0-9A-Za-z-]{16,}", 24),
    _more("slack_hook", r"hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,}", 60),
    _more("square", r"sq0(?:atp|csp)-[0-9A-Za-z_-]{22,43}", 29),
    _more("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}", 32),
    _more("telegram", r"[0-9]{8,10}:AA[0-9A-Za-z_-]{33}", 44),
    _more("url_password", r"[a-z]{2,12}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 10),
    _more("vault", r"hvs\.[A-Za-z0-9_-]{24,}", 28),
)


#: What a scan finds in a text: kind, code points from start to end (exclusive), and whether the base alone finds it.
SPANS = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("base", "boolean"))


class Index:
    """Rows of a block by trigram."""

    def __init__(self, queries: list[set[frozenset[str]]]):
        self.trigrams = sorted({t for q in queries for alternative in q for t in alternative})
        self.number = np.zeros(1 << 24, np.uint8 if len(self.trigrams) < 255 else np.uint16)
        for i, t in enumerate(self.trigrams):
            a, b, c = t.encode()
            self.number[a << 16 | b << 8 | c] = i + 1
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def postings(self, x: Texts) -> dict[str, np.ndarray]:
        """For each trigram, which rows have it."""
        n = len(x.at) - 1
        found = {t: np.zeros(n, bool) for t in self.trigrams}
        if len(x.data) < 3:
            return found
        b = self.lower[x.data]
        hit = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(hit)
        row = np.searchsorted(x.at, at, "right") - 1
        within = at + 3 <= x.at[row + 1]
        for i, r in zip(hit[at[within]], row[within], strict=True) if len(at) < 64 else ():
            found[self.trigrams[i - 1]][r] = True
        if len(at) >= 64:
            kind, row = hit[at[within]].astype(np.int64) - 1, row[within]
            for i, t in enumerate(self.trigrams):
                found[t][row[kind == i]] = True
        return found


def candidates(query: set[frozenset[str]] | None, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows that may match: all without a query, else the union of the alternatives' intersections."""
    if query is None:
        return np.ones(n, bool)
    rows = np.zeros(n, bool)
    for alternative in query:
        rows |= np.logical_and.reduce([postings[t] for t in alternative])
    return rows


def scan_secrets(documents: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Each row of documents with found: an array of (kind, start, end, base), in code points, end exclusive, by start and rule.

    Matches of a rule are leftmost and do not overlap; those whose group is too
    short are dropped. Rules in `more` add spans, those of `base` always stay. A
    null or empty text has no spans; bytes that are no UTF-8 count as replacement
    characters. Extra columns stay, but one named found is
    replaced. Repeated rows are each scanned.
    """
    rules = [*base, *more]
    queries = [of_rule(r.pattern) for r in rules]
    names = [c for c in documents.columns if c != "found"]
    documents = documents.select(*names)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([q for q in queries if q is not None])
        for batch in batches:
            for x in texts(batch):
                n = len(x.at) - 1
                postings = index.postings(x)
                may = np.array([candidates(q, postings, n) for q in queries])
                spans: list[list] = [[] for _ in range(n)]
                for i in np.flatnonzero(may.any(0)):
                    text = x.data[x.at[i] : x.at[i + 1]].tobytes().decode(errors="replace")
                    own = []
                    for k in np.flatnonzero(may[:, i]):
                        r = rules[k]
                        own += [(m.start(r.span), k, m.end(r.span)) for m in r.pattern.finditer(text) if len(m.group(r.group)) >= r.least]
                    spans[i] = [{"kind": rules[k].kind, "start": a, "end": b, "base": bool(k < len(base))} for a, k, b in sorted(own)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(x.first, n) for j in range(len(names))), pa.array(spans, pa.list_(kind))], [*names, "found"])

    out = StructType([*documents.schema.fields, StructField("found", SPANS)])
    return documents.mapInArrow(scanned, out)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
