r"""HTML extraction by maximum-scoring subsequence.

A page becomes a sequence of words and tags, each with a score: how much more often
it stands inside the content than outside on labelled pages, as a log ratio. Words
score positive, linked ones by what was learned, and tags negative. Labelled are the
pages that mark their article or main element; to the scan these elements are tags
like all others. One linear scan finds the contiguous region of the greatest sum
(ties: the longest), and its text blocks are the result, the first and the last of
them whole. What says by its element, class, id or role that it is a menu, header,
footer, sidebar, notice, advert, form or comment is left out of the region's text
wherever it stands; scripts, styles, markup comments and the like are never read as
text.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Elements whose content is no text, and those whose end tag may be missing only at the end of the page.
UNREAD = frozenset("script style noscript template svg math iframe object video audio canvas textarea select head title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Element names whose scores are learned, each by its own; others share one.
NAMES = BLOCKS | UNREAD | EMPTY | frozenset("a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label map mark menu option picture q rp rt ruby s samp slot small span strike strong sub sup time tt u var".split())
#: Elements that are no part of an article, and words of class, id and role that say the same.
FRAME = frozenset("nav aside footer form menu dialog button".split())
FRAME_WORDS = frozenset(
    "ad ads adv advert advertisement advertisements adverts adsense advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist cookie cookies consent disclaimer discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget".split()
)
#: Words of FRAME_WORDS that are titles of an article's sections too.
TITLES = frozenset("advertising banner consent disclaimer discussion notice notices notification promotion related replies search sharing social sponsor sponsored subscription".split())
#: Elements whose class and id don't make them a frame.
PLAIN = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in the head; any other one, and text, ends it.
IN_HEAD = frozenset("base link meta noscript object script style template title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar note alert".split())
#: Scores without labelled pages: of a word, a linked word (also the least with them) and a tag; and of a word in a frame element.
WORD, LINKED, TAG, FRAMED = 1.0, -0.5, -0.3, -0.2
#: A tag's score is at most this, a plain word's at least its negative.
MOST = -0.05
#: Words of class and id are told by so many hashes.
CLASSES = 1 << 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'=/<]""")
#: Attributes that say what an element is for.
_TOLD = frozenset("class id role hidden aria-hidden style".split())
_NAMES = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: White space that goes to one space: that of the text model, with the no-break space.
_SPACE = re.compile(r"\s+")


class Piece(NamedTuple):
    """A tag (name, its opening or closing) or a run of text with the state it stands in."""

    tag: str
    text: str
    framed: bool
    linked: bool
    inside: bool
    block: int
    classes: tuple[str, ...] = ()


def _attributes(text: str) -> list[tuple[str, str]]:
    """Names and values of the attributes in _TOLD; each value is read as a whole, so that no word in it is taken for a name."""
    if not text or text.isspace():
        return []
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text) if m[1] and m[1].lower() in _TOLD]


def _words(value: str) -> list[str]:
    return _NAMES.findall(_CAMEL.sub("-", value).lower())


def _frame(name: str, attributes: list[tuple[str, str]], in_article: bool) -> bool:
    """Whether an element is no part of an article: by its name, or by a class or id all of whose words say so.

    A word among others ("has-sidebar", "no-comments") says nothing of the element
    itself, nor does a heading's id, or a section's that may be made from its title.
    """
    if name in FRAME or (name == "header" and not in_article):
        return True
    for key, value in attributes:
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and name not in PLAIN:
            for part in value.split():
                words = [w for w in _words(part) if not w.isdigit()]
                if not words or key == "id" and name == "section" and TITLES.issuperset(words):
                    continue
                if FRAME_WORDS.issuperset(words) and not (in_article and words[-1] == "header"):
                    return True
    return False


def _classes(name: str, attributes: list[tuple[str, str]]) -> tuple[str, ...]:
    """The hashes of an element's class and id words, as names of features."""
    if name in EMPTY:
        return ()
    return tuple(f".{zlib.crc32(w.encode()) % CLASSES}" for key, value in attributes if key in ("class", "id") for w in _words(value))


def pieces(page: str) -> list[Piece]:
    """The page in order. An element that is never closed ends with its parent."""
    out: list[Piece] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they began a frame
    opened: dict[str, int] = {}  # how many of a name are open
    framed = unread = linked = articles = 0
    at = block = 0

    def text(run: str) -> None:
        if run and stack and stack[-1][0] == "head" and not run.isspace():
            close(len(stack) - 1)
        if run and not unread:
            out.append(Piece("", html.unescape(run), framed > 0, linked > 0, articles > 0, block))

    def close(upto: int) -> None:
        nonlocal framed, unread, linked, articles
        while len(stack) > upto:
            name, frame = stack.pop()
            opened[name] -= 1
            framed -= frame
            unread -= name in UNREAD
            linked -= name == "a"
            articles -= name in ("article", "main")

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and stack and stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        told = [] if closing else _attributes(m[3])
        if name in BLOCKS:
            block += 1
        out.append(Piece(("/" if closing else "") + name, "", framed > 0, linked > 0, articles > 0, block, _classes(name, told)))
        if closing:
            # a stray end tag closes nothing; else what is above the element is closed with it
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in EMPTY or m[3].endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in BLOCKS:
            # what these open closes an open paragraph or item of the same kind
            shut = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ("p",))
            for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[i][0] in shut:
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        frame = _frame(name, told, articles > 0)
        stack.append((name, frame))
        opened[name] = opened.get(name, 0) + 1
        framed += frame
        unread += name in UNREAD
        linked += name == "a"
        articles += name in ("article", "main")
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    text(page[at:])
    return out


def scores(parts: list[Piece], weights: dict[str, float]) -> list[float]:
    """The score of each piece. A frame element's tags don't count: it may stand inside the content."""
    word, linked, out = weights.get("#word", WORD), weights.get("#linked", LINKED), []
    for p in parts:
        if p.tag:
            # an end tag that no labelled page has outside a frame counts like its start tag
            name = next((k for k in (p.tag, p.tag.removeprefix("/")) if k in weights), "" if p.tag.removeprefix("/") in NAMES else "other")
            out.append(0.0 if p.framed else min(weights.get(name, TAG), *(weights.get(c, 0.0) for c in p.classes), MOST))
        else:
            out.append(len(p.text.split()) * (FRAMED if p.framed else linked if p.linked else word))
    return out


def region(sums: list[float]) -> tuple[int, int]:
    """First and last (exclusive) of the contiguous scores of the greatest sum above 0, the longest if several have it; (0, 0) if none has."""
    best, span = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, x in enumerate(sums):
        total += x
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best or (total == best > 0 and i + 1 - start > span[1] - span[0]):
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by one newline."""
    parts = pieces(page or "")
    a, b = region(scores(parts, weights))
    # the region's words, with what stands in the same blocks: linked words may begin the first and end the last
    at = [i for i in range(a, b) if not parts[i].tag and not parts[i].framed and not parts[i].text.isspace()]
    if at:
        a, b = (side(parts, parts[i].block, key=lambda p: p.block) for side, i in ((bisect_left, at[0]), (bisect_right, at[-1])))
    blocks: dict[int, list[str]] = {}
    for p in parts[a:b]:
        if p.tag == "br":
            blocks.setdefault(p.block, []).append(" ")
        elif not p.tag and not p.framed:
            blocks.setdefault(p.block, []).append(p.text)
    lines = (_SPACE.sub(" ", "".join(x)).strip() for x in blocks.values())
    return "\n".join(x for x in lines if x)


def features(parts: list[Piece]) -> dict[str, list[int]]:
    """How often each feature stands outside and inside the marked content; frame elements tell nothing."""
    sums: dict[str, list[int]] = {}
    for p in parts:
        if not p.tag:
            # a frame inside the content is no content
            sums.setdefault("#linked" if p.linked else "#word", [0, 0])[p.inside and not p.framed] += len(p.text.split())
        elif not p.framed:
            for name in (p.tag if p.tag.removeprefix("/") in NAMES else "other", *p.classes):
                sums.setdefault(name, [0, 0])[p.inside] += 1
    return sums


def tag_weights(pages: DataFrame) -> dict[str, float]:
    """Scores of words, tags and class words from all pages that mark their article or main element.

    The log of how much more often a feature stands inside the marked content than
    outside. Tags are those of HTML elements, class words go to CLASSES hashes, so
    their number is bounded whatever the input.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column(0):
                parts = pieces(page.as_py() or "")
                if any(p.inside for p in parts):
                    for name, (a, b) in features(parts).items():
                        known = sums.setdefault(name, [0, 0])
                        known[0] += a
                        known[1] += b
        yield pa.RecordBatch.from_pylist([{"name": k, "outside": a, "inside": b} for k, (a, b) in sums.items()], pa.schema([("name", pa.string()), ("outside", pa.int64()), ("inside", pa.int64())]))

    found = pages.select("html").mapInArrow(counted, "name string, outside bigint, inside bigint").groupBy("name").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    return log_ratios({r["name"]: (r["outside"], r["inside"]) for r in found.collect()})


def log_ratios(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Scores of features (outside, inside); none without both."""
    tags = [v for k, v in counts.items() if not k.startswith(".")]
    outside, inside = sum(a for a, _ in tags), sum(b for _, b in tags)
    if not outside or not inside:
        return {}
    score = {k: math.log((b + 1) / (inside + 1)) - math.log((a + 1) / (outside + 1)) for k, (a, b) in counts.items()}
    return {k: max(-MOST, v) if k == "#word" else max(LINKED, v) if k == "#linked" else min(MOST, v) for k, v in score.items()}


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each row of pages (html and others) with text (never null) and n_chars, its code points.

    A null or empty page, and one without a word, gives an empty text. Character
    references are decoded, white space inside a block is one space, blocks stand
    in page order on a line each. Extra columns stay, but text and n_chars are
    replaced. Repeated rows are each extracted.
    """
    weights = tag_weights(pages) if weights is None else weights
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    pages = pages.select(*names)
    k = names.index("html")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [main_text(p.as_py(), weights) for p in part.column(k)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.mapInArrow(extracted, StructType([*pages.schema.fields, *StructType().add("text", "string").add("n_chars", "long").fields]))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
