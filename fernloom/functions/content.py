"""Rules for uploads, comments, actions, requests, skills and query variants, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bytes of the largest upload.
MAX_UPLOAD = 10 * 1024 * 1024
#: Formats whose text can be recognised.
SCANNED_FORMATS = ["pdf", "png", "jpg", "jpeg", "tiff", "bmp"]
#: Actions that concern security, and those that concern documents.
SECURITY_ACTIONS = ["login_failed", "login", "logout"]
DOCUMENT_ACTIONS = ["create", "update", "delete", "read", "export"]
#: What a lower-case request must not have.
SUSPICIOUS = [
    r"<script[^>]*>",
    r"javascript:",
    r"data:text/html",
    r"\bunion\b.*\bselect\b",
    r"\bdrop\s+table\b",
    r"exec\(\s*[\"']",
    r"eval\(\s*[\"']",
    r"(?:\.\.[\\/]){3,}",
    r"%(?:00|0a|0d|3c|3e|22|27)",
]
#: Rewrites of parts of a query, in order.
REWRITES = {"how to": "guide for", "what is": "definition of", "error": "issue", "problem": "issue", "fix": "solve", "create": "make"}
#: Labels of annotation types.
ANNOTATION_LABELS = {"description": "About", "purpose": "Purpose", "audience": "For", "topic": "Topic", "temporal": "When", "source": "Source", "custom": "Note"}


def upload_fault(name: Column, size: Column) -> Column:
    """Why an upload is rejected, or null: its name, its type, then its size in bytes."""
    return (
        F.when(name.isNull() | name.rlike(r"[/\\\x00]"), "Invalid filename")
        .when(~F.lower(name).endswith(".md"), "Only .md files are accepted")
        .when(F.coalesce(size, F.lit(0)) == 0, "File is empty")
        .when(size > MAX_UPLOAD, "File too large")
    )


def upload_title(name: Column) -> Column:
    """The name without `.md` or `.MD`, with spaces for hyphens and underscores."""
    return F.translate(F.regexp_replace(name, r"\.(md|MD)$", ""), "-_", "  ")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name where there is none."""
    return F.lower(F.substring_index(name, ".", -1))


def scan_millis(size: Column) -> Column:
    """The estimated time to recognise a file: a second for each begun megabyte."""
    return (F.floor(size / (1024 * 1024)) + 1) * 1000


def indexable(title: Column, content: Column) -> Column:
    """Whether a document has a title and at least ten bytes of content; false where either is null."""
    return F.coalesce((F.trim(title) != "") & (F.octet_length(_trimmed(content)) >= 10), F.lit(False))


def index_text(title: Column, content: Column) -> Column:
    return F.concat(_trimmed(title), F.lit("\n\n"), _trimmed(content))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def comment_cut(text: Column, most: int) -> Column:
    """The longest start of whole characters within some bytes."""
    fits = F.filter(F.sequence(F.lit(most // 4), F.lit(most)), lambda k: F.octet_length(F.left(text, k)) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(text, F.array_max(fits)))


def suspicious(text: Column) -> Column:
    """Numbers, from 0, of the patterns that a text has in any case; a null text has none."""
    low = F.lower(text)
    hits = [F.when(low.rlike("(?d)" + p), F.lit(i)) for i, p in enumerate(SUSPICIOUS)]
    return F.array_compact(F.array(*hits))


def first_trigger(text: Column, skills: list[tuple[str, list[str]]]) -> Column:
    """The first of some skills (name, keywords) of which the text has a keyword in any case, or null."""
    low = F.lower(text)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words], F.lit(False))
    return F.coalesce(*(F.when(has(words), name) for name, words in skills), F.lit(None).cast("string"))


def rewrites(query: Column) -> Column:
    """Three at most: the query in lower case where that differs, then with each known part replaced."""
    low = F.lower(query)
    made = [F.when(low != query, low), *(F.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b))) for a, b in REWRITES.items())]
    return F.slice(F.array_compact(F.array(*made)), 1, 3)


def parsed_variants(answer: Column, query: Column) -> Column:
    """(query, kind) of each line of an answer but echoes and blank ones, list marks removed.

    kind: specific with two words more, general with two words less, synonym where half of
    the query's words are shared, rephrase where any is, else related.
    """
    lines = F.filter(F.transform(F.split(answer, r"\r?\n", -1), lambda x: _trimmed(x)), lambda x: (x != "") & (F.lower(x) != F.lower(query)))
    split = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    words = split(query)

    def kind(x: Column) -> Column:
        n, shared = F.size(split(x)), F.size(F.filter(words, lambda w: F.array_contains(split(x), w)))
        some = shared > 0
        return F.when(n > F.size(words) + 1, "specific").when(n < F.size(words) - 1, "general").when(some & (shared >= F.floor(F.size(words) / 2)), "synonym").when(some, "rephrase").otherwise("related")

    clean = F.transform(lines, lambda x: _trimmed(F.regexp_replace(x, r"^[\p{N}.*-]+", "")))
    return F.transform(clean, lambda x: F.struct(x.alias("query"), kind(x).alias("kind")))


def fuzzy_hits(words: Column, terms: list[str]) -> Column:
    """How well some words match terms: for each term 1, or 1 less the share of its letters that must change.

    Terms of up to two letters must be equal, up to five may differ by one, longer ones by two.
    """

    def best(t: str) -> Column:
        most = 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
        near = F.filter(words, lambda w: F.abs(F.length(w) - len(t)) <= most)
        far = F.array_min(F.filter(F.transform(near, lambda w: F.levenshtein(w, F.lit(t), most)), lambda x: x >= 0))
        return F.coalesce(1 - far / len(t), F.lit(0.0))

    return sum((best(t) for t in terms), F.lit(0.0))

#: Directives of strftime and the patterns of the same meaning.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE"}


def formatted(at: Column, form: str) -> Column:
    """A time by a strftime form; unknown directives stay as they are."""
    parts, i = [], 0
    while i < len(form):
        known = form[i] == "%" and DIRECTIVES.get(form[i + 1 : i + 2])
        parts.append(F.date_format(at, known) if known else F.lit(form[i]))
        i += 2 if known else 1
    return F.concat(*parts) if parts else F.lit("")


#: English function words that are no lexemes.
LEXEME_STOP = "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was we were will with you".split()


def lexemes(text: Column) -> Column:
    """Lower-case ASCII words without function words, less the endings of plurals, -ing, -ed and -ly where three letters stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.transform(F.filter(found, lambda w: ~w.isin(LEXEME_STOP)), lexeme)


def lexeme(word: Column) -> Column:
    for ending, new in LEXEME_ENDINGS:
        word = F.regexp_replace(word, ending, new)
    return word


#: Endings, in the order in which they go, with what stays.
LEXEME_ENDINGS = [("sses$", "ss"), ("^(.{2,})ies$", "$1y"), ("^(.{2,}[^su])s$", "$1"), ("^(.{3,})(?:ing|ed)$", "$1"), ("^(.{3,})ly$", "$1")]
