"""Markdown and HTML as structure, decoded entities, control structures of templates, unified diffs."""

from __future__ import annotations

import difflib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fernloom.functions.text import words
from pyspark.sql.types import StringType


def headings(markdown: Column) -> Column:
    """(level, text, line) of ATX headings; lines count from 0."""
    lines = F.transform(F.split(markdown, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("line")))
    heads = F.filter(lines, lambda s: s["x"].rlike("^#{1,6} +[^ ]"))
    return F.transform(heads, lambda s: F.struct(F.length(F.regexp_extract(s["x"], "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(s["x"], "^#+ +", "")).alias("text"), s["line"].alias("line")))


def links(markdown: Column) -> Column:
    """(text, url) of inline links, images left out."""
    text = F.regexp_extract_all(markdown, F.lit(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), 1)
    url = F.regexp_extract_all(markdown, F.lit(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), 2)
    return F.zip_with(text, url, lambda a, b: F.struct(a.alias("text"), b.alias("url")))


def code_blocks(markdown: Column) -> Column:
    """(language, code) of fenced blocks."""
    language = F.regexp_extract_all(markdown, F.lit(r"(?s)```([A-Za-z0-9]*)\n(.*?)```"), 1)
    code = F.regexp_extract_all(markdown, F.lit(r"(?s)```([A-Za-z0-9]*)\n(.*?)```"), 2)
    return F.zip_with(language, code, lambda a, b: F.struct(a.alias("language"), b.alias("code")))


def plain(markdown: Column) -> Column:
    """Text without fences, headings' marks, emphasis and link targets."""
    for pattern, by in ((r"(?s)```.*?```", ""), (r"(?m)^#{1,6} +", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"[*_`]([^*_`\n]+)[*_`]", "$1")):
        markdown = F.regexp_replace(markdown, pattern, by)
    return markdown


_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _entity(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return html.unescape(m[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    if code == 0 or 0xD800 <= code <= 0xDFFF:
        return "�"
    return chr(code) if code <= 0x10FFFF else m[0]


@F.pandas_udf(StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references decoded once: surrogates and zero become U+FFFD, numbers out of range stay."""
    return texts.map(lambda t: None if t is None else _ENTITY.sub(_entity, t))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The unified diff of two texts, without file names; null if either is null."""
    return pd.Series([None if a is None or b is None else "\n".join(list(difflib.unified_diff(a.split("\n"), b.split("\n"), lineterm="", n=1))[2:]) for a, b in zip(old, new, strict=True)])


_IF = re.compile(r"\.if\{([^{}]*)\}((?:(?!\.if\{).)*?)\.endif", re.DOTALL)
_EACH = re.compile(r"\.foreach\{(\w+)\}in\{([^{}]*)\}((?:(?!\.foreach\{).)*?)\.endforeach", re.DOTALL)


def _true(condition: str, values: dict[str, str]) -> bool:
    value = lambda x: values.get(x.strip(), x.strip().strip("\"'"))
    if m := re.fullmatch(r"\s*(!?)empty\((.*)\)\s*", condition):
        return bool(m[1]) == bool(values.get(m[2].strip(), "").strip())
    for op in ("==", "!="):
        if op in condition:
            a, b = condition.split(op, 1)
            return (value(a) == value(b)) == (op == "==")
    return value(condition).lower() not in ("", "false", "0") and condition.strip() in values


@F.pandas_udf(StringType())
def controlled(templates: pd.Series, values: pd.Series) -> pd.Series:
    """Templates with .if{..} .. .endif and .foreach{v}in{list} .. .endforeach applied, inner ones first; values are JSON objects of texts."""
    import json

    out = []
    for t, v in zip(templates, values, strict=True):
        known = json.loads(v) if v else {}
        for pattern, fill in (
            (_EACH, lambda m, known=known: "".join(m[3].replace("{{" + m[1] + "}}", x.strip()) for x in known.get(m[2].strip(), m[2]).split(",") if x.strip())),
            (_IF, lambda m, known=known: m[2] if _true(m[1], known) else ""),
        ):
            while t and pattern.search(t):
                t = pattern.sub(fill, t)
        out.append(t)
    return pd.Series(out)


#: Korean words that are no keywords.
KOREAN_STOP = "의 가 이 은 는 를 을 에 로 으로 와 과 도 만 에서 까지 부터 에게 한테 께 더 덜 가장 매우 정말 그리고 하지만 그러나 그래서 따라서 또는 즉 왜냐하면 그런데 하고 이나 거나".split()


def korean_keywords(text: Column) -> Column:
    """Words between white space of two or more characters that are no stop words."""
    return F.filter(words(text), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(KOREAN_STOP))
