"""Hangul as columns: letters of syllables, tokens and sentences with their places, a guess at parts of speech."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from fernloom.functions.text import INITIALS

#: The vowels and final consonants of Hangul syllables, in order of their code.
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: Characters of Unicode's White_Space, as the inside of a character class.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text of which Python objects are made at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20
PLACES = "array<struct<text:string,start:int,end:int>>"


def _in_steps(batches: Iterator[pa.Array], of: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """of(some texts) for all texts in turn: beside Arrow's batch only a step's objects and results are in memory."""
    for texts in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP_BYTES, "right")))
            yield of(texts.slice(i, j - i).to_pylist())
            i = j


@cache
def _letters() -> dict[int, str]:
    """The letters of each syllable, by its code: an initial, a vowel and perhaps a final consonant."""
    ends = ["", *FINALS]
    return {0xAC00 + i: INITIALS[i // 588] + VOWELS[i % 588 // 28] + ends[i % 28] for i in range(11172)}


def letters(c: Column) -> Column:
    """Each Hangul syllable as its two or three letters, other characters as they are; null stays null."""

    @F.arrow_udf("string")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _in_steps(texts, lambda rows: pa.array([None if t is None else t.translate(_letters()) for t in rows], pa.string()))

    return of(c)


def only_initials(c: Column) -> Column:
    """Whether all characters are initial consonants; true for an empty text."""
    return c.rlike(f"^[{INITIALS}]*$")


def part_of_speech(token: Column) -> Column:
    """VV for the endings of verbs, JKS for the marks of subjects, else NNG."""
    ends = lambda *xs: F.endswith(token, F.lit(xs[0])) | F.endswith(token, F.lit(xs[1]))
    return F.when(ends("다", "요"), "VV").when(ends("이", "가"), "JKS").when(token.isNotNull(), "NNG")


def _places(pattern: str):
    """A function of texts to the matches of a pattern with their places, in code points; one pass over each text."""
    found = re.compile(pattern)

    def step(rows: list) -> pa.Array:
        hits = [[] if t is None else list(found.finditer(t)) for t in rows]
        every = [m for h in hits for m in h]
        items = [pa.array([m[0] for m in every], pa.string()), pa.array([m.start() for m in every], pa.int32()), pa.array([m.end() for m in every], pa.int32())]
        bounds = pa.array(np.append(0, np.cumsum([len(h) for h in hits])), pa.int32())
        return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(items, ["text", "start", "end"]), mask=pa.array([t is None for t in rows], pa.bool_()))

    @F.arrow_udf(PLACES)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _in_steps(texts, step)

    return of


def tokens(c: Column) -> Column:
    """Words between white space, each at its own place (a repeated word isn't put at its first one), end exclusive."""
    return _places(f"[^{SPACES}]+")(c)


def sentences(c: Column) -> Column:
    """What stands between `.!?。` and isn't blank, trimmed; the place is that of the untrimmed text."""
    parts = _places("[^.!?。]+")(c)
    trimmed = F.transform(parts, lambda p: F.struct(F.regexp_replace(p["text"], f"^[{SPACES}]+|[{SPACES}]+\\z", "").alias("text"), p["start"].alias("start"), p["end"].alias("end")))
    return F.filter(trimmed, lambda p: p["text"] != "")
