"""The English (Porter2) stemmer, for words of a vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm: letters, endings, what replaces them, and words of their own.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
#: Function words that a query doesn't ask for.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin in which endings count."""
    if first := re.match("gener|commun|arsen", word):
        r1 = first.end()
    else:
        r1 = m.end() if (m := _REGION.match(word)) else len(word)
    return r1, r1 + m.end() if (m := _REGION.match(word[r1:])) else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes."""
    if len(word) <= 2 or word in OWN_STEMS:
        return OWN_STEMS.get(word, word)
    # a y that is a consonant
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word)
    r1, r2 = _regions(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word

    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and before[-1:] not in tuple(LI_BEFORE)):
            word = before + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stems(word: Column) -> Column:
    """The stem of each word; meant for distinct words, of which there are far fewer than words of text."""
    return F.pandas_udf(lambda words: words.map(stem, na_action="ignore"), StringType())(word)
