"""Calls in texts: their places, arguments and results."""

import re

import pytest
from pyspark.sql import functions as F

from fernloom.functions import calls as K

PATTERN = re.compile(r"\.([a-zA-Z_][a-zA-Z0-9_]*)(?:\s*\{[^}]*\})*")
TEXTS = [".date", ".date {%Y-%m-%d}", ".sum {1} {2} {3}", "Today is .date {%Y-%m-%d} and total is .sum {10} {20}", "Before .date After", ".my_function {arg}", ".func123 {a}\n{b c}{}", "é .x{ü}ö.y", "", None, "no calls. here", "..a .. .b{", ".1a .a.b.c", "x" * 5000 + ".end {" + "y" * 5000 + "}"]


def test_calls(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("i", K.calls(F.col("t")).alias("c")).collect():
        want = [(m[1], re.findall(r"\{([^}]*)\}", m[0]), m.start(), m.end(), m[0]) for m in PATTERN.finditer(TEXTS[r["i"]] or "")]
        assert [tuple(c) for c in r["c"]] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello .var {name}!.var{unknown}", "Hello John![undefined: unknown]"),
        ("a .sum {1}{ 2 }{x} b .avg{1}{2} .avg{x} .min {3}{-1} .max{} .count {a,b}{c}", "a 3 b 1.5 0 -1  3"),
        (".upper {ab} .lower {AB} .capitalize {wOrd} .trim {  x } .len {é}", "AB ab WOrd x 2"),
        (".repeat {ab}{3} .repeat {ab}{x} .join {a, b ,c} .join {a,b}{-} .replace {aXbX}{X}{$1} .split {a-b}{-} .split{a,b}", "ababab ab a, b, c a-b a$1b$1 a, b a, b"),
        (".if {x} y .endif .nope {1}", ".if {x} y .endif [unknown function: nope]"),
        (".twice {.sum} .hello {A}{B} .hello", "[.sum|.sum] Hello B, A: A, B {{2}} Hello {{1}}, {{0}}:  {{2}}"),
        (".sum {1} then .var {call}", "1 then 3"),
        ("plain", "plain"),
        ("", ""),
    ],
)
def test_expand(spark, text, want):
    values = F.create_map(F.lit("name"), F.lit("John"), F.lit("call"), F.lit(".sum {1}{2}"))
    templates = {"twice": "[{{0}}|{{0}}]", "hello": "Hello {{1}}, {{0}}: {{args}} {{2}}", "upper2": "x"}
    got = spark.range(1).select(K.expand(F.lit(text), values, templates).alias("x")).first()["x"]
    assert got == want


def test_registry(spark, monkeypatch):
    rows = [("Sum", "own", 2), ("sum", "older", 1), (None, "x", 1), ("b", None, 1), ("c", "old", 1), ("C", "new", 3)]
    found = K.registry(spark.createDataFrame(rows, "name string, template string, version int"))
    assert found == {"Sum": "own", "C": "new"}
    own = spark.range(1).select(K.expand(F.lit(".upper {x} .C"), None, {"upper": "mine", "C": "c"}).alias("x")).first()["x"]
    assert own == "mine c"
    monkeypatch.setattr(K, "MOST", 1)
    with pytest.raises(ValueError):
        K.registry(spark.createDataFrame(rows, "name string, template string, version int"))
