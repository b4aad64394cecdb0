"""Calls of functions in texts: `.name {argument}{argument}`, found with their places and expanded.

A text is cut at its calls and put together again with their results, so that all
calls of a text are expanded at once and a result is not searched for calls.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.functions.documents import shown

#: A call, and a use of a variable.
CALL = r"\.([a-zA-Z_][a-zA-Z0-9_]*)(?:\s*\{[^}]*\})*+"
VARIABLE = r"\.var\s*\{([^}]*)\}"
#: Names that are left as they are.
CONTROL = ["if", "endif", "foreach", "endforeach", "var"]
#: Stored functions that one registry may have.
MOST = 4096


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _arguments(call: Column) -> Column:
    return _found(call, r"\{([^}]*)\}", 1)


def _spliced(text: Column, pattern: str, results: Column) -> Column:
    """text with its matches replaced by the results."""
    parts = F.split(text, pattern, -1)
    return F.array_join(F.flatten(F.zip_with(parts, results, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def calls(text: Column) -> Column:
    """(name, arguments, start, end, raw) of each call in order; places count code points from 0, end is exclusive. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    between, raws = F.split(text, CALL, -1), _found(text, CALL, 0)
    lengths = F.transform(F.arrays_zip(F.slice(between, 1, F.size(raws)).alias("a"), raws.alias("b")), lambda x: F.struct(F.length(x["a"]).alias("a"), F.length(x["b"]).alias("b")))
    # what stands before a call: all texts between and all calls up to it
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["a"] + x["b"]))
    one = lambda x: F.struct(F.regexp_extract(x["raw"], CALL, 1).alias("name"), _arguments(x["raw"]).alias("arguments"), (x["end"] - F.length(x["raw"])).alias("start"), x["end"].alias("end"), x["raw"].alias("raw"))
    return F.transform(F.arrays_zip(raws.alias("raw"), ends.alias("end")), one)


def _numbers(args: Column) -> Column:
    return F.filter(F.transform(args, lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def _nth(args: Column, i: int, default: str) -> Column:
    return F.coalesce(F.get(args, F.lit(i)), F.lit(default))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _times(args: Column) -> Column:
    n = _nth(args, 1, "1")
    return F.least(F.coalesce(F.when(n.rlike("^[0-9]+$"), n.try_cast("long")), F.lit(1)), F.lit(1000)).cast("int")


#: The functions by name, of the list of arguments.
BUILTIN: dict[str, Callable[[Column], Column]] = {
    "sum": lambda a: shown(_total(_numbers(a))),
    "avg": lambda a: F.when(F.size(_numbers(a)) > 0, shown(_total(_numbers(a)) / F.size(_numbers(a)))).otherwise("0"),
    "min": lambda a: F.coalesce(shown(F.array_min(_numbers(a))), F.lit("")),
    "max": lambda a: F.coalesce(shown(F.array_max(_numbers(a))), F.lit("")),
    "count": lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.split(x, ",", -1))).cast("string"),
    "upper": lambda a: F.upper(_nth(a, 0, "")),
    "lower": lambda a: F.lower(_nth(a, 0, "")),
    "capitalize": lambda a: F.concat(F.upper(F.substring(_nth(a, 0, ""), 1, 1)), F.substring(_nth(a, 0, ""), 2, 1 << 30)),
    "trim": lambda a: F.trim(_nth(a, 0, "")),
    "len": lambda a: F.octet_length(_nth(a, 0, "")).cast("string"),
    "repeat": lambda a: F.repeat(_nth(a, 0, ""), _times(a)),
    "join": lambda a: _joined(a),
    "replace": lambda a: F.when(_nth(a, 1, "") == "", _nth(a, 0, "")).otherwise(F.replace(_nth(a, 0, ""), _nth(a, 1, ""), _nth(a, 2, ""))),
    "split": lambda a: F.replace(_nth(a, 0, ""), _nth(a, 1, ","), F.lit(", ")),
}


def _joined(args: Column) -> Column:
    parts = F.transform(F.split(_nth(args, 0, ""), ",", -1), lambda x: F.trim(x))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(parts, 1), lambda acc, x: F.concat(acc, _nth(args, 1, ", "), x))


def filled(template: Column, args: Column) -> Column:
    """template with {{0}}, {{1}} and so on as the arguments, one after another, and {{args}} as all of them; others stay."""
    each = F.transform(args, lambda x, i: F.struct(F.concat(F.lit("{{"), i.cast("string"), F.lit("}}")).alias("mark"), x.alias("x")))
    return F.replace(F.aggregate(each, template, lambda acc, e: F.replace(acc, e["mark"], e["x"])), F.lit("{{args}}"), F.array_join(args, ", "))


def registry(functions: DataFrame) -> dict[str, str]:
    """The templates by name of stored functions (name, template, version): of names that differ in case only, the one of greatest version (of equal ones the greatest template)."""
    newest = functions.where("name is not null and template is not null").groupBy(F.lower("name").alias("name")).agg(F.max(F.struct("version", "template", F.col("name").alias("own"))).alias("f"))
    rows = newest.select("f.own", "f.template").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a registry has more than {MOST} functions")
    return {r["own"]: r["template"] for r in rows}


def expand(text: Column, values: Column | None = None, templates: dict[str, str] | None = None) -> Column:
    """text with variables and calls expanded; values is a map of variables.

    A stored function comes before a builtin of its name. A variable without value
    gives [undefined: name], a function that isn't known [unknown function: name];
    what belongs to control structures stays.
    """
    if values is not None:
        text = _spliced(text, VARIABLE, F.transform(_found(text, VARIABLE, 1), lambda n: F.coalesce(values[F.trim(n)], F.concat(F.lit("[undefined: "), F.trim(n), F.lit("]")))))

    def result(raw: Column) -> Column:
        name, args = F.regexp_extract(raw, CALL, 1), _arguments(raw)
        known = [(name.isin(CONTROL), raw)]
        known += [(name == k, filled(F.lit(t), args)) for k, t in (templates or {}).items()]
        known += [(name == k, f(args)) for k, f in BUILTIN.items()]
        chosen = reduce(lambda c, kv: c.when(*kv), known[1:], F.when(*known[0]))
        return chosen.otherwise(F.concat(F.lit("[unknown function: "), name, F.lit("]")))

    return _spliced(text, CALL, F.transform(_found(text, CALL, 0), result))
