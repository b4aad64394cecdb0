"""Functions that authors call in documents: templates, numbers over lists, headings, JSON answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(template: Column, values: Column) -> Column:
    """template with each {{name}} as its value, an unknown one as [undefined: name]."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{([A-Za-z_][A-Za-z0-9_]*)\}\}"), 1))
    return F.aggregate(names, template, lambda acc, n: F.replace(acc, F.concat(F.lit("{{"), n, F.lit("}}")), F.coalesce(values[n], F.concat(F.lit("[undefined: "), n, F.lit("]")))))


def missing(template: Column, values: Column) -> Column:
    """Names that the template has and the values don't."""
    return F.array_except(F.regexp_extract_all(template, F.lit(r"\{\{([A-Za-z_][A-Za-z0-9_]*)\}\}"), 1), F.map_keys(values))


def numbers(args: Column) -> Column:
    """The parts of a comma list that are numbers."""
    return F.filter(F.transform(F.split(args, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def shown(x: Column) -> Column:
    """A number to six decimals, without an exponent and without zeros at its end."""
    plain = F.round(x, 6).try_cast("decimal(38,6)").cast("string")
    # what has no such decimal (from 1e32 on, infinite, not a number) is shown as it is
    return F.coalesce(F.regexp_replace(plain, r"\.?0+$", ""), x.cast("string"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


#: The functions by name, each of one argument text.
BUILTIN: dict[str, Callable[[Column], Column]] = {
    "sum": lambda a: shown(_sum(numbers(a))),
    "avg": lambda a: shown(F.when(F.size(numbers(a)) > 0, _sum(numbers(a)) / F.size(numbers(a))).otherwise(0.0)),
    "min": lambda a: F.coalesce(shown(F.array_min(numbers(a))), F.lit("")),
    "max": lambda a: F.coalesce(shown(F.array_max(numbers(a))), F.lit("")),
    "count": lambda a: F.size(F.split(a, ",")).cast("string"),
    "upper": F.upper,
    "lower": F.lower,
    "capitalize": lambda a: F.concat(F.upper(F.substring(a, 1, 1)), F.substring(a, 2, 1 << 30)),
    "trim": F.trim,
    "len": lambda a: F.octet_length(a).cast("string"),
    "join": lambda a: F.array_join(F.transform(F.split(a, ","), lambda x: F.trim(x)), ", "),
    "split": lambda a: F.array_join(F.split(a, ","), ", "),
    # the count after the first comma: 1 without a whole number, 1000 at most
    "repeat": lambda a: F.repeat(F.split_part(a, F.lit(","), F.lit(1)), F.least(F.coalesce(F.when(F.trim(F.split_part(a, F.lit(","), F.lit(2))).rlike("^[0-9]+$"), F.trim(F.split_part(a, F.lit(","), F.lit(2))).try_cast("int")), F.lit(1)), F.lit(1000))),
}


def called(name: str, args: Column) -> Column:
    """The named function of the arguments; an unknown name gives a warning text, no error."""
    return BUILTIN[name](args) if name in BUILTIN else F.lit(f"[unknown function: {name}]")


def contents(markdown: Column) -> Column:
    """A table of contents: headings as indented links to their anchors."""
    heads = F.filter(F.split(markdown, "\n"), lambda x: x.rlike("^#{1,6} "))
    level = lambda x: F.length(F.regexp_extract(x, "^(#+)", 1))
    name = lambda x: F.trim(F.regexp_replace(x, "^#+ ", ""))
    anchor = lambda x: F.regexp_replace(F.regexp_replace(F.lower(name(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.array_join(F.transform(heads, lambda x: F.concat(F.repeat(F.lit("  "), level(x) - 1), F.lit("- ["), name(x), F.lit("](#"), anchor(x), F.lit(")"))), "\n")


def answer(text: Column) -> Column:
    """A model's JSON answer: fences taken off; null without title and summary; confidence from 0 to 1, 0.5 if missing."""
    plain = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    row = F.from_json(plain, "title string, summary string, topics array<string>, confidence double")
    bound = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(row["confidence"], F.lit(0.5))))
    return F.when(row["title"].isNotNull() & row["summary"].isNotNull(), F.struct(row["title"].alias("title"), row["summary"].alias("summary"), F.coalesce(F.filter(row["topics"], lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("topics"), bound.alias("confidence")))


def extraction_status(failed: Column, confidence: Column) -> Column:
    return F.when(failed, "failed").when(confidence.isNull(), "pending").when(confidence < 0.3, "skipped").otherwise("completed")


def sync_advice(db_time: Column, file_time: Column, same: Column) -> Column:
    """no_change for equal contents, conflict within a minute, else the newer side wins."""
    gap = F.unix_timestamp(file_time.cast("timestamp")) - F.unix_timestamp(db_time.cast("timestamp"))
    return F.when(same, "no_change").when(F.abs(gap) < 60, "conflict").when(gap > 0, "update_db").otherwise("update_file")


def relative_time(seconds: Column) -> Column:
    m, h, d = (F.floor(seconds / s).cast("string") for s in (60, 3600, 86400))
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(m, F.lit(" min"))).when(seconds < 86400, F.concat(h, F.lit(" h"))).otherwise(F.concat(d, F.lit(" d")))
