"""Author, date and title of a text, from its leading block or its words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before an author, and dates that are understood, in the order in which they are tried.
AUTHOR = r"(?i)(?:author|written by|by)[:\s]+([^\n]+)"
DATES = [(r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd"), (r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", "M/d/yyyy")]


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def leading(text: Column, key: str) -> Column:
    """The value of a key in the leading --- block, the last one if it comes twice, quotes around it taken off; null if it isn't there."""
    block = F.regexp_extract(text, r"\A---\n([\s\S]+?)\n---", 1)
    found = F.regexp_extract_all(block, F.lit(rf"(?m)^[ \t]*{key}[ \t]*:([^\n]*)$"), 1)
    value = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"+|"+$', ""), "^'+|'+$", "")
    return F.when(F.size(found) > 0, value(F.try_element_at(found, F.lit(-1))))


def author(content: Column, text: Column) -> Column:
    """The leading block's author, else the rest of the line after the first word that announces one."""
    return F.coalesce(leading(content, "author"), _some(F.trim(F.regexp_extract(text, AUTHOR, 1))))


def parsed_date(value: Column) -> Column:
    """The date that a value is in one of the forms, as a whole."""
    whole = lambda pattern, form: F.when(value.rlike(f"^{pattern}$"), F.try_to_timestamp(value, F.lit(form)).cast("date"))
    return F.coalesce(*(whole(p, f) for p, f in DATES))


def found_date(content: Column, text: Column) -> Column:
    """The leading block's date, else the first match of the first form whose first match is a date."""
    return F.coalesce(parsed_date(leading(content, "date")), *(parsed_date(_some(F.regexp_extract(text, p, 1))) for p, _ in DATES))
