"""Row predicates of the knowledge base, as columns and filters that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional_equals(df: DataFrame, **values) -> DataFrame:
    """Equality on each column whose value isn't None; no OR that would block pushdown."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in values.items() if kv[1] is not None], df)


def visible_to(df: DataFrame, user, owner: str = "user_id", public: str = "is_public", write: bool = False) -> DataFrame:
    """Rows a user may read: their own and public ones; to write, their own; nobody's (None) are the public ones."""
    if user is None:
        return df.where(F.lit(False) if write else F.col(public))
    own = F.col(owner) == F.lit(user)
    return df.where(own if write else own | F.col(public))


def escape_like(text: str) -> str:
    """text as a LIKE pattern that matches itself only."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(column: str, text: str) -> Column:
    return F.col(column).ilike(f"%{escape_like(text)}%")


def contains_any(column: str, tokens: list[str], most: int = 20) -> Column:
    """Whether the column contains one of the first `most` tokens, in any case."""
    return reduce(lambda a, b: a | b, [contains_ci(column, t) for t in tokens[:most]], F.lit(False))


def in_window(ts: str, as_of: str, days: int) -> Column:
    """The days before as_of, from its time on."""
    return (F.col(ts) >= F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= F.to_timestamp_ntz(F.lit(as_of)))


def in_date(ts: str, date: str) -> Column:
    """A year, month or day as YYYY[-MM[-DD]], as a half-open range of whole days."""
    parts = [int(p) for p in date.split("-")]
    unit = ("YEAR", "MONTH", "DAY")[len(parts) - 1]
    first = "-".join(f"{p:02d}" for p in [*parts, 1, 1][:3])
    start = F.to_timestamp_ntz(F.lit(first))
    return (F.col(ts) >= start) & (F.col(ts) < start + F.expr(f"INTERVAL 1 {unit}"))


def with_all(df: DataFrame, key: str, tag: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted tag (relational division)."""
    return df.where(F.col(tag).isin(wanted)).groupBy(key).agg(F.count_distinct(tag).alias("_n")).where(F.col("_n") == len(set(wanted))).select(key)


#: The transitions of the document workflow.
TRANSITIONS = {
    "draft": ["pending_review"],
    "pending_review": ["in_review", "draft"],
    "in_review": ["approved", "rejected", "draft"],
    "approved": ["published", "archived"],
    "rejected": ["draft", "archived"],
    "published": ["archived"],
    "archived": ["draft"],
}


def transition_allowed(old: Column, new: Column) -> Column:
    pairs = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(pairs[old], new), F.lit(False))


def block_active(permanent: Column, expires: Column, as_of: Column) -> Column:
    return permanent | (expires > as_of)


def parser_for(mime: Column, path: Column) -> Column:
    """markdown, html or plain, by mime type and then by extension."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    m = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(m.contains("markdown") | ext.isin("md", "markdown"), "markdown").when(m.contains("html") | ext.isin("html", "htm"), "html").otherwise("plain")


def has_hangul(column: str) -> Column:
    return F.col(column).rlike("[가-힣]")
