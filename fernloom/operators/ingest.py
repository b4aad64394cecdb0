"""Documents taken in by stages, with counts and times of each stage.

A stage says which rows it can't take and why; they are kept apart with its name, and
the rest goes on as a table. Counts are observed while a stage's table is written, so
that no row is read again for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fernloom.functions import markup, metadata
from fernloom.functions import text as T
from fernloom.operators import chunking, fulltext, ranking
from fernloom.sources.files import cut

#: Bytes of a tag's name, at most.
TAG_BYTES = 50


@dataclass
class Context:
    """What the stages of a run share: options, tables beside the documents, counts, and whether it was cancelled."""

    options: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    metrics: list[dict] = field(default_factory=list)
    faults: list[DataFrame] = field(default_factory=list)
    cancelled: bool = False


@dataclass(frozen=True)
class Stage:
    """A step: what it makes of the rows, the reason why a row can't be taken (null: it can), and whether to leave the step out."""

    name: str
    process: Callable[[DataFrame, Context], DataFrame]
    fault: Callable[[Context], Column] | None = None
    skip: Callable[[Context], bool] = lambda _: False


class StageError(RuntimeError):
    """A stage ended with an error; context has the counts up to it."""

    def __init__(self, stage: str, context: Context):
        super().__init__(f"stage {stage} failed")
        self.stage, self.context = stage, context


def _counted(seen: Observation, rows: DataFrame, counts: dict[str, Column]) -> dict[str, int]:
    """What was observed of rows; a part of a plan that Spark found to be empty on the way isn't observed, and is counted."""
    try:
        return seen.get
    except Py4JJavaError:
        return rows.agg(*(c.alias(k) for k, c in counts.items())).first().asDict()


def run(stages: list[Stage], documents: DataFrame, context: Context, key: str = "doc_id") -> DataFrame:
    """The rows that all stages have taken. context gets a metric for each stage (stage, status, rows_in, failed, rows_out, millis) and the faults (key, stage, fault)."""
    rows = documents
    for stage in stages:
        if context.cancelled:
            break
        if stage.skip(context):
            context.metrics.append({"stage": stage.name, "status": "skipped", "rows_in": None, "failed": None, "rows_out": None, "millis": 0})
            continue
        began, seen, made = time.monotonic(), Observation(), Observation()
        fault = stage.fault(context) if stage.fault else F.lit(None).cast("string")
        given = rows.withColumn("_fault", fault).observe(seen, F.count("*").alias("rows"), F.count("_fault").alias("failed")).where("_fault is null").drop("_fault")
        metric = {"stage": stage.name, "status": "done", "rows_in": None, "failed": None, "rows_out": None}
        try:
            out = stage.process(given, context)
            if out is given and not stage.fault:
                # rows that a stage passes on as they are aren't written again
                out = rows
                taken = {"rows": rows.count(), "failed": 0}
                passed = taken
            else:
                out = cut(out.observe(made, F.count("*").alias("rows")))
                taken, passed = _counted(seen, rows, {"rows": F.count("*"), "failed": F.count(fault)}), _counted(made, out, {"rows": F.count("*")})
            metric |= {"rows_in": taken["rows"], "failed": taken["failed"], "rows_out": passed["rows"]}
        except Exception as e:
            metric["status"] = "failed"
            raise StageError(stage.name, context) from e
        finally:
            context.metrics.append(metric | {"millis": int((time.monotonic() - began) * 1000)})
        if metric["failed"]:
            context.faults.append(rows.select(key, F.lit(stage.name).alias("stage"), fault.alias("fault")).where("fault is not null"))
        rows = out
    return rows


def totals(context: Context) -> dict[str, int]:
    """Stages that are done, failed and left out, and the milliseconds of all."""
    count = lambda s: sum(m["status"] == s for m in context.metrics)
    return {"done": count("done"), "failed": count("failed"), "skipped": count("skipped"), "millis": sum(m["millis"] for m in context.metrics)}


def _taken(context: Context) -> Column:
    most = context.options.get("max_bytes", 10 << 20)
    content = F.coalesce("content", F.lit(""))
    return F.when(~content.rlike(r"(?U)\S"), "Content cannot be empty").when(F.octet_length(content) > most, "Content too large")


def _ingested(rows: DataFrame, context: Context) -> DataFrame:
    named = F.coalesce(F.when(F.trim("title") != "", F.col("title")), T.title(F.col("content")))
    return rows.withColumn("title", named)


def _parsed(rows: DataFrame, context: Context) -> DataFrame:
    c = F.col("content")
    return rows.withColumns({"text": markup.plain(c), "headings": markup.headings(c), "links": markup.links(c), "code_blocks": markup.code_blocks(c)})


def _described(rows: DataFrame, context: Context) -> DataFrame:
    c, t = F.col("content"), F.col("text")
    title = F.coalesce(metadata.leading(c, "title"), F.col("title"))
    n = F.size(T.words(t)).cast("long")
    # each is read by the next ones only as a column of the stage's table
    return rows.select("*", n.alias("n_words"), metadata.author(c, t).alias("author"), metadata.found_date(c, t).alias("date"), T.language(t).alias("language"), T.doc_type(t).alias("type")).withColumns({"title": title, "minutes": F.ceil(F.col("n_words") / 200).cast("long")})


def _chunked(rows: DataFrame, context: Context) -> DataFrame:
    size, overlap = context.options.get("size", 100), context.options.get("overlap", 20)
    ways = {
        "fixed": lambda d: chunking.fixed(d, size, overlap),
        "paragraphs": lambda d: chunking.paragraphs(d),
        "semantic": lambda d: chunking.semantic(d, size),
    }
    way = context.options.get("chunks", "fixed")
    if way not in ways:
        raise ValueError(f"chunks must be one of {', '.join(ways)}")
    chunks = cut(ways[way](rows.select("doc_id", "text")))
    context.tables["chunks"] = chunks
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return rows.join(counts, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))


def _embedded(rows: DataFrame, context: Context) -> DataFrame:
    context.tables["chunks"] = cut(context.options["embed"](context.tables["chunks"]))
    return rows


def _analysed(rows: DataFrame, context: Context) -> DataFrame:
    """options["analyse"] is a column of topics, an array of strings."""
    return rows.withColumn("topics", context.options["analyse"])


def _stored(rows: DataFrame, context: Context) -> DataFrame:
    """Of one path, or title where there is none, the row of greatest doc_id stays, before what was stored."""
    name = F.coalesce(F.when(F.trim("path") != "", F.concat(F.lit("path "), "path")), F.concat(F.lit("title "), F.col("title")))
    new = ranking.newest(rows.withColumn("key", name), ["key"], [F.desc("doc_id")])
    columns = ["key", "doc_id", "title", "path", "content"]
    old = context.options.get("store")
    stored = new.select(*columns)
    if old is not None:
        stored = stored.unionByName(old.withColumn("key", name).select(*columns).join(new.select("key"), "key", "left_anti"))
    context.tables["documents"] = cut(stored)
    return new.drop("key")


def _indexed(rows: DataFrame, context: Context) -> DataFrame:
    """Tags from topics, made where they aren't known, and the full-text index if a folder for it is named."""
    if path := context.options.get("index"):
        context.tables["index"] = fulltext.build_index(rows, path, {"title": 1.0, "text": 0.4})
    if "topics" not in rows.columns:
        return rows
    named = cut(tags_of(rows))
    known = context.options.get("tags")
    known = rows.sparkSession.createDataFrame([], "tag_id long, tag string") if known is None else known
    context.tables["tags"] = tags = cut(with_new_tags(known, named))
    context.tables["document_tags"] = cut(named.join(tags, "tag").select("doc_id", "tag_id"))
    return rows


def tags_of(rows: DataFrame, doc: str = "doc_id", topics: str = "topics") -> DataFrame:
    """(doc, tag): distinct topics in lower case without space around them, of one to TAG_BYTES bytes."""
    tag = F.regexp_replace(F.lower("topic"), r"(?U)^\s+|\s+$", "")
    each = rows.select(doc, F.explode(topics).alias("topic")).select(doc, tag.alias("tag"))
    return each.where(F.octet_length("tag").between(1, TAG_BYTES)).distinct()


def with_new_tags(known: DataFrame, named: DataFrame) -> DataFrame:
    """known (tag_id, tag) and the tags of named that it lacks, numbered on in their order."""
    new = named.select("tag").distinct().join(known, "tag", "left_anti")
    last = known.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("last"))
    numbered = ranking.placed(new, [F.substring("tag", 1, 1)], ["tag"]).join(F.broadcast(last))
    return known.select("tag_id", "tag").unionByName(numbered.select((F.col("last") + F.col("place")).alias("tag_id"), "tag"))


#: Documents (doc_id, title, path, content) to stored and indexed ones; options embed and analyse bring what is left out else.
STAGES = [
    Stage("ingestion", _ingested, _taken),
    Stage("parsing", _parsed),
    Stage("metadata", _described),
    Stage("chunking", _chunked),
    Stage("embedding", _embedded, skip=lambda c: "embed" not in c.options),
    Stage("analysis", _analysed, skip=lambda c: "analyse" not in c.options),
    Stage("storage", _stored, skip=lambda c: c.options.get("dry", False)),
    Stage("indexing", _indexed, skip=lambda c: c.options.get("dry", False)),
]
