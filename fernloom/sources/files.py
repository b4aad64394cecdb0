"""Documents from files and text formats, and back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Greatest size of a document file.
MOST_BYTES = 10 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a temporary one only in a local session where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/files-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again: an iterative plan starts anew from it."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def markdown_folder(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, title, text, status) of the *.md files below a folder, dot files and dot folders left out.

    status is ok, too_large, empty or not_utf8; text is null unless ok.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,MD}").load(path)
    files = files.where(~F.col("path").rlike(r"/\.[^/]"))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.col("content").cast("string"))
    status = F.when(F.col("length") > most_bytes, "too_large").when(~good, "not_utf8").when(F.length(F.trim(text)) == 0, "empty").otherwise("ok")
    return files.select("path", file_title(F.element_at(F.split("path", "/"), -1)).alias("title"), F.when(status == "ok", text).alias("text"), status.alias("status"))


def file_title(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.url_decode(name), r"\.(md|MD)$", ""), "[-_]", " ")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the schema; a line that isn't an object of it is in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_export(df: DataFrame, path: str, kind: str) -> None:
    """As json, csv (all quoted) or parquet."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(path)
    else:
        getattr(writer, kind)(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def backup_name(name: Column) -> Column:
    """(date, title) of YYYYMMDD_title_HHMMSS, YYYYMMDD_title and YYYY-MM-DD_title; nulls for other names."""
    compact, dashed = r"^([0-9]{8})_(.+?)(?:_[0-9]{6})?\.[a-z]+$", r"^([0-9]{4}-[0-9]{2}-[0-9]{2})_(.+)\.[a-z]+$"
    day = F.coalesce(F.to_date(F.try_to_timestamp(F.regexp_extract(name, compact, 1), F.lit("yyyyMMdd"))), F.to_date(F.try_to_timestamp(F.regexp_extract(name, dashed, 1), F.lit("yyyy-MM-dd"))))
    title = F.coalesce(F.nullif(F.regexp_extract(name, compact, 2), F.lit("")), F.nullif(F.regexp_extract(name, dashed, 2), F.lit("")))
    return F.struct(day.alias("date"), title.alias("title"))


def commits(lines: DataFrame) -> DataFrame:
    """(hash, author, subject, files, insertions, deletions) of log lines `hash|author|subject`, each followed by its short statistics; lines: no (counted by one), line."""
    parts = F.split("line", r"\|", 3)
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract("stat", p, 1), F.lit("")).cast("int"), F.lit(0))
    heads = lines.where(F.col("line").rlike(r"^[0-9a-f]{7,40}\|"))
    rows = heads.join(lines.select((F.col("no") - 1).alias("no"), F.col("line").alias("stat")), "no", "left")
    return rows.select(parts[0].alias("hash"), parts[1].alias("author"), parts[2].alias("subject"), number("([0-9]+) file").alias("files"), number("([0-9]+) insertion").alias("insertions"), number("([0-9]+) deletion").alias("deletions"))


def front_matter(text: Column) -> Column:
    """The `key: value` lines of a leading --- block as a map, quotes around values taken off."""
    block = F.regexp_extract(text, r"\A---\n([\s\S]*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+\s*:"))
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([A-Za-z0-9_-]+)\s*:", 1)), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", ""))
    return F.map_from_entries(F.transform(F.array_distinct(pairs), entry))


def outline_note(text: Column) -> dict[str, Column]:
    """Title, id, tags and links of an outline note."""
    return {
        "title": F.regexp_extract(text, r"(?im)^#\+title:\s*(.+)$", 1),
        "id": F.regexp_extract(text, r"(?m)^\s*:ID:\s*(\S+)", 1),
        "tags": F.filter(F.split(F.regexp_extract(text, r"(?im)^#\+filetags:\s*(.+)$", 1), "[: ]+"), lambda t: F.length(t) > 0),
        "links": F.regexp_extract_all(text, F.lit(r"\[\[(?:id:|file:)?([^\]]+)\](?:\[[^\]]*\])?\]"), 1),
    }
