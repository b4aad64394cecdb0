"""Which document a backup is of: by id, else by title, else by how its text begins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.sources.files import cut

#: Code points of a text by whose hash it is told.
START = 500


def _start(text: Column) -> Column:
    """Hash of the beginning of a text; null for an empty one, which is like no other."""
    return F.when(F.length(text) > 0, F.sha2(F.substring(text, 1, START), 256))


def _level(left: DataFrame, docs: DataFrame, key: str, of: Column, pick: Callable, better: Callable) -> DataFrame:
    """left with found: the picked document whose `of` is key and that the asking user may see.

    A key may have any number of documents, so one public document and one of each
    owner is picked before anything is joined.
    """
    keyed = docs.where(of.isNotNull()).withColumn(key, of)
    public = keyed.where("public").groupBy(key).agg(pick().alias("_open"))
    own = keyed.where("owner is not null").groupBy(key, F.col("owner").alias("user")).agg(pick().alias("_own"))
    out = left.join(public, key, "left").join(own, [key, "user"], "left")
    return cut(out.select(*left.columns, better("_open", "_own")["doc"].alias("found")))


def match_backups(backups: DataFrame, documents: DataFrame) -> DataFrame:
    """(backup_id, doc, matched_by) of every backup; both null where nothing matches.

    backups: backup_id, user (who asks; null sees public documents only), id, title,
    content. documents: doc, owner, public, title, content, updated, created.
    matched_by is id, title or content; only what a step leaves goes to the next. Of
    documents with one title the newest is meant, by updated or else created, of
    those of one time the largest doc; of documents with one beginning the least doc.
    Nothing is matched by a null id or title or an empty content. No step is capped.
    Repeated backups are each matched.
    """
    docs = documents.select("doc", "owner", F.coalesce("public", F.lit(False)).alias("public"), "title", _start(F.col("content")).alias("start"), F.coalesce("updated", "created").alias("at"))
    newest, least = lambda: F.max(F.struct("at", "doc")), lambda: F.min(F.struct("doc"))
    left = backups.select("backup_id", "user", "id", "title", _start(F.col("content")).alias("start"))
    out = []
    for name, key, of, pick, better in (("id", "id", "doc", least, F.least), ("title", "title", "title", newest, F.greatest), ("content", "start", "start", least, F.least)):
        step = _level(left, docs, key, F.col(of), pick, better)
        out.append(step.where("found is not null").select("backup_id", F.col("found").alias("doc"), F.lit(name).alias("matched_by")))
        left = step.where("found is null").drop("found")
    out.append(left.select("backup_id", F.lit(None).cast(documents.schema["doc"].dataType).alias("doc"), F.lit(None).cast("string").alias("matched_by")))
    return reduce(DataFrame.union, out)
