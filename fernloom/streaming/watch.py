"""A watched folder: what was created, modified and deleted between scans.

A scan lists files without reading them. It is compared with the state of the scan
before, a row for each path; a file that was written a moment before the scan is left
for the next one, so that a burst of writes is one event. A scan that is run again
overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a file must not have been written.
QUIET = 2.0
FILES = "path string, modified timestamp, size long"
EVENTS = f"{FILES}, event string"


def listed(spark: SparkSession, folder: str, glob: str = "*.[mM][dD]") -> DataFrame:
    """(path, modified, size) of the files below a folder, from their listing alone; none if the folder has none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


class FolderWatch:
    """The state of a watched folder, kept in another folder in a part for each scan; scans count from 0."""

    def __init__(self, spark: SparkSession, path: str, quiet: float = QUIET, initial: bool = True):
        self.spark, self.path, self.quiet, self.initial = spark, path, quiet, initial

    def _part(self, kind: str, number: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/scan={number}")

    def events(self, number: int) -> DataFrame:
        """(path, modified, size, event) of a scan; size and modified of a deleted file are its last ones."""
        return self._part("events", number, EVENTS)

    def scan(self, files: DataFrame, at, number: int) -> DataFrame:
        """The events of a scan (path, modified, size) made at a time.

        Files in hidden folders and hidden files are not seen. A new file, or one whose
        time or size differs, is created or modified once it was quiet; one that is no
        longer there is deleted. The first scan tells what is there as created if the
        watch is to begin with that, else it only remembers. Of rows with one path the
        newest counts.
        """
        now = F.lit(at).cast("timestamp")
        seen = files.where(F.col("path").isNotNull() & ~F.col("path").rlike(r"(^|/)\.[^/]")).groupBy("path").agg(F.max(F.struct("modified", "size")).alias("f")).select("path", "f.*")
        known = self._part("state", number - 1, FILES) if number else self.spark.createDataFrame([], FILES)
        before = known.select("path", F.col("modified").alias("was"), F.col("size").alias("was_size"), F.lit(True).alias("known"))
        both = seen.withColumn("there", F.lit(True)).join(before, "path", "full")
        changed = ~(F.col("modified").eqNullSafe(F.col("was")) & F.col("size").eqNullSafe(F.col("was_size")))
        quiet = F.coalesce(F.unix_micros(now) - F.unix_micros("modified") >= int(self.quiet * 1e6), F.lit(True))
        event = F.when(F.col("there").isNull(), "deleted").when(changed & quiet, F.when(F.col("known").isNull(), "created").otherwise("modified"))
        both = both.withColumn("event", event).withColumn("wait", F.coalesce(F.col("there") & changed & ~quiet, F.lit(False)))
        # a file that waits keeps the state that it had, or none
        old = F.col("wait") | (F.col("event") == "deleted")
        rows = both.select("path", F.when(F.coalesce(old, F.lit(False)), F.col("was")).otherwise(F.col("modified")).alias("modified"), F.when(F.coalesce(old, F.lit(False)), F.col("was_size")).otherwise(F.col("size")).alias("size"), "event", "wait", "known")
        state = rows.where("event is null or event <> 'deleted'").where("not wait or known").select("path", "modified", "size")
        state.write.mode("overwrite").parquet(f"{self.path}/state/scan={number}")
        told = rows.where("event is not null" if number or self.initial else "false").select("path", "modified", "size", "event")
        told.write.mode("overwrite").parquet(f"{self.path}/events/scan={number}")
        return self.events(number)
