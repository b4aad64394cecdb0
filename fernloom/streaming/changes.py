"""A feed of changes, and the rows and counters that are kept up with it.

Changes are inserts, updates, deletes and views of keys. The newest change of a key by
its sequence number is its state, so that changes may come late, twice or out of order.
Each batch adds the changes that count to a log and to the counters what they change:
one less in the group that a key was in, one more in the group where it is now. A
batch that is run again overwrites its own part, and reads only parts before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.operators.ranking import newest

#: Batches after which the log's newest rows are written as one part.
COMPACT = 50


class ChangeFeed:
    """Rows and counters of a feed in a folder; changes are (key, seq, op, grp, at), op one of insert, update, delete and view."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "key long, seq long, op string, grp string, at timestamp", compact: int = COMPACT):
        self.spark, self.path, self.compact = spark, path, compact
        self.schema = spark.createDataFrame([], schema).schema

    def _read(self, part: str, schema) -> DataFrame:
        # with a schema, a folder in which nothing is yet is an empty table
        try:
            return self.spark.read.parquet(f"{self.path}/{part}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _states(self, before: int | None = None) -> DataFrame:
        """Rows of the log, of batches before a number, from the last compaction that is in these."""
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema)
        whole, log = self._read("whole", f"{fields}, upto int"), self._read("log", f"{fields}, batch int")
        if before is not None:
            whole, log = whole.where(F.col("upto") < before), log.where(F.col("batch") < before)
        last = whole.agg(F.max("upto")).first()[0]
        if last is not None:
            return whole.where(F.col("upto") == last).select(*self.schema.names).union(log.where(F.col("batch") > last).select(*self.schema.names))
        return log.select(*self.schema.names)

    def current(self) -> DataFrame:
        """The live rows: each key's newest change, unless it is a delete."""
        return newest(self._states(), ["key"], [F.desc("seq")]).where("op <> 'delete'")

    def counts(self) -> DataFrame:
        """(grp, n) of live rows, from the counters alone."""
        kind = self.schema["grp"].dataType.simpleString()
        return self._read("counts", f"grp {kind}, n long, batch int").groupBy("grp").agg(F.sum("n").alias("n")).where("n <> 0")

    def views(self) -> DataFrame:
        """(key, n) of views."""
        kind = self.schema["key"].dataType.simpleString()
        return self._read("views", f"key {kind}, n long, batch int").groupBy("key").agg(F.sum("n").alias("n"))

    def apply(self, changes: DataFrame, number: int) -> None:
        """A batch of a stream; for foreachBatch. Rows without key or seq change nothing; of equal numbers the first that came stays, within a batch the greatest op."""
        changes = changes.where("key is not null and seq is not null").persist()
        try:
            last = newest(changes.where("op <> 'view'"), ["key"], [F.desc("seq"), F.desc("op"), F.desc("grp")]).select(*self.schema.names)
            # the states of this batch's keys alone are put in order
            known = self._states(number).join(last.select("key"), "key", "left_semi")
            before = newest(known, ["key"], [F.desc("seq")]).select("key", F.col("seq").alias("was_seq"), F.when(F.col("op") != "delete", F.struct("grp")).alias("was"))
            new = last.join(before, "key", "left").where("was_seq is null or seq > was_seq").persist()
            try:
                new.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
                now = F.when(F.col("op") != "delete", F.struct("grp", F.lit(1).alias("n")))
                gone = F.when(F.col("was").isNotNull(), F.struct(F.col("was.grp").alias("grp"), F.lit(-1).alias("n")))
                moved = new.select(F.inline(F.filter(F.array(now, gone), lambda x: x.isNotNull())))
                moved.groupBy("grp").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")
            finally:
                new.unpersist()
            changes.where("op = 'view'").groupBy("key").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/views/batch={number}")
        finally:
            changes.unpersist()
        if number and number % self.compact == 0:
            newest(self._states(number + 1), ["key"], [F.desc("seq")]).write.mode("overwrite").parquet(f"{self.path}/whole/upto={number}")

    def follow(self, stream: DataFrame) -> None:
        """Applies all that a stream has now."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True)
        writer.foreachBatch(self.apply).start().awaitTermination()
