"""Event streams: windows with watermarks, sessions, deduplication and per-key limits with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fernloom.sources.files import scratch

#: How late an event may come.
LATE = "1 day"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream; ts is an instant in the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, and returns its output from a table in the shared folder.

    In update and complete mode each batch is written on its own; the newest row of
    a key is the one of the greatest _batch.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("part")


def daily_counts(events: DataFrame) -> DataFrame:
    """(day, event_type, n) by event-time day, late events up to the watermark."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def session_counts(events: DataFrame) -> DataFrame:
    """(user_id, begin, n): sessions that end after thirty minutes without an event."""
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begin"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def limited(events: DataFrame, most: int = 3) -> DataFrame:
    """(event_id, user_id, allowed): at most `most` events of a user and day, in order of time within a batch.

    The state of a user is the newest day with its count and that of the day before;
    events of earlier days come too late and aren't allowed. State goes when the
    watermark has passed it by two days.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        day, n, before = state.get if state.exists else (-2, 0, 0)
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        allowed = []
        for d in (rows["ts"].astype("int64") // 86_400_000_000_000 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].astype("int64") // 86_400_000_000):
            if d > day:
                day, n, before = int(d), 1, n if d == day + 1 else 0
                allowed.append(n <= most)
            elif d == day:
                n += 1
                allowed.append(n <= most)
            else:
                before += d == day - 1
                allowed.append(bool(d == day - 1 and before <= most))
        state.update((int(day), int(n), int(before)))
        state.setTimeoutTimestamp(max((int(day) + 2) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    rows = events.withWatermark("ts", LATE).select("event_id", "user_id", "ts").groupBy("user_id")
    return rows.applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "day long, n long, before long", "append", GroupStateTimeout.EventTimeTimeout)


def folded_edits(edits: DataFrame) -> DataFrame:
    """The text of each document after its operations in order: edits (doc, seq, op, at, text).

    insert puts text at a place, delete takes as many characters as text has, replace
    does both; places beyond the end count as the end. Edits come sorted, a bounded
    batch at a time, and only the text is kept between them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, n, acc = None, 0, ""
        for batch in batches:
            done, kind = [], batch.schema.field("doc").type
            for d, op, at, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "op", "at", "text"))):
                if n and d != doc:
                    done.append((doc, n, acc))
                    n, acc = 0, ""
                doc, n = d, n + 1
                if acc is None or text is None:
                    acc = None  # as with a null in concat
                    continue
                at = min(max(at or 0, 0), len(acc))
                acc = acc[:at] + ("" if op == "delete" else text) + acc[at + (0 if op == "insert" else len(text)) :]
            yield made(done, kind)
        if n:
            yield made([(doc, n, acc)], kind)

    def made(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        docs, versions, folded = zip(*done) if done else ((), (), ())
        return pa.record_batch({"doc": pa.array(docs, kind), "version": pa.array(versions, pa.int64()), "text": pa.array(folded, pa.string())})

    rows = edits.select("doc", "seq", "op", "at", "text").repartition("doc").sortWithinPartitions("doc", "seq", "op", "at", "text")
    return rows.mapInArrow(fold, f"doc {dict(edits.dtypes)['doc']}, version bigint, text string")


def _folded(events: DataFrame, decide) -> DataFrame:
    """(event_id, user_id, ts, accepted) of events in order of time: decide(state, micros) gives a user's next state and the verdict.

    Events come sorted, a bounded batch at a time; only one user's state is kept.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = object(), None
        for batch in batches:
            out = []
            for u, at in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if u != user:
                    user, state = u, None
                state, verdict = decide(state, at)
                out.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.bool_())], ["event_id", "user_id", "ts", "accepted"])

    rows = events.where("ts is not null").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(fold, f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, ts {kinds['ts']}, accepted boolean")


def throttled(events: DataFrame, seconds: int) -> DataFrame:
    """An event is accepted if the user's last accepted one is at least so many seconds before."""

    def decide(last, at):
        return (at, True) if last is None or at - last >= seconds * 1_000_000 else (last, False)

    return _folded(events, decide)


def sliding_limited(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """An event is accepted if fewer than `most` accepted ones of the user lie within the seconds before; rejected ones don't count."""

    def decide(seen, at):
        seen = [t for t in seen or () if at - t < seconds * 1_000_000]
        return ([*seen, at], True) if len(seen) < most else (seen, False)

    return _folded(events, decide)


def queue_step(queue: DataFrame, done: DataFrame, attempts: int = 3) -> DataFrame:
    """The queue (id, priority, attempts, status) after results (id, ok): finished, retried, or failed after the last attempt."""
    rows = queue.join(done.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    tried = F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    status = F.when(F.col("ok"), "completed").when(~F.col("ok") & (tried >= attempts), "failed").when(~F.col("ok"), "pending").otherwise(F.col("status"))
    return rows.select("id", "priority", tried.cast("int").alias("attempts"), status.alias("status"))
