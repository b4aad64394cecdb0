"""Activity over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_activity(events: DataFrame, kinds: list[str]) -> DataFrame:
    """(day, total, users, one count a kind) of events (ts, user_id, event_type)."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), *(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds))


def heat_level(value: Column, most: Column) -> Column:
    """0 to 4: the quarter of the greatest value, rounded up."""
    return F.when(most <= 0, 0).otherwise(F.least(F.lit(4), F.ceil(value / most * 4))).cast("int")


def heatmap(days: DataFrame) -> DataFrame:
    """days (day, value) with level."""
    most = days.agg(F.max("value").alias("most"))
    return days.join(F.broadcast(most)).select("day", "value", heat_level(F.col("value"), F.col("most")).alias("level"))


def streaks(active: DataFrame, as_of: str, back: int = 365) -> DataFrame:
    """(user_id, current, longest) of active (user_id, day): runs of consecutive days.

    current is the run that ends on as_of or the day before, else 0.
    """
    days = active.where((F.col("day") <= F.lit(as_of).cast("date")) & (F.col("day") > F.date_sub(F.lit(as_of).cast("date"), back))).select("user_id", "day").distinct()
    by = Window.partitionBy("user_id").orderBy("day")
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(by))).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), 1), F.col("n"))), F.lit(0)).alias("current"), F.max("n").alias("longest"))


def growth(monthly: DataFrame) -> DataFrame:
    """monthly (month, n) with the previous month and the growth in percent."""
    by = Window.orderBy("month")
    return monthly.withColumn("previous", F.lag("n").over(by)).withColumn("growth", F.when(F.col("previous") > 0, F.round((F.col("n") - F.col("previous")) * 100.0 / F.col("previous"), 6)))
