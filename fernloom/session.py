"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "fernloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with what the operators expect: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The named tables of a directory; one table is returned alone."""
    found = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return found[0] if len(found) == 1 else found


def views(spark: SparkSession, **tables: DataFrame) -> None:
    """Registers temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
