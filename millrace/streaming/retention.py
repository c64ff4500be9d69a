"""Retention: batch purge, its streaming form, and the table that a running job keeps."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import merge
from millrace.streaming.feed import disk_state, run_once


def event_counts(events: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counts in tumbling windows; with a stream, rows later than the watermark are left out and old state is dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", watermark)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


# --- retention as a running job --------------------------------------------------------------------


def admitted(events: DataFrame, key: str, moment: str, late: str) -> DataFrame:
    """A stream's rows, each key once, without those that come later than `late` behind the newest row seen before.

    State holds the keys of the last `late` alone: the watermark takes older ones out. A key's second row finds its
    state, or is itself too late. Rows without a time have no place in retention and are left out.
    """
    return events.where(F.col(moment).isNotNull()).withWatermark(moment, late).dropDuplicatesWithinWatermark([key])


def _days(spark: SparkSession, path: str) -> list[str]:
    """The day partitions at path, in order: names of folders alone."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/day=*")
    return sorted(f.getPath().getName()[len("day=") :] for f in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or [])


def oldest_kept(spark: SparkSession, path: str, schema: str, moment: str, keep: timedelta) -> tuple[str, int] | None:
    """(day, microseconds) from which on rows are kept: the newest moment, read from the last day alone, less `keep`. None if the table is empty."""
    days = _days(spark, path)
    if not days:
        return None
    since = F.unix_micros(F.max(F.col(moment).cast("timestamp"))) - round(keep.total_seconds() * 1_000_000)
    last = spark.read.schema(schema).parquet(f"{path}/day={days[-1]}").agg(since.alias("since"))
    return tuple(last.select(F.date_format(F.timestamp_micros("since"), "yyyyMMdd"), "since").first())


def save_and_purge(batch: DataFrame, number: int, path: str, schema: str, moment: str, keep: timedelta) -> list[str]:
    """Writes a batch into partitions by day, in place of what an earlier try of it wrote, and deletes the days that are wholly past retention; tells which."""
    spark = batch.sparkSession
    own = batch.withColumn("day", F.date_format(moment, "yyyyMMdd")).withColumn("batch", F.lit(number))
    own.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    since = oldest_kept(spark, path, schema, moment, keep)
    gone = [d for d in _days(spark, path) if since and d < since[0]]
    merge.drop_partitions(spark, path, "day", gone)
    return gone


def live(spark: SparkSession, path: str, schema: str, moment: str, keep: timedelta) -> DataFrame:
    """The rows within retention: whole days by their folders, and of the oldest day those that are young enough."""
    since = oldest_kept(spark, path, schema, moment, keep)
    if since is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, day string, batch int").parquet(path)
    return rows.where((F.col("day") >= since[0]) & (F.unix_micros(F.col(moment).cast("timestamp")) >= since[1])).drop("day", "batch")


def run_retention(events: DataFrame, path: str, work: str, key: str, moment: str, keep: timedelta, late: str) -> StreamingQuery:
    """Takes what is there of a stream into the table at path, and purges it."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)

    def save(batch: DataFrame, number: int) -> None:
        save_and_purge(batch, number, path, schema, moment, keep)

    with disk_state(events.sparkSession):
        return run_once(admitted(events, key, moment, late).writeStream.outputMode("append").foreachBatch(save), f"{work}/checkpoint")
