"""The cache of a model's answers, filled by a stream: each (md5, model) is computed once, over all batches and restarts.

State on disk holds the keys that were seen, without expiry, as the cache itself has none. A batch's new keys are computed and
written into the cache under the batch's number, in place of what an earlier try of that batch wrote; answers that failed go
to `errors` with their cause instead, and a later job can try them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.cache import keyed
from millrace.streaming.feed import disk_state, run_once


def run_cache(texts: DataFrame, known: DataFrame | None, path: str, work: str, compute: Callable[[Column], Column]) -> StreamingQuery:
    """Takes what is there of a stream (text, model). known: keys (md5, model) that other caches have; compute: a column {answer, error} of a text."""
    spark = texts.sparkSession
    new = keyed(texts).dropDuplicates(["md5", "model"])
    new = new if known is None else new.join(known.select("md5", "model"), ["md5", "model"], "left_anti")

    def save(batch: DataFrame, number: int) -> None:
        done = batch.withColumn("_x", compute(F.col("text"))).select("md5", "model", "_x.answer", "_x.error")
        done.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with disk_state(spark):
        return run_once(new.writeStream.outputMode("append").foreachBatch(save), f"{work}/checkpoint")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """md5, model, answer of the cache."""
    return spark.read.parquet(path).where("error IS NULL").select("md5", "model", "answer")


def errors(spark: SparkSession, path: str) -> DataFrame:
    """md5, model, error of what failed."""
    return spark.read.parquet(path).where("error IS NOT NULL").select("md5", "model", "error")
