"""Streams over tables that arrive in steps: a query starts, takes what is there, stops, and goes on from its checkpoint with the next step."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: Settings that keyed state with timers needs: a store on disk, of which changes alone are written to the checkpoint.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def disk_state(spark: SparkSession):
    """Queries that start inside keep their state on disk."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_once(writer: DataStreamWriter, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """Takes all that is there, and ends. An error of the query is raised here."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path) if path else writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def in_steps(rows: DataFrame, step: str, steps: list, source: str, start: Callable[[DataFrame], StreamingQuery]) -> list[StreamingQuery]:
    """Appends the rows of each step to the folder `source` and runs start(stream over source) after each. Rows of other steps are left out."""
    spark, kept = rows.sparkSession, rows.drop(step)
    done = []
    for value in steps:
        rows.where(F.col(step) == F.lit(value)).drop(step).write.mode("append").parquet(source)
        done.append(start(spark.readStream.schema(kept.schema).parquet(source)))
    return done


def progress(queries: list[StreamingQuery]) -> list[dict]:
    """Rows in, rows dropped as late and rows of state after each batch that had rows or changed state."""
    import json

    out = []
    for q in queries:
        for p in q.recentProgress:
            p = json.loads(p.json) if hasattr(p, "json") else p
            state = p["stateOperators"][0] if p["stateOperators"] else {}
            out.append({"batch": p["batchId"], "rows": p["numInputRows"], "late": state.get("numRowsDroppedByWatermark", 0), "state": state.get("numRowsTotal", 0), "watermark": p["eventTime"].get("watermark")})
    return out
