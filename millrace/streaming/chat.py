"""Answer streams: event lines, deltas, the fold into one text a message, finished records, frames for clients."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import token_estimate
from millrace.operators import dml
from millrace.streaming.fold import packed

DONE = "[DONE]"


def parse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """message fields of `data: ...` lines: delta, is_end, is_error. Lines of six characters or fewer are skipped."""
    body = lines.where(F.length(line) > 6).withColumn("_data", F.substring(line, 7, 1 << 30))
    return body.select(
        *[c for c in lines.columns if c != line],
        F.coalesce(F.get_json_object("_data", "$.choices[0].delta.content"), F.lit("")).alias("delta"),
        F.trim("_data").eqNullSafe(F.lit(DONE)).alias("is_end"),
        F.get_json_object("_data", "$.error.message").isNotNull().alias("is_error"),
    )


def frames(kind: Column, data: Column) -> Column:
    """An event as clients read it: its name, its data line by line, a blank line."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


def error_events(events: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """An error frame for each line of raw answers that reports an error, or that has no body."""
    message = F.coalesce(F.get_json_object(F.substring(line, 7, 1 << 30), "$.error.message"), F.when(F.col(line).isNull(), F.lit("response body is null")))
    return events.withColumn("message", message).where("message IS NOT NULL").select(*keys, "message", frames(F.lit("error"), F.col("message")).alias("frame"))


def fold(chunks: DataFrame, keys: list[str], order: str = "seq", delta: str = "delta") -> DataFrame:
    """The deltas of each message, joined in order. A message is one answer, which a model's output bounds."""
    parts = F.array_sort(F.collect_list(F.struct(order, delta)))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[delta]), "").alias("answer_text"), F.count(F.lit(1)).alias("n_chunks"))


def _append(idle_ms: int | None):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Holds a message's deltas until its end mark and all before it are there; then tells it and forgets it."""
        held: dict[int, str] = {}
        last = -1
        if state.exists:
            seqs, deltas, last = state.get
            held = dict(zip(seqs, deltas))
        if not state.hasTimedOut:
            for f in frames:
                for seqs, deltas, end in zip(f["seqs"].tolist(), f["deltas"].tolist(), f["last"].tolist()):
                    if seqs is not None:
                        held.update(zip(map(int, seqs), deltas))  # a chunk that comes twice counts once
                    last = int(end) if end >= 0 else last
        whole = 0 <= last <= len(held)
        if whole or state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"message_id": [key[0]], "answer_text": ["".join(held[s] for s in sorted(held))], "n_chunks": [len(held)], "whole": [whole]})
        else:
            state.update((list(held), list(held.values()), last))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)

    return step


def fold_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The fold over a stream (message_id, seq from 0, delta, is_end): a message once, when it has ended. State holds messages that are under way alone.

    idle_ms: milliseconds after its last chunk when a message that has not ended is told as it is and forgotten; for streams that run on.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return packed(chunks).groupBy("message_id").applyInPandasWithState(_append(idle_ms), "message_id long, answer_text string, n_chunks long, whole boolean", "seqs array<long>, deltas array<string>, last long", "append", timeout)


def run_fold(spark: SparkSession, chunks_path: str, out: str, checkpoint: str) -> DataFrame:
    """Folds all chunk files there are and returns the messages that have ended. A batch that runs again replaces what it wrote."""
    schema = spark.read.parquet(chunks_path).schema

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = fold_stream(spark.readStream.schema(schema).parquet(chunks_path))
    stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("message_id long, answer_text string, n_chunks long, whole boolean").parquet(f"{out}/batch=*").where("whole").select("message_id", "answer_text", "n_chunks")


def finalise(folded: DataFrame) -> DataFrame:
    """Records of finished messages with their token estimates."""
    return folded.withColumn("answer_tokens", token_estimate(F.col("answer_text")))


def record_fields(finished: DataFrame) -> DataFrame:
    """finished (id, answer_text, message_tokens, began, ended) with answer_tokens, run_time in seconds, and details: the answer step as JSON."""
    f = finished.withColumn("run_time", F.round((F.unix_millis("ended") - F.unix_millis("began")) / 1000.0, 3)).withColumn("answer_tokens", token_estimate(F.col("answer_text")))
    step = F.to_json(F.struct(F.struct("run_time", "answer_tokens", "message_tokens", F.lit("chat_step").alias("step_type")).alias("chat_step")))
    return f.withColumn("details", step)


def complete(records: DataFrame, finished: DataFrame) -> DataFrame:
    """records (id, answer_text, answer_tokens, message_tokens, run_time, details, version) with the finished messages' fields (id, answer_text, message_tokens, began, ended).

    A message without a record gets one.
    """
    f = record_fields(finished)
    return dml.upsert(records, f.select("id", "answer_text", "answer_tokens", "message_tokens", "run_time", "details", F.lit(1).alias("version")), ["id"], "version")


class Registry:
    """Running streams by chat id: put, stop, remove."""

    def __init__(self):
        self.running = {}

    def put(self, chat_id: int, query) -> None:
        self.running[chat_id] = query

    def stop(self, chat_id: int) -> bool:
        query = self.running.pop(chat_id, None)
        if query is not None:
            query.stop()
        return query is not None

    def remove(self, chat_id: int) -> None:
        self.running.pop(chat_id, None)
