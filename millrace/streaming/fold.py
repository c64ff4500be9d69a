"""An answer's chunks as keyed state that grows by appends: a batch writes its own chunks and no others.

Chunks are packed where they are read: those of a message that stand in one Arrow batch become one row, so the shuffle, the sort and
the state have a row for each message and batch, not one for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from millrace.session import reachable

PACK = "message_id long, seqs array<long>, deltas array<string>, last long, began long, ended long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.table(batch)
        end = pc.fill_null(t["is_end"], False)
        t = t.append_column("last", pc.if_else(end, t["seq"], pa.scalar(None, pa.int64()))).append_column("end", end)
        facts = t.group_by("message_id").aggregate([("last", "max"), ("at", "min"), ("at", "max")])
        parts = t.filter(pc.invert(end)).group_by("message_id").aggregate([("seq", "list"), ("delta", "list")])
        at = pc.index_in(facts["message_id"], parts["message_id"].combine_chunks(), skip_nulls=False)
        columns = [facts["message_id"], parts["seq_list"].take(at), parts["delta_list"].take(at), pc.fill_null(facts["last_max"], -1), facts["at_min"], facts["at_max"]]
        yield from pa.table(columns, names=["message_id", "seqs", "deltas", "last", "began", "ended"]).to_batches()


def packed(chunks: DataFrame) -> DataFrame:
    """PACK rows of chunks (message_id, seq, delta, is_end, and at if they have it): last is the end mark's number or -1, began and ended are milliseconds."""
    reachable(chunks.sparkSession)
    at = F.unix_millis("at") if "at" in chunks.columns else F.lit(None).cast("long")
    return chunks.select("message_id", "seq", "delta", "is_end", at.alias("at")).mapInArrow(_packed, PACK)


class Chunks:
    """A message's chunks in state: a list of packs, and a few facts that are small enough to be written again in each batch."""

    def __init__(self, handle: StatefulProcessorHandle, facts: str):
        self.parts = handle.getListState("parts", "seqs array<long>, deltas array<string>")
        self.value = handle.getValueState("facts", facts)

    def facts(self) -> tuple | None:
        return self.value.get()

    def add(self, held: dict[int, str]) -> None:
        if held:
            self.parts.appendValue((list(held), list(held.values())))

    def held(self) -> dict[int, str]:
        return {s: d for seqs, deltas in self.parts.get() for s, d in zip(seqs, deltas)}  # a chunk that came twice counts once

    def forget(self) -> None:
        self.parts.clear()
        self.value.clear()


def joined(held: dict[int, str]) -> str:
    return "".join(held[s] for s in sorted(held))
