"""Multi-party perspective rotation of conversations.

For each participant of a conversation (each speaker but the system), the dialogue is rendered with that speaker as
the assistant and every other one as a named user; masks are the spans (start and end in code points, end excluded)
of the text that the perspective's speaker says, its end mark included. System turns are rendered as system.

A conversation is rendered in parts of PART turn numbers, so that one that holds a third of all rows is many small
groups; parts follow one another by (part, sub), `char_start` is a part's place in the whole text, and spans count from
the part's start. A group has at most CROWD turns: sub is a turn's number in its part, in whole CROWDs, so it is 0 in all parts that
have no more. Turns of larger parts are numbered where they lie after a sort over all tasks: equal turns are counted first
and stay one row until they are rendered, and a task adds up its own turns to what the tasks before it have. Texts of other
parts move once, to their part; the parts' places are computed from lengths alone.

Turns are ordered by turn, then by the md5 of role|text; null turns come first; a null role is the speaker "unknown", a
null text is empty, rows with a null conv_id are one conversation. Repeated rows are repeated turns, next to one another.
A conversation of system turns alone has no participant and gives no row; an empty table gives none. Texts of any length
are rendered whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import small_side, table, trimmed, written

PART, CROWD = 256, 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_GROUP = ["conv", "no_conv", "part", "sub"]


_KEYS = ["no_conv", "conv", "part", "turn", "digest", "role"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their task and the number of turns of the same part that come before them in it."""
    from pyspark import TaskContext

    task, last, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("no_conv", "conv", "part")], axis=1)
        times = batch.column("times").to_numpy()
        first = np.concatenate([[last is None or (key[0] != last).any()], (key[1:] != key[:-1]).any(axis=1)])
        sums = np.cumsum(times) - times
        begin = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        carried = np.where(np.maximum.accumulate(first), 0, before)  # of the part that the batch before ended in
        own = sums - np.where(np.maximum.accumulate(first), sums[begin], 0) + carried
        last, before = key[-1], int(own[-1] + times[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(np.full(len(own), task, np.int32))], names=[*batch.schema.names, "at", "task"])


def _shared(t: DataFrame, crowd: int) -> DataFrame:
    """The turns of parts that are too large for one group, in shares of `crowd` turns; equal ones are one row with their number, times."""
    same = t.groupBy(*_KEYS).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    placed = same.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).select(*_KEYS, "text", "times")
    kept = "no_conv boolean, conv long, part long, turn long, digest string, role string, text string, times long, at long, task int"
    placed = written(placed.mapInArrow(trimmed(_numbered), kept), "crowded-turns")
    before = Window.partitionBy("no_conv", "conv", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = placed.groupBy("no_conv", "conv", "part", "task").agg(F.sum("times").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = placed.join(small_side(starts.drop("n")), ["no_conv", "conv", "part", "task"]).withColumn("at", F.col("at") + F.col("start"))
    at = at.withColumn("sub", F.explode(F.sequence(F.expr(f"at div {crowd}"), F.expr(f"(at + times - 1) div {crowd}"))))
    inside = F.least(F.col("at") + F.col("times"), (F.col("sub") + 1) * crowd) - F.greatest(F.col("at"), F.col("sub") * crowd)
    return at.withColumn("times", inside)


def dealt(turns: DataFrame, part: int = PART, crowd: int = CROWD) -> DataFrame:
    """conv and no_conv (a conversation's id, and whether it is null), turn, role, text, digest, times (how often it is said there), and part and sub, the group that a turn is rendered in."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), "turn", "role", "text", F.md5(F.concat_ws("|", "role", "text")).alias("digest"))
    t = t.withColumn("part", F.coalesce(F.expr(f"turn div {part}"), F.lit(-(1 << 62))))
    columns = [*_GROUP, "turn", "digest", "role", "text", "times"]
    crowded = written(t.groupBy("no_conv", "conv", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).drop("n"), "crowded-parts")
    if not crowded.limit(1).count():
        return t.withColumns({"sub": F.lit(0).cast("long"), "times": F.lit(1).cast("long")}).select(*columns)
    crowded, on = small_side(crowded), ["no_conv", "conv", "part"]
    calm = t.join(crowded, on, "left_anti").withColumns({"sub": F.lit(0).cast("long"), "times": F.lit(1).cast("long")})
    return calm.select(*columns).unionByName(_shared(t.join(crowded, on, "left_semi"), crowd).select(*columns))


def _head(speaker: str, system: str) -> str:
    return f"CASE WHEN role = {speaker} THEN '{OPEN}assistant\\n' WHEN role = '{system}' THEN '{OPEN}system\\n' ELSE concat('{OPEN}user name=', role, '\\n') END"


def places(t: DataFrame, system: str = "system") -> DataFrame:
    """The perspectives of each group: (speaker, char_start) of every participant of its conversation. No text is read but for its length."""
    sizes = t.groupBy(*_GROUP, "role").agg(F.sum("times").alias("n"), F.sum(F.length("text") * F.col("times")).alias("chars"))
    sizes = sizes.withColumn("other", F.expr(f"chars + n * (length({_head('NULL', system)}) + {len(CLOSE) + 1})")).withColumn("own", F.expr(f"n * (length({_head('role', system)}) - length({_head('NULL', system)}))"))
    groups = sizes.groupBy(*_GROUP).agg(F.sum("other").alias("size"))
    speakers = sizes.where(F.col("role") != system).select("conv", "no_conv", F.col("role").alias("speaker")).distinct()
    own = sizes.select(*_GROUP, F.col("role").alias("speaker"), "own")
    each = groups.join(speakers, ["conv", "no_conv"]).join(own, [*_GROUP, "speaker"], "left").withColumn("size", F.col("size") + F.coalesce("own", F.lit(0)))
    before = Window.partitionBy("conv", "no_conv", "speaker").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group, without texts
    starts = each.withColumn("char_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return starts.groupBy(*_GROUP).agg(F.collect_list(F.struct("speaker", "char_start")).alias("views"))


def rotate(turns: DataFrame, part: int = PART, system: str = "system", crowd: int = CROWD) -> DataFrame:
    """conv_id, speaker, part, sub, char_start, text, mask_starts, mask_ends, n_turns for each participant and part."""
    t = dealt(turns, part, crowd)
    grouped = t.groupBy(*_GROUP).agg(F.collect_list(F.struct("turn", "digest", "role", "text", "times")).alias("turns"))
    each = grouped.join(places(t, system), _GROUP).select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "part", "sub", F.expr("flatten(transform(array_sort(turns), t -> array_repeat(t, cast(t.times AS int))))").alias("turns"), F.explode("views").alias("v"))
    each = each.select("conv_id", F.col("v.speaker").alias("speaker"), "part", "sub", F.col("v.char_start").alias("char_start"), "turns")
    head = _head("speaker", system).replace("role", "t.role")
    told = each.withColumn("said", F.expr(f"transform(turns, t -> struct({head} AS head, concat(t.text, '{CLOSE}') AS body, t.role = speaker AS own))"))
    # (characters so far, start and end of each own span): one pass over the part's turns
    spans = F.expr(
        """aggregate(said, named_struct('at', 0L, 'starts', cast(array() AS array<bigint>), 'ends', cast(array() AS array<bigint>)),
        (s, t) -> named_struct('at', s.at + length(t.head) + length(t.body) + 1,
            'starts', if(t.own, array_append(s.starts, s.at + length(t.head)), s.starts),
            'ends', if(t.own, array_append(s.ends, s.at + length(t.head) + length(t.body)), s.ends)))"""
    )
    text = F.expr("concat_ws('', transform(said, t -> concat(t.head, t.body, '\\n')))")
    done = told.select("conv_id", "speaker", "part", "sub", "char_start", spans.alias("s"), text.alias("text"), F.size("turns").alias("n_turns"))
    return done.select("conv_id", "speaker", "part", "sub", "char_start", "text", F.col("s.starts").alias("mask_starts"), F.col("s.ends").alias("mask_ends"), F.col("n_turns").cast("long").alias("n_turns"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rotate(table(spark, sf_dir, "conversations"))
    return r.select("conv_id", "speaker", "part", "sub", "char_start", "text", F.concat_ws(",", "mask_starts").alias("mask_starts"), F.concat_ws(",", "mask_ends").alias("mask_ends"), "n_turns")


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(turn // {PART}, -4611686018427387904) AS part FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.*, s.speaker, role = speaker AS own, t.text || '{CLOSE}' AS body,
      CASE WHEN role = speaker THEN '{OPEN}assistant' || chr(10) WHEN role = 'system' THEN '{OPEN}system' || chr(10) ELSE '{OPEN}user name=' || role || chr(10) END AS head
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, length(head) + length(body) + 1 AS n, row_number() OVER w AS k, (row_number() OVER v - 1) // {CROWD} AS sub FROM r WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, md5(role || '|' || text)), v AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, md5(role || '|' || text))),
a AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, speaker, part, sub ORDER BY k) - n AS pos FROM o),
p AS (SELECT conv_id, speaker, part, sub, sum(n) AS n, string_agg(head || body || chr(10), '' ORDER BY k) AS text, count(*) AS n_turns,
      coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS mask_starts,
      coalesce(string_agg(CAST(CAST(pos + n - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS mask_ends
      FROM a GROUP BY conv_id, speaker, part, sub)
SELECT conv_id, speaker, part, CAST(sub AS BIGINT) AS sub, CAST(sum(n) OVER (PARTITION BY conv_id, speaker ORDER BY part, sub) - n AS BIGINT) AS char_start, text, mask_starts, mask_ends, n_turns FROM p
"""
