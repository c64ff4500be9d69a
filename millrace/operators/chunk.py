"""Splitting documents into paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import summary, words
from millrace.functions.tokens import default_path, in_slices, words_of
from millrace.session import reachable

COARSE, COARSE_OVERLAP, FINE, FINE_OVERLAP = 2000, 400, 150, 50
#: Where a text may be cut, from the coarsest places to the finest: before a blank line, a line, a sentence, a word.
_LEVELS = tuple(map(re.compile, (r"\n[ \t\r]*\n\s*", r"\n\s*", r"(?<=[.!?])\s+", r"\s+")))


def windows(df: DataFrame, text: str, size: int, overlap: int, seq: str = "seq", out: str = "chunk") -> DataFrame:
    """A row for each window of `size` words; neighbours share `overlap` words. One row for a short text."""
    step = size - overlap
    ws = df.withColumn("_words", words(F.col(text)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - (overlap + 1), F.lit(0)), F.lit(step))
    return ws.select("*", F.posexplode(starts).alias(seq, "_at")).withColumn(out, F.array_join(F.slice("_words", F.col("_at") + 1, size), " ")).drop("_words", "_at")


def spans(text: str, tokens: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of a text's chunks of at most `size` tokens; tokens: where each token begins, in order.

    A part that is too long is cut at the coarsest places that it has: blank lines, else lines, sentences, words, tokens.
    Parts are packed greedily, and a chunk but the first begins with the last whole parts of the one before, of at most
    `overlap` tokens. The chunks cover the text.
    """

    before = memoryview(np.cumsum(np.bincount(tokens + 1, minlength=len(text) + 1), dtype=np.int64))  # tokens that begin before each place

    def parts(a: int, b: int, level: int) -> None:
        if before[b] - before[a] <= size:
            whole.append((a, b))
        elif level < len(_LEVELS):
            at = a
            for m in _LEVELS[level].finditer(text, a + 1, b):
                parts(at, m.start(), level + 1)
                at = m.start()
            parts(at, b, level + 1)
        else:
            own = tokens[before[a] : before[b]]
            at = [a, *np.unique(own[size::size]).tolist(), b]
            whole.extend((x, y) for x, y in zip(at, at[1:]) if y > x)

    whole: list[tuple[int, int]] = []
    parts(0, len(text), 0)
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int, int]] = []
    total = 0
    for a, b in whole:
        n = before[b] - before[a]
        if held and total + n > size:
            out.append((held[0][0], held[-1][1]))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[2]
        held.append((a, b, n))
        total += n
    if held:
        out.append((held[0][0], held[-1][1]))
    return out


def token_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int, path: str | None = None) -> DataFrame:
    """key, seq, chunk, tokens: recursive chunks of each text, by the tokens of an offline vocabulary. White space at a chunk's edges is left out.

    Null and empty texts, and those of white space alone, have no chunk. Repeated keys are chunked apart.
    """
    reachable(df.sparkSession)
    place = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_of(place)
        for batch in batches:
            for at, texts in in_slices(batch.column(1)):
                rows: list[tuple[int, int, str, int]] = []
                for k, (t, starts) in enumerate(zip(texts, known.starts(texts))):
                    found = spans(t, starts, size, overlap)
                    ends = np.searchsorted(starts, np.array(found, np.int64).reshape(-1, 2))
                    told = [(c, m) for (a, b), m in zip(found, (ends[:, 1] - ends[:, 0]).tolist()) if (c := t[a:b].strip())]
                    rows += [(at + k, n, c, m) for n, (c, m) in enumerate(told)]
                keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())], names=["key", "seq", "chunk", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, seq int, chunk string, tokens int").withColumnRenamed("key", key)


def sentences_of(paragraphs: DataFrame, size: int = FINE, overlap: int = FINE_OVERLAP) -> DataFrame:
    """Split sentences (type 1) and one summary (type 2) for each paragraph, together, in one pass."""
    step = size - overlap
    ws = paragraphs.select("document_id", F.col("id").alias("paragraph_id"), "content", words(F.col("content")).alias("ws"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - (overlap + 1), F.lit(0)), F.lit(step))
    split = F.transform(starts, lambda at, k: F.struct(F.lit(1).alias("type"), k.alias("seq"), F.array_join(F.slice("ws", at + 1, F.lit(size)), " ").alias("content")))
    short = F.array(F.struct(F.lit(2).alias("type"), F.lit(0).alias("seq"), summary(F.col("content")).alias("content")))
    each = ws.select("document_id", "paragraph_id", F.explode(F.concat(split, short)).alias("s"))
    return each.select("document_id", "paragraph_id", "s.type", "s.seq", "s.content").withColumn("md5", F.md5("content"))
