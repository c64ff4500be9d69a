"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.session import reachable, scratch

#: Most rows of a side that is broadcast by hint; beyond it the join shuffles. A side of bare numbers takes some 25 bytes a row.
BROADCAST_ROWS, BROADCAST_NUMBERS = 300_000, 2_000_000


#: Bounds of the batches that go to Python (Spark's defaults, ours), so that long texts don't make them large.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def prepare(spark: SparkSession) -> None:
    """Sets the bounds where the session still has Spark's defaults, and lets its workers import this package."""
    reachable(spark)
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
    pa.set_memory_pool(pa.system_memory_pool())
except (AttributeError, OSError):
    _TRIM = None


def release() -> None:
    if _TRIM is not None:
        _TRIM(0)


def trimmed(run):
    """A function over a task's batches that gives freed memory back to the system after each; workers live on between tasks."""

    if (active := SparkSession.getActiveSession()) is not None:
        prepare(active)

    def each(batches):
        from millrace.llm import common  # by name: the library's handle can't be sent

        for out in run(batches):
            yield out
            common.release()

    return each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share. See millrace.session.scratch."""
    prepare(spark)
    return scratch(spark, name)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back."""
    return written_with_sums(df, name, codec)[0]


def written_with_sums(df: DataFrame, name: str, codec: str = "zstd", **sums: Column) -> tuple[DataFrame, dict, str]:
    """(df written and read back, aggregates that the same job observed, the folder)."""
    spark = df.sparkSession
    out, seen = shared_dir(spark, name), Observation()
    told = df.observe(seen, *[c.alias(k) for k, c in sums.items()]) if sums else df
    told.write.option("compression", codec).parquet(out)
    return spark.read.schema(df.schema).parquet(out), seen.get if sums else {}, out


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package wrote and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """The names of what a folder holds, without hidden ones; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(n for f in found or [] if not (n := f.getPath().getName()).startswith(("_", ".")))


def exists(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small. Without it, AQE's skew handling applies to the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs written once as (row, at): the whole row as a struct, so that names can't clash, and a number of its own."""
    return written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), name)


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder's URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def put_file(uri: str, data: bytes) -> None:
    """Writes a whole file, so that a second attempt of a task does no harm: under another name that is then changed, or, in an object store, at once, as files appear there when they are whole."""
    fs, path = file_system(uri)
    if fs.type_name in ("s3", "gcs", "abfs"):
        with fs.open_output_stream(path) as out:
            out.write(data)
        return
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


# --- words of whole texts, without a Python object per word -------------------------------------

_ALNUM = np.zeros(256, bool)
_ALNUM[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _ALNUM[_c] = True
#: Bytes that are not ASCII white space; ASCII letters in lower case.
VISIBLE = ~np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def strings(column) -> pa.Array:
    """An Arrow string array without nulls (null counts as empty) and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, without copies."""
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the runs of letters, digits and non-ASCII bytes, or of the bytes that `inside` marks; no run crosses a text's edge."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    word = inside[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    stops[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time, over all spans at once."""
    h = (ends - starts).astype(np.uint64) * _K2
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    at, left, live = starts.copy(), ends - starts, np.arange(len(starts))
    while len(live):
        x = lanes[at] & _MASK[np.minimum(left, 8)]
        y = (h[live] ^ x) * _K1
        h[live] = y ^ (y >> np.uint64(29))
        more = left > 8
        at, left, live = at[more] + 8, left[more] - 8, live[more]
    h *= _K2
    return h ^ (h >> np.uint64(32))


def pieces_of(arr: pa.Array, most: int = 8 << 20):
    """Slices of a string array of about `most` bytes each; a longer text comes alone."""
    _, offsets = raw(arr)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, arr.slice(at, to - at)
        at = to


# --- hashes of spans of words, and the bits that most of a text's hashes have ---------------------

_P = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each span's bytes, over all spans at once."""
    p1, p2, p3, p4, p5 = _P
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        lanes, halves = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,)), np.ndarray((len(buf) + 5,), "<u4", padded.data, 0, (1,))
        size, at = ends - starts, starts.copy()
        h = np.full(len(starts), seed + p5)
        own = np.flatnonzero(size >= 32)
        if len(own):
            v = [np.full(len(own), x) for x in (seed + p1 + p2, seed + p2, seed, seed - p1)]
            live, place, left = np.arange(len(own)), at[own], size[own]
            while len(live):
                for k in range(4):
                    v[k][live] = _rotated(v[k][live] + lanes[place + 8 * k] * p2, 31) * p1
                place, left = place + 32, left - 32
                more = left >= 32
                live, place, left = live[more], place[more], left[more]
            x = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
            for k in range(4):
                x = (x ^ (_rotated(v[k] * p2, 31) * p1)) * p1 + p4
            h[own] = x
            at[own] += size[own] & ~31
        h += size.astype(np.uint64)
        left = ends - at
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = _rotated(h[live] ^ (_rotated(lanes[at[live]] * p2, 31) * p1), 27) * p1 + p4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        if len(live):
            h[live] = _rotated(h[live] ^ (halves[at[live]].astype(np.uint64) * p1), 23) * p2 + p3
            at[live] += 4
            left[live] -= 4
        live = np.flatnonzero(left >= 1)
        while len(live):
            h[live] = _rotated(h[live] ^ (padded[at[live]].astype(np.uint64) * p5), 11) * p1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] >= 1]
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        return h ^ (h >> np.uint64(32))


_LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, 8) bytes, the lowest first: bits set in over half of each text's n hashes (at least one), of which the next text's follow."""
    parts = -(-n // 255)  # a lane of a byte counts up to 255
    lead = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(lead, parts))
    out = np.zeros((len(n), 8), np.uint8)
    for bit in range(8):
        ones = np.add.reduceat((h >> np.uint64(bit)) & _LANES, begin).view(np.uint8).reshape(-1, 8)
        out |= (2 * np.add.reduceat(ones, lead, axis=0, dtype=np.int64) > n[:, None]).astype(np.uint8) << bit
    return out
