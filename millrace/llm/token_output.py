"""Tokenises documents and writes their ids as files of directly addressable codes, in ascending doc_id order.

Null texts count as empty and get the end id alone; null doc_ids come first, as in Spark's ascending order; rows
with equal doc_ids follow one another in any order, each with ids of its own; an empty table gives no file and no
row; other columns are not read. A text of any length is encoded whole: it is cut at ASCII white space, over which
neither the normaliser nor the merges reach, and each word is encoded by the library once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import file_system, pieces_of, put_file, shared_dir, strings, table, trimmed

#: Ids after which a writer begins another file.
IDS_PER_FILE = 2_000_000
#: Words that a worker remembers before it starts afresh.
WORDS_KEPT = 200_000
END_ID = 1

_TOKENIZERS: dict = {}


#: A run of Latin letters and then ASCII marks without an apostrophe: two pieces before the merges, whatever stands around.
_PLAIN = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def _byte_marks() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of words. Plain words go to the library's merges directly, which is what its normaliser and splitter lead to."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge, self.marks = self.library.model.tokenize, _byte_marks()
        self.known: dict[str, list[int]] = {}

    def runs(self, parts: pa.Array, often: np.ndarray) -> list[list[int]]:
        """Ids of lower-case runs of letters and of runs of marks; frequent ones are remembered."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        out = []
        for p, keep in zip(parts.to_pylist(), often.tolist()):
            ids = self.known.get(p)
            if ids is None:
                ids = [x.id for x in self.merge(p if p.isascii() else p.encode().decode("latin-1").translate(self.marks))]
                if keep:
                    self.known[p] = ids
            out.append(ids)
        return out

    def whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]


def word_encoder(path: str) -> WordEncoder:
    """A worker loads each file once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordEncoder(path)
    return _TOKENIZERS[path]


def encode_texts(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, place of each text's first id and the end); each text ends with end_id.

    The texts' distinct words are told apart by Arrow; each is one unit, or two: its letters and its marks.
    """
    words = pc.ascii_split_whitespace(texts)
    edges = np.asarray(words.offsets, np.int64)
    coded = words.flatten().dictionary_encode()
    index = np.asarray(coded.indices, np.int64)
    times = np.bincount(index, minlength=len(coded.dictionary))
    plain = pc.extract_regex(coded.dictionary, _PLAIN)
    is_plain = np.asarray(plain.is_valid())
    run = pc.utf8_lower(plain.filter(plain.is_valid()).field("run")).dictionary_encode()
    marks = plain.filter(plain.is_valid()).field("marks").dictionary_encode()
    run_of, marks_of = np.asarray(run.indices, np.int64), np.asarray(marks.indices, np.int64)
    encoder = word_encoder(path)
    odd = coded.dictionary.filter(pa.array(~is_plain)).to_pylist()
    lists = [*encoder.runs(run.dictionary, np.bincount(run_of, times[is_plain], len(run.dictionary)) > 1), *encoder.runs(marks.dictionary, np.ones(len(marks.dictionary), bool)), *encoder.whole(odd), [], [end_id]]
    n_run, n_marks = len(run.dictionary), len(marks.dictionary)
    units = np.full((len(times), 2), len(lists) - 2)
    units[is_plain, 0], units[is_plain, 1] = run_of, n_run + marks_of
    units[~is_plain, 0] = n_run + n_marks + np.arange(len(odd))

    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    order = np.insert(units[index].reshape(-1), 2 * (edges[1:] - edges[0]), len(lists) - 1)
    n = sizes[order]
    to = np.cumsum(n)
    ids = flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begins[order] - (to - n), n)]  # each unit's ids in their places
    last = 2 * (edges[1:] - edges[0]) + np.arange(len(texts))
    return ids, np.concatenate([[0], to[last]]).astype(np.int64)


def _writer(folder: str, path: str, bits: int, ids_per_file: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, docs, held, sizes, seq = TaskContext.get().partitionId(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}.dac"
            from millrace.llm import dac

            starts = np.concatenate([[0], np.cumsum(sizes)])
            put_file(f"{folder}/{name}", dac.encode(np.concatenate(held), docs, starts, bits))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([int(starts[-1])], pa.int64())})

        for batch in batches:
            texts, keys = strings(batch.column("text")), batch.column("doc_id")
            for at, piece in pieces_of(texts):
                ids, starts = encode_texts(piece, path)
                k, names = 0, keys.slice(at, len(piece)).to_pylist()
                while k < len(names):
                    room = ids_per_file - sum(sizes)
                    to = max(k + 1, int(np.searchsorted(starts, starts[k] + room, side="right")) - 1)
                    docs += names[k:to]
                    sizes += np.diff(starts[k : to + 1]).tolist()
                    held.append(ids[starts[k] : starts[to]])
                    k = to
                    if sum(sizes) >= ids_per_file or k < len(names):
                        yield flush()
                        docs, held, sizes, seq = [], [], [], seq + 1
        if docs:
            yield flush()

    return write


def write_ids(docs: DataFrame, folder: str, path: str, bits: int = 8, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Writes the files, whose names ascend with their doc_ids, and returns the manifest: file, n_docs, n_ids, first_id.

    Rows are dealt by ranges of doc_id and a number of their own, so that many rows of one doc_id, or without one, are
    many ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("number"))
    ordered = rows.repartitionByRange("doc_id", "number").sortWithinPartitions("doc_id", "number").drop("number")
    manifest = ordered.mapInArrow(trimmed(_writer(f"{folder}/ids", path, bits, ids_per_file)), "part int, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return with_places(spark.read.schema("part int, file string, n_docs long, n_ids long").parquet(f"{folder}/manifest")).select("file", "n_docs", "n_ids", "first_id")


def with_places(files: DataFrame) -> DataFrame:
    """files (part, file, n_ids) with first_id, the ids of all files before: a running sum over the writers' parts, one row each, and another within each part."""
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return files.withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").withColumn("first_id", F.col("before") + F.col("own"))


def token_at(manifest: DataFrame, folder: str, position: int) -> int:
    """The id at a place in the whole output: its file is found by the manifest and read at that place alone."""
    row = manifest.where((F.col("first_id") <= position) & (F.col("first_id") + F.col("n_ids") > position)).first()
    if row is None:
        raise IndexError(position)
    from millrace.llm.dac import DacFile

    fs, path = file_system(f"{folder}/ids/{row.file}")
    with fs.open_input_file(path) as f:
        return DacFile(lambda offset, n: f.read_at(n, offset)).token(position - row.first_id)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from millrace.llm.dac import DacFile

    for batch in batches:
        for data, first in zip(batch.column("content"), batch.column("first_id").to_pylist()):
            f = DacFile(data.as_buffer())  # the query reads every id, so the whole file
            ids, starts = f.ids(), f.starts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(f.doc_ids, pa.int64()), "start": pa.array(starts[:-1] + first, pa.int64()), "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            )


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 for each document. A task holds one file at a time."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(f"{folder}/ids")
    named = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.join(F.broadcast(manifest.select("file", "first_id")) if manifest.count() <= 100_000 else manifest.select("file", "first_id"), "file").mapInArrow(
        trimmed(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, path: str, bits: int = 8, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Writes docs' ids into the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-ids")
    manifest = write_ids(docs, folder, path, bits, ids_per_file)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_ids(spark, folder, manifest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
