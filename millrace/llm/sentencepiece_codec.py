"""SentencePiece encoding and decoding of whole texts, giant ones by a max-plus parallel scan.

Texts of up to GIANT characters are encoded by the library in one go. A longer one is split into chunks of CHUNK
characters over the cluster, cut wherever that is: each yields its boundary-state transfer matrix, the matrices of a
block of chunks are combined, the blocks' products are scanned, and with the states at its edges known each chunk is
traced back on its own. The library takes no part in it; the ids are those that it gives for the whole text. Models
whose own normaliser changes texts, which add no space in front, or which have pieces of a user's own are refused, as
their ids would differ between the two ways.

Null texts are empty, and empty texts have no ids; null doc_ids, repeated rows and other columns do no harm: rows are
told apart by a number of their own. An empty table gives an empty result. U+2581 in a text decodes to a space.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import maxplus
from millrace.llm.common import strings, table, trimmed, written

GIANT, CHUNK, BLOCK = 50_000, 16_384, 256
RESULT = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"
_MODELS: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""

    def varint(at):
        x = shift = 0
        while True:
            b = data[at]
            x |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return x, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def load(path: str):
    """(processor, vocabulary) of a model file; a worker loads each once."""
    if path not in _MODELS:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            kind = kind_of(f.read())
        size = sp.vocab_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        _MODELS[path] = sp, maxplus.Vocabulary(plain, kind == 2, byte_ids if sp.is_byte(byte_ids[0]) else None, sp.unk_id())
    return _MODELS[path]


def kind_of(model: bytes) -> int:
    """1 for a unigram model, 2 for a merge (BPE) model; an error for models whose ids a scan over marked spaces would not give."""
    parts = list(_fields(model))
    trainer = dict(_fields(next((v for k, v in parts if k == 2), b"")))
    rules = dict(_fields(next((v for k, v in parts if k == 3), b"")))
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError("the model is neither unigram nor BPE")
    if rules.get(2, b"") or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model normalises texts, drops spaces, or marks them otherwise than in front of words")
    if any(dict(_fields(v)).get(3, 1) == 4 for k, v in parts if k == 1):
        raise ValueError("the model has pieces that a user defined")
    return kind


def marked(text: str) -> str:
    """The text as the model sees it: spaces marked, and one in front."""
    return maxplus.SPACE + text.replace(" ", maxplus.SPACE)


def encode_chunk(path: str, left: str, body: str, right: str, safe_left: bool, safe_right: bool, entry, leave) -> list[int]:
    _, v = load(path)
    return [i for p in maxplus.Chunk(v, left, body, right, safe_left, safe_right).trace(entry, leave) for i in v.ids(p)]


def decoded(sp, ids: list[int]) -> str:
    """A chunk's text with spaces marked; a mark in front keeps the library from dropping the chunk's own first space."""
    return sp.decode([sp.piece_to_id("a"), *ids])[1:].replace(" ", maxplus.SPACE)


def _lists(found: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))))


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = load(path)
        for batch in batches:
            texts, keys = strings(batch.column("text")).to_pylist(), batch.column("doc_id")
            for at in range(0, len(texts), 512):
                own = texts[at : at + 512]
                ids = sp.encode(own, num_threads=1)
                back = sp.decode(ids, num_threads=1)
                same = [a == b.replace(maxplus.SPACE, " ") for a, b in zip(back, own)]
                yield pa.RecordBatch.from_pydict({"doc_id": keys.slice(at, 512), "ids": _lists(ids), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "round_trip": pa.array(same)})

    return run


def _split(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _, v = load(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                parts = maxplus.split(v, marked(text.as_py()), size)
                for at in range(0, len(parts), 64):
                    own = parts[at : at + 64]
                    columns = [pa.array([p[k] for p in own]) for k in range(5)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(own), pa.int64()), pa.array([doc_id.as_py()] * len(own), pa.int64()), pa.array(range(at, at + len(own)), pa.int64()), *columns],
                        names=["row", "doc_id", "chunk", "left", "body", "right", "safe_left", "safe_right"],
                    )
                row += 1

    return run


def _transfer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, v = load(path)
        for batch in batches:
            rows = [[c.as_py() for c in r] for r in zip(*(batch.column(c) for c in ("left", "body", "right", "safe_left", "safe_right")))]
            packed = [pickle.dumps(maxplus.Chunk(v, *r).transfer()) for r in rows]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "chunk": batch.column("chunk"), "matrix": pa.array(packed, pa.binary())})

    return run


def _product(group: pa.Table) -> pa.Table:
    group = group.sort_by("chunk")
    matrices = [pickle.loads(m) for m in group.column("matrix").to_pylist()]
    out = matrices[0]
    for m in matrices[1:]:
        out = maxplus.combine(out, m)
    return pa.table({"row": group.column("row")[:1], "block": group.column("block")[:1], "matrix": pa.array([pickle.dumps(out)], pa.binary())})


def _blocks(group: pa.Table) -> pa.Table:
    group = group.sort_by("block")
    path = maxplus.scan([pickle.loads(m) for m in group.column("matrix").to_pylist()])
    return pa.table({"row": group.column("row"), "block": group.column("block"), "edges": pa.array([pickle.dumps(p) for p in path], pa.binary())})


def _inside(group: pa.Table) -> pa.Table:
    group = group.sort_by("chunk")
    entry, leave = pickle.loads(group.column("edges")[0].as_py())
    path = maxplus.scan([pickle.loads(m) for m in group.column("matrix").to_pylist()], entry, leave)
    return pa.table({"row": group.column("row"), "chunk": group.column("chunk"), "states": pa.array([pickle.dumps(p) for p in path], pa.binary())})


def _trace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = load(path)
        for batch in batches:
            ids, same = [], []
            for *part, states in zip(*(batch.column(c) for c in ("left", "body", "right", "safe_left", "safe_right", "states"))):
                left, body, right, safe_left, safe_right = (c.as_py() for c in part)
                entry, leave = pickle.loads(states.as_py())
                ids.append(encode_chunk(path, left, body, right, safe_left, safe_right, entry, leave))
                same.append(decoded(sp, ids[-1]) == (body + right)[entry[0] : len(body) + leave[0]])
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "chunk": batch.column("chunk"), "ids": _lists(ids), "same": pa.array(same, pa.bool_())})

    return run


def encode_giants(docs: DataFrame, path: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """RESULT for doc_id, text (no nulls), by the scan over chunks."""
    parts = written(docs.mapInArrow(trimmed(_split(path, chunk)), "row long, doc_id long, chunk long, left string, body string, right string, safe_left boolean, safe_right boolean"), "chunks")
    spread = parts.repartition("row", "chunk")
    matrices = written(spread.mapInArrow(trimmed(_transfer(path)), "row long, chunk long, matrix binary").withColumn("block", F.expr(f"chunk div {block}")), "matrices")
    products = matrices.groupBy("row", "block").applyInArrow(_product, "row long, block long, matrix binary")
    edges = products.groupBy("row").applyInArrow(_blocks, "row long, block long, edges binary")
    states = matrices.join(edges, ["row", "block"]).groupBy("row", "block").applyInArrow(_inside, "row long, chunk long, states binary")
    traced = parts.join(states, ["row", "chunk"]).mapInArrow(trimmed(_trace(path)), "row long, doc_id long, chunk long, ids array<int>, same boolean")
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"), F.min("same").alias("round_trip"))
    return whole.select("doc_id", F.flatten("parts.ids").alias("ids"), "round_trip").select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding the ids gives the text back, for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.where(F.length("text") <= giant).mapInArrow(trimmed(_whole(path)), RESULT).unionByName(encode_giants(rows.where(F.length("text") > giant), path, chunk, block))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = load(path)
        for batch in batches:
            texts = [sp.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""
    return coded.select("doc_id", "ids").mapInArrow(trimmed(_decode(path)), "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path())
