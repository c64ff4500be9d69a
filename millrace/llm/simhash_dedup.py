"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits share at least six of
them: the guaranteed minimum. The positions lie in four blocks of two; at least two blocks are shared whole, so the
index lists each distinct fingerprint under the six pairs of blocks. In a list a pair's tally counts its shared
positional bytes, and only pairs that reach the minimum are verified by their differing bits. (Lists of single
positions would hold a 256th of all fingerprints each, and their pairs grow with the square of the input.) A list of
more than LIST fingerprints, which many copies with small edits make, is probed with all flips of one and two bits in
the places where it varies, which finds the same pairs. A list reports a spanning set of links, never all pairs.

Copies share a fingerprint and enter the index once. Null texts count as empty; a text without words has the
fingerprint zero and is linked like any other; a row with a null doc_id gets its component's id, which is null only
where no linked row has one. Repeated rows are kept. An empty table gives an empty result; other columns are not read;
texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, VISIBLE, majority, pieces_of, raw, strings, table, trimmed, word_spans, written, xxh64
from millrace.llm.components import components, stars

SHINGLE, SEED, BITS = 3, 42, 2
#: Positional bytes of a block; fingerprints of a list up to which its pairs are tallied.
BLOCK, LIST = 2, 512


def fingerprints_of(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """A fingerprint of each text: a bit is 1 if set in over half of its shingles' hashes, repeats included."""
    buf, offsets = raw(texts)
    buf = LOWER[buf]
    starts, ends, doc = word_spans(buf, offsets, VISIBLE)
    out = np.zeros(len(texts), np.uint64)
    if not len(starts):
        return out
    length = ends - starts
    first = np.cumsum(length + 1) - (length + 1)  # words in their texts' order, with one space between
    joined = np.full(int(length.sum()) + len(starts), 32, np.uint8)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(starts)), length)] = buf[VISIBLE[buf]]
    own, begin, n = np.unique(doc, return_index=True, return_counts=True)
    count = np.maximum(1, n - size + 1)
    at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    last = at + np.repeat(np.minimum(n, size), count) - 1
    out[own] = majority(xxh64(joined, first[at], first[last] + length[last], SEED), count).view("<u8").reshape(-1)
    return out


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in pieces_of(strings(batch.column("text")), 2 << 20):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(piece)), "code": pa.array(fingerprints_of(piece, size).view(np.int64))})

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and code, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_fingerprints(size)), "doc_id long, code long")


def index_blocks(bits: int = BITS) -> list[tuple[int, ...]]:
    """The choices of blocks of which two fingerprints at `bits` differing bits share at least one whole."""
    blocks = 8 // BLOCK
    if not 0 < bits < blocks:
        raise ValueError(f"fingerprints of {blocks} blocks may differ in {blocks - 1} bits at most")
    return list(combinations(range(blocks), blocks - bits))


def flipped(codes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as places) of distinct fingerprints at `bits` differing bits or fewer, found by flipping what varies among them."""
    order = np.argsort(codes)
    known, n = codes[order], len(codes)
    varying = int(np.bitwise_or.reduce(codes ^ codes[0]))
    places = [1 << k for k in range(64) if varying >> k & 1]
    a, b = [], []
    for flip in (sum(c) for k in range(1, bits + 1) for c in combinations(places, k)):
        other = known ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(known, other), n - 1)
        hit = np.flatnonzero((known[at] == other) & (at > np.arange(n)))
        a.append(order[hit])
        b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def tallied(keys: np.ndarray, codes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as places) of one list whose shared positional bytes reach the minimum and whose bits verify them. Rows are sorted by key."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, d = np.arange(len(keys)), 0
    while len(live):  # pairs at a distance of d rows, over all lists
        d += 1
        live = live[: np.searchsorted(live, len(keys) - d)]
        live = live[keys[live] == keys[live + d]]
        apart = codes[live] ^ codes[live + d]
        shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        some = shared >= 8 - bits
        near = live[some][np.bitwise_count(apart[some]) <= bits]
        a.append(near)
        b.append(near + d)
    return np.concatenate(a), np.concatenate(b)


def linked(keys: np.ndarray, codes: np.ndarray, bits: int = BITS, most: int = LIST) -> tuple[np.ndarray, np.ndarray]:
    """Links of lists' distinct fingerprints (uint64): each with the first one of its list that differing bits connect it with."""
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    long = ends - starts > most
    short = np.flatnonzero(np.repeat(~long, ends - starts))
    a, b = tallied(keys[short], codes[short], bits)
    a, b = [short[a]], [short[b]]
    for s, e in zip(starts[long], ends[long]):
        x, y = flipped(codes[s:e], bits)
        a.append(x + s)
        b.append(y + s)
    label = components(len(keys), np.concatenate(a), np.concatenate(b))
    own = np.flatnonzero(label != np.arange(len(keys)))
    return codes[own], codes[label[own]]


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a list that a batch cuts is carried over. A list's fingerprints share four bytes, so it is bounded."""
        keys, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told(keys, codes):
            a, b = linked(keys, codes.view(np.uint64), bits)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            codes = np.concatenate([codes, batch.column("code").to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield told(keys[:cut], codes[:cut])
                keys, codes = keys[cut:], codes[cut:]
        if len(keys):
            yield told(keys, codes)

    return run


def links(codes: DataFrame, bits: int = BITS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints at `bits` differing bits or fewer."""
    block = lambda k: F.shiftrightunsigned("code", 8 * BLOCK * k).bitwiseAND(F.lit((1 << 8 * BLOCK) - 1).cast("long"))
    keys = []
    for n, chosen in enumerate(index_blocks(bits)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, 8 * BLOCK).bitwiseOR(block(k))
        keys.append(key)
    index = codes.select("code", F.explode(F.array(*keys)).alias("key"))
    return index.repartition("key").sortWithinPartitions("key", "code").select("key", "code").mapInArrow(trimmed(_links(bits)), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    coded = written(fingerprints(docs, size), "fingerprints")
    codes = written(coded.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    roots = stars(links(codes.select("code"), bits))
    of = codes.join(roots.select(F.col("a").alias("code"), F.col("b").alias("root")), "code", "left").select("code", F.coalesce("root", "code").alias("root"), "first")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    told = written(of.join(least, "root").select("code", "component_id"), "components")
    return coded.join(told, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
