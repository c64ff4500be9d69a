"""Language identification by error-correcting output codes.

1. Every language gets a codeword. Up to five languages have the exhaustive code, of all ways to part them in two; more
   have the best of many random codes of ten bits for each doubling, by their least distance.
2. A bit's classifier tells the languages that have the bit from those that don't, by the log-likelihood ratio of a text's
   n-grams of 1 to 4 bytes. The counts behind it are taken over all labelled training texts, whole, summed in
   each task and then in Spark, and every language weighs the same, however much text it has.
3. Classifiers are weighted for each language by the share of its training texts that they get right.
4. Decoding takes the codeword with the least weighted logistic loss to the margins of the bits. The score is the
   codeword's share of the exponentials of the negative losses; texts whose two nearest codewords are closer than CLOSE
   are flagged as ambiguous.

The driver and the tasks hold the counts of BUCKETS n-grams for each language, and nothing that grows with the
documents. Predictions read the text alone. A text that is null or has no letter is `und` with score 0, and so is every
text where there is nothing to learn from; where one language alone is learnt, it is the prediction, with score 1. Rows with
a null doc_id, text or label aren't learnt from; all rows are predicted, repeated ones alike. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pieces_of, raw, strings, table, trimmed, written

#: Bytes of n-grams, and the buckets that they are hashed to.
GRAMS, BITS = (1, 2, 3, 4), 16
BUCKETS = 1 << BITS
#: N-grams of the mean language that each language's counts are smoothed with; most that one n-gram may say.
SMOOTH, MOST = 2000.0, 4.0
#: Neighbouring n-grams say the same thing over: the part of their sum that counts as evidence.
EVIDENCE = 1 / (4 * len(GRAMS))
#: Difference of two losses below which a text is ambiguous.
CLOSE = 1.0
#: Languages that a task counts before it tells its sums.
HELD = 64
UNKNOWN = "und"

_SPACE = 32
_LETTERS = np.full(256, _SPACE, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of lower-cased texts: what is no letter and below 128 is a space, runs of them are one, and three spaces lead each text."""
    buf, offsets = raw(pc.utf8_lower(texts))
    buf = _LETTERS[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    keep = buf != _SPACE
    keep[1:] |= (buf[:-1] != _SPACE) & ~first[1:-1]
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    lead = np.repeat(at[:-1], 3)
    return np.insert(buf[keep], lead, _SPACE), at + 3 * np.arange(len(at))


def grams(texts: pa.Array, size: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts' numbers, where each one's begin, buckets) of all n-grams, a stretch of bytes and one n at a time. What follows a text counts as spaces."""
    buf, offsets = letters(texts)
    padded = np.concatenate([buf, np.full(8, _SPACE, np.uint8)])
    lanes = np.ndarray((len(buf),), "<u8", padded.data, 0, (1,))
    for at in range(0, len(buf), size):
        to = min(at + size, len(buf))
        low, high = int(np.searchsorted(offsets, at, side="right")) - 1, int(np.searchsorted(offsets, to, side="left"))
        text = np.arange(low, high)
        begin = np.maximum(offsets[low:high] - at, 0)
        for n in GRAMS:
            mask = np.uint64((1 << (8 * n)) - 1)
            yield text, begin, (((lanes[at:to] & mask) + np.uint64(n)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


# --- codewords ------------------------------------------------------------------------------------


def codewords(n: int, tries: int = 200) -> np.ndarray:
    """(n, bits) of +1 and -1."""
    if n < 2:
        return np.zeros((n, 0), np.float32)
    if n <= 5:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c], np.float32).T
    bits, rng = max(15, int(np.ceil(10 * np.log2(n)))), np.random.default_rng(11)
    best, least = None, -1.0
    for _ in range(tries):
        code = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.float32)
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        if (np.abs(code.sum(axis=0)) < n).all() and apart.min() > least:
            best, least = code, float(apart.min())
    return best


# --- the model ------------------------------------------------------------------------------------


class Codes:
    """Languages with their codewords, the n-gram weights of each bit, and each bit's weight for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        if len(languages) > 1:
            total = counts.sum(axis=1, keepdims=True)
            mean = (counts / np.maximum(total, 1)).mean(axis=0) * 0.99 + 0.01 / BUCKETS
            p = (counts + SMOOTH * mean) / (total + SMOOTH)
            for b in range(self.code.shape[1]):
                has = self.code[:, b] > 0
                self.weights[:, b] = np.clip(np.log(p[has].mean(axis=0) / p[~has].mean(axis=0)), -MOST, MOST)
        self.trust = np.full(self.code.shape, 1.0 / max(1, self.code.shape[1]), np.float32)

    def weigh(self, right: np.ndarray, texts: np.ndarray) -> None:
        """right: training texts of each language that each bit gets right, of so many."""
        share = (right + 1.0) / (texts[:, None] + 2.0)
        self.trust = (share / share.sum(axis=1, keepdims=True)).astype(np.float32)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """(texts, bits): the evidence for each bit, of whole texts."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for a, piece in pieces_of(texts, 2 << 20):
            for text, begin, bucket in grams(piece):
                for b in range(out.shape[1]):
                    out[a + text, b] += np.add.reduceat(self.weights[:, b][bucket], begin, dtype=np.float64)
        return out * EVIDENCE

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest codeword, score, whether another is close)."""
        loss = np.stack([np.logaddexp(0, -margins * c) @ w for c, w in zip(self.code, self.trust)], axis=1) * self.code.shape[1] if self.code.shape[1] else np.zeros((len(margins), 1))
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        best = loss.argmin(axis=1)
        near = np.sort(loss, axis=1)[:, 1] - loss.min(axis=1) < CLOSE if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, 1 / share.sum(axis=1), near


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def told():
        for lang, n in sorted(held.items()):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})
        held.clear()

    for batch in batches:
        texts, langs = strings(batch.column("text")), batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            for _, piece in pieces_of(texts.filter(pc.equal(langs, lang)), 2 << 20):
                n = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, _, bucket in grams(piece):
                    n += np.bincount(bucket, minlength=BUCKETS)
            if len(held) >= HELD:
                yield from told()
    yield from told()


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        place = {lang: k for k, lang in enumerate(codes.languages)}
        right, texts = np.zeros(codes.code.shape, np.int64), np.zeros(len(place), np.int64)
        for batch in batches:
            own = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            good = codes.margins(strings(batch.column("text"))) * codes.code[own] > 0
            np.add.at(right, own, good)
            texts += np.bincount(own, minlength=len(texts))
        k, b = (x.ravel() for x in np.indices(right.shape))
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(k, np.arange(len(texts))), pa.int32()), "b": pa.array(np.append(b, np.full(len(texts), -1)), pa.int32()), "n": pa.array(np.append(right.ravel(), texts))})

    return run


def train(labelled: DataFrame) -> Codes:
    """A model of labelled rows (text, lang); rows without either are left out."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = rows.mapInArrow(trimmed(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(summed, "language-counts").toArrow()
    languages = sorted(pc.unique(counts["lang"]).to_pylist())
    grid = np.zeros((len(languages), BUCKETS))
    if languages:
        grid[pc.index_in(counts["lang"], pa.array(languages)).to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    codes = Codes(languages, grid)
    if len(languages) > 1:
        shared = spark.sparkContext.broadcast(codes)
        seen = rows.mapInArrow(trimmed(_judge(shared)), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).collect()
        right, texts = np.zeros(codes.code.shape, np.int64), np.zeros(len(languages), np.int64)
        for k, b, n in seen:
            if b < 0:
                texts[k] = n
            else:
                right[k, b] = n
        codes.weigh(right, texts)
    return codes


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            texts = strings(batch.column("text"))
            known = np.array(pc.match_substring_regex(texts, r"\p{L}")) & bool(codes.languages)
            best, score, close = codes.decode(codes.margins(texts))
            names = pa.array([*codes.languages, UNKNOWN])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), names.take(pa.array(np.where(known, best, len(names) - 1))), pa.array(np.where(known, score, 0.0)), pa.array(close & known)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, codes: Codes, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row, by its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_predict(shared)), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def third(doc_id: str = "doc_id") -> Column:
    """The rest by three of the crc32 of the id's digits; null if the id is."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(third() != 1)), F.coalesce(third() == 1, F.lit(False)))
