"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all ordered thresholds; the expected severity is the
sum of these probabilities. Features are the words of a text and their beginnings (so that a compound of a toxic
stem is known by it), hashed, each counted once a text; scoring reads every whole text.

Training takes at most MAX_ROWS labelled doc_ids, those with the smallest hash, and of rows that share one the one with
the smallest hash of its text. Features are counted over them in Spark; all that tell toxic rows from others by more
standard errors than chance brings among so many reach the driver, with the numbers of the rows that have them.

Grades are read from the labels: 0 where toxic is 0 or null; toxic rows are graded 1, or 2 (severe) if they hold more
than the median number of the features that mark toxic rows. Null texts are empty, and an empty text has the
severity of no feature; null doc_ids are scored and kept; repeated rows are scored alike; with labels of one grade
alone every severity is that grade. Rejected is what has an expected severity of at least `reject`. Without labels, or
with an empty table of documents, every severity is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pieces_of, raw, span_hashes, strings, table, trimmed, word_spans, written_with_sums

#: Most labelled rows that a fit uses. A feature takes part from LEAST rows on.
MAX_ROWS, LEAST = 8000, 3
BUCKETS = 1 << 20
#: Bytes of a word's beginnings that are features beside the whole word.
STEMS = (5, 6, 7)
REJECT = 0.5


def features(texts: pa.Array, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each text's distinct features, in order. of: the buckets that count."""
    rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    buf, offsets = raw(pc.utf8_lower(texts))
    starts, ends, doc = word_spans(buf, offsets)
    for at in range(0, len(starts), 1 << 18):
        s, e, d = starts[at : at + (1 << 18)], ends[at : at + (1 << 18)], doc[at : at + (1 << 18)]
        for k, size in enumerate((None, *STEMS)):
            longer = slice(None) if size is None else e - s > size
            x, r = s[longer], d[longer]
            h = (span_hashes(buf, x, e if size is None else x + size) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            b = (h >> np.uint64(44)).astype(np.int64)
            if of is not None:
                r, b = r[of[b]], b[of[b]]
            rows.append(r)
            buckets.append(b)
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
    return both // BUCKETS, both % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """Weights over buckets and ordered thresholds; without thresholds every severity is `constant`."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, constant: float = 0.0):
        self.weights, self.thresholds, self.constant = weights, thresholds, constant

    def severity(self, texts: pa.Array) -> np.ndarray:
        """The expected severity of each text."""
        out = np.full(len(texts), self.constant)
        if not len(self.thresholds):
            return out
        used = self.weights != 0
        for at, piece in pieces_of(texts, 2 << 20):
            row, bucket = features(piece, used)
            eta = np.bincount(row, self.weights[bucket], len(piece))
            out[at : at + len(piece)] = _sigmoid(eta[:, None] - self.thresholds[None, :]).sum(axis=1)
        return out


def least_errors(features: int) -> float:
    """Standard errors that about none of so many features reaches by chance."""
    return float(np.sqrt(2 * np.log(max(features, 2))) + 0.5)


def thresholds_of(steps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first one, and the logarithms of the steps to the next ones."""
    return np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def loss(w: np.ndarray, row: np.ndarray, column: np.ndarray, grade: np.ndarray, width: int, ridge: float) -> tuple[float, np.ndarray]:
    """(penalised mean negative log-likelihood, its gradient) of weights and threshold steps. One prior for all sample sizes."""
    n, top = len(grade), len(w) - width
    theta, eta = thresholds_of(w[width:]), np.bincount(row, w[column], n)
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    a, b = _sigmoid(edge[grade + 1] - eta), _sigmoid(edge[grade] - eta)
    p = np.maximum(a - b, 1e-12)
    up, down = a * (1 - a) / p, b * (1 - b) / p
    d_theta = np.bincount(grade, up, top + 1)[:top] - np.bincount(grade, down, top + 1)[1:]
    later = np.cumsum(d_theta[::-1])[::-1]
    g = -np.concatenate([np.bincount(column, (a + b - 1)[row], width), later * np.concatenate([[1.0], np.exp(w[width + 1 :])])]) / n
    g[:width] += ridge / n * w[:width]
    return float(-np.log(p).mean() + ridge / (2 * n) * (w[:width] ** 2).sum()), g


def fit(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, steps: int = 2000, rate: float = 0.05, ridge: float = 0.1) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows, with a weight for each bucket that occurs."""
    kinds = np.unique(grade)
    if len(kinds) < 2:
        return OrdinalModel(np.zeros(BUCKETS), np.zeros(0), float(kinds[0]) if len(kinds) else 0.0)
    chosen, column = np.unique(bucket, return_inverse=True)
    width, top = len(chosen), int(grade.max())
    w, m, v = np.zeros(width + top), np.zeros(width + top), np.zeros(width + top)
    w[width] = 2.0
    for step in range(1, steps + 1):
        _, g = loss(w, row, column, grade, width, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * min(1.0, 4 * (1 - step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[chosen] = w[:width]
    return OrdinalModel(weights, thresholds_of(w[width:]))


def graded(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic; 1 or 2 for toxic ones, by their number of marking features against the median."""
    n, hits = np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, toxic[row], BUCKETS)
    marks = (n >= 5) & (hits > 0.9 * n)
    count = np.bincount(row, marks[bucket], len(toxic))
    middle = np.median(count[toxic]) if toxic.any() else 0
    return np.where(toxic, 1 + (count > middle), 0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, piece in pieces_of(strings(batch.column("text"))):
            row, bucket = features(piece)
            offsets = np.searchsorted(row, np.arange(len(piece) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(piece)), "toxic": batch.column("toxic").slice(at, len(piece)), "buckets": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))})


def _kept(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(BUCKETS, bool)
        used[chosen] = True
        for batch in batches:
            lists = batch.column("buckets")
            bucket, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            row, bucket = row[used[bucket]], bucket[used[bucket]]
            offsets = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "buckets": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket))})

    return run


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, toxic, buckets of at most max_rows labelled rows, one for each doc_id."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("toxic"), F.lit(0))).cast("int").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = told.join(own, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.mapInArrow(trimmed(_sampled), "doc_id long, toxic int, buckets array<int>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int | None = None) -> OrdinalModel:
    """Fits on at most max_rows labelled rows of docs, and on all telling features of theirs unless max_features is given."""
    sample, seen, _ = written_with_sums(sampled(docs, labels, max_rows), "labelled", n=F.count(F.lit(1)), toxic=F.sum("toxic"))
    rows, toxic = seen["n"], int(seen["toxic"] or 0)
    counts = sample.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits")).where(F.col("n") >= LEAST)
    counts, found, _ = written_with_sums(counts, "feature-counts", n=F.count(F.lit(1)))
    base = toxic / max(rows, 1)
    z = F.abs((F.col("hits") - F.col("n") * base) / F.sqrt(F.greatest(F.col("n") * (base * (1 - base)), F.lit(1e-9))))
    telling = counts.withColumn("z", z).where(F.col("z") >= least_errors(found["n"]))
    best = (telling if max_features is None else telling.orderBy(F.desc("z"), "bucket").limit(max_features)).select("bucket").toArrow()
    chosen = np.sort(best.column("bucket").to_numpy().astype(np.int64))
    kept = sample.mapInArrow(trimmed(_kept(chosen)), sample.schema).toArrow().combine_chunks().sort_by("doc_id")
    lists = kept.column("buckets").combine_chunks() if kept.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    bucket = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    marked = kept.column("toxic").to_numpy() > 0
    return fit(row, bucket, graded(row, bucket, marked))


def severities(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """doc_id, severity, grade (the nearest whole one), toxic for each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.severity(strings(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "severity": pa.array(s), "grade": pa.array(np.rint(s).astype(np.int32)), "toxic": pa.array(s >= reject)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(score), "doc_id long, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """The rows, with all their columns, whose severity is below `reject`."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.severity(strings(batch.column("text"))) < reject))

    return docs.mapInArrow(trimmed(keep), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severities(docs, train(docs, table(spark, sf_dir, "labels")))
