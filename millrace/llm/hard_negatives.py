"""Hard negatives by a norm-bucketed search for inner products.

1. Vectors are sorted by norm over the whole table, longest first, and cut into buckets of at most BUCKET rows, packed as one row
   each and written. A bucket knows its largest norm, and its rows are in order of theirs.
2. Anchors are packed from the buckets into blocks, which tasks read one at a time from the shared folder.
3. Search: a task goes through its buckets, longest first, once for each block. An anchor's queries each have a window of scores
   and the best k found so far; by Cauchy-Schwarz no row of a norm below bar / |anchor| can matter, the bar being the
   window's lower limit or the running kth score. So buckets, and the tails of those that are read, are left out.
4. Positives are one query an anchor over its own label; negatives are a query for each positive over the other labels. For
   negatives the first SEED buckets are searched by themselves, and the kth scores found there are the bars for the rest.
5. The tasks' best of each query are merged by a window of rank k, of which Spark takes the partial ranks first.

Components become floor(256 * x). Scores are exact: matrix products of doubles where the norms' product is below 2^53, or
else of whole numbers of any size; a score that is returned and is beyond 64 bits is an error. Shorter vectors count as
filled up with zeros. Rows with a null label or vector, or a null or non-finite component, take no part. A null vec_id is
no anchor and comes after all others in ties. Repeated rows are rows of their own: each is an anchor, and the other's
positive. An empty table, or one without anchors, gives no row. Other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import file_system, table, trimmed, written, written_with_sums

#: Most rows and components of a bucket; most anchors of a block; buckets searched first for negatives.
BUCKET, COMPONENTS, BLOCK, SEED = 16_384, 1 << 20, 256, 2
#: Buckets that a task holds at a time, packed.
HELD = 32
POSITIVES, NEGATIVES, EVERY = 5, 10, 100
#: The window of a negative's score in hundredths of its positive's.
LOW, HIGH = 30, 90
EXACT = float(1 << 53)
#: Norms are doubles; bounds leave room for their rounding.
ROOM = 1 + 1e-9

_PACKED = "bucket long, longest double, n int, width int, kind string, vectors binary, ids binary, known binary, labels binary, norms binary"
_BLOCKS = "block long, n int, width int, kind string, vectors binary, at binary, ids binary, labels binary, norms binary, queries string"
_FOUND = "block long, anchor_at long, anchor_id long, query int, positive_id long, positive_score long, at long, vec_id long, score long"


def pack(vectors: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers as the narrowest kind that holds them."""
    top = np.abs(vectors).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, vectors.astype(kind).tobytes()


def unpack(kind: str, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width).astype(float) if width else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of the rows of both; most: the product of the largest norms."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if most < EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T if width else np.zeros((len(a), len(b)), object)


# --- buckets and blocks ---------------------------------------------------------------------------


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, norm, quantised vector of the rows that take part."""
    for batch in batches:
        lists = batch.column("embedding")
        flat, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(256 * x)
            q = np.floor(256 * np.where(good, x, 0.0))
            sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[offsets])
            row = np.repeat(np.arange(len(lists)), np.diff(offsets))
            norm = np.sqrt(np.bincount(row, q * q, len(lists)))
        use = (sums(~good) == 0) & ~np.array(lists.is_null()) & ~np.array(batch.column("label").is_null())
        own = pa.array(np.flatnonzero(use))
        values = pa.BinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer((8 * offsets).astype(np.int64)), pa.py_buffer(q.tobytes())])
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(own), "label": batch.column("label").take(own), "norm": pa.array(norm).take(own), "q": values.take(own).cast(pa.binary())})


def _bucketed(part: int, rows: list, start: int) -> pa.RecordBatch:
    ids, labels, norms, q = (np.concatenate([r[k] for r in rows]) if k != 3 else [v for r in rows for v in r[3]] for k in range(4))
    known = np.concatenate([r[4] for r in rows])
    width = max((len(v) // 8 for v in q), default=0)
    grid = np.zeros((len(q), max(1, width)))
    for k, v in enumerate(q):
        grid[k, : len(v) // 8] = np.frombuffer(v)
    kind, vectors = pack(grid)
    return pa.RecordBatch.from_pydict({"bucket": pa.array([part << 33 | start]), "longest": pa.array([float(norms.max())]), "n": pa.array([len(q)], pa.int32()), "width": pa.array([grid.shape[1]], pa.int32()), "kind": [kind], "vectors": pa.array([vectors], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary()), "norms": pa.array([norms.tobytes()], pa.binary())})


def _packed(size: int, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition, longest first, in buckets; a bucket's number is its place in the order of all."""
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        held: list = []
        n = width = 0
        for batch in batches:
            q = batch.column("q").to_pylist()
            ids, known = batch.column("vec_id").fill_null(0).to_numpy(), ~np.array(batch.column("vec_id").is_null())
            labels, norms = batch.column("label").to_numpy(), batch.column("norm").to_numpy()
            at = 0
            while at < len(q):
                width = max(width, max(len(v) for v in q[at:]) // 8)
                most = max(1, min(size, components // max(1, width)))
                take = min(len(q) - at, max(0, most - n))
                if take:
                    held.append((ids[at : at + take], labels[at : at + take], norms[at : at + take], q[at : at + take], known[at : at + take]))
                at, n = at + take, n + take
                if n >= most:
                    yield _bucketed(part, held, start)
                    start, held, n, width = start + n, [], 0, 0
        if held:
            yield _bucketed(part, held, start)

    return run


def buckets_of(rows: DataFrame, size: int = BUCKET, components: int = COMPONENTS) -> DataFrame:
    """rows (vec_id, label, embedding) in packed buckets by norm, written. A bucket's first row has its number `bucket`, the next the number after it."""
    ready = written(rows.mapInArrow(trimmed(_quantised), "vec_id long, label long, norm double, q binary"), "quantised-vectors")
    order = [F.desc("norm"), F.xxhash64("vec_id", "q").alias("mixed")]
    dealt = ready.withColumn("mixed", F.xxhash64("vec_id", "q")).repartitionByRange(order[0], "mixed").sortWithinPartitions(order[0], "mixed").drop("mixed")
    return written(dealt.mapInArrow(trimmed(_packed(size, components)), _PACKED), "norm-buckets")


def _anchors(every: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                own = np.flatnonzero(known & (ids % every == 0))
                v = unpack(r["kind"], r["width"], r["vectors"])
                labels, norms = np.frombuffer(r["labels"], np.int64), np.frombuffer(r["norms"])
                for a in range(0, len(own), size):
                    k = own[a : a + size]
                    kind, vectors = pack(v[k])
                    parts = {"vectors": vectors, "at": (r["bucket"] + k).tobytes(), "ids": ids[k].tobytes(), "labels": labels[k].tobytes(), "norms": norms[k].tobytes()}
                    whole = {"block": pa.array([r["bucket"] + int(k[0])]), "n": pa.array([len(k)], pa.int32()), "width": pa.array([r["width"]], pa.int32()), "kind": pa.array([kind])}
                    yield pa.RecordBatch.from_pydict(whole | {c: pa.array([x], pa.binary()) for c, x in parts.items()} | {"queries": pa.nulls(1, pa.string())})

    return run


def blocks_in(folder: str) -> Iterator[dict]:
    """The blocks of anchors in a folder, one at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, path = file_system(folder)
    for f in sorted(x.path for x in fs.get_file_info(FileSelector(path)) if x.path.endswith(".parquet")):
        with fs.open_input_file(f) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1):
                yield from batch.to_pylist()


# --- the search -----------------------------------------------------------------------------------


class Query:
    """A query's window of scores and its best k: higher scores first, then smaller ids, unknown ones last. bar: what a score must reach."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None, bar: int | None = None, positive: int | None = None, score: int | None = None):
        self.k, self.high, self.positive, self.score, self.rows = k, high, positive, score, []
        self.bar = max((x for x in (low, bar) if x is not None), default=None)

    def add(self, scores: np.ndarray, bucket: dict, use: np.ndarray) -> None:
        """Takes in the rows `use` of a bucket, with their scores."""
        fits = np.ones(len(use), bool) if self.bar is None else scores >= self.bar
        fits = fits if self.high is None else fits & (scores <= self.high)
        scores, use = scores[fits], use[fits]
        ids, known = bucket["ids"][use], bucket["known"][use]
        if len(use) > self.k:  # those above the kth score, and of those equal to it the first k by id
            kth = np.sort(scores)[-self.k]
            equal = np.flatnonzero(scores == kth)
            equal = equal[np.lexsort((ids[equal], ~known[equal]))[: self.k]]
            picked = np.concatenate([np.flatnonzero(scores > kth), equal]).tolist()
        else:
            picked = range(len(use))
        self.rows += [(-int(scores[j]), not known[j], int(ids[j]), int(bucket["bucket"] + use[j])) for j in picked]
        self.rows.sort()
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.bar = -self.rows[-1][0]


def least_norm(queries: list[Query], norm: float) -> float:
    """The norm from which on a row can matter to an anchor, by Cauchy-Schwarz."""
    if not queries:
        return np.inf
    if any(q.bar is None or q.bar <= 0 for q in queries):
        return -1.0
    return min(q.bar for q in queries) / (norm * ROOM) / ROOM if norm else np.inf


def opened(row: dict) -> dict:
    """A packed bucket or block with its arrays; vectors stay packed."""
    kinds = {"at": np.int64, "ids": np.int64, "labels": np.int64, "norms": np.float64, "known": bool}
    return row | {c: np.frombuffer(row[c], t) for c, t in kinds.items() if c in row}


def search_block(block: dict, buckets: list[dict], k: int, same: bool, told: dict | None = None) -> list[tuple]:
    """A block's queries over buckets (both opened), longest first, over the anchor's own label or all others: rows of _FOUND without the block.

    told: gets how many pairs of block and bucket, and how many rows in them, were scored.
    """
    a, at, ids, labels, norms = unpack(block["kind"], block["width"], block["vectors"]), block["at"], block["ids"], block["labels"], block["norms"]
    asked = [[Query(k, *q) for q in own] for own in json.loads(block["queries"])] if block["queries"] else [[Query(k)] for _ in ids]
    for b in buckets:
        least = np.array([least_norm(q, float(n)) for q, n in zip(asked, norms)])
        live = np.flatnonzero(least <= b["longest"])
        if not len(live):
            continue
        rows = int(np.searchsorted(-b["norms"], -least[live].min(), side="right"))
        s = products(a[live], unpack(b["kind"], b["width"], b["vectors"])[:rows], float(norms[live].max()) * b["longest"])
        if told is not None:
            told["pairs"], told["rows"] = told.get("pairs", 0) + 1, told.get("rows", 0) + rows
        for r, i in enumerate(live.tolist()):
            own = b["labels"][:rows] == labels[i]
            if same:
                own &= np.arange(rows) != at[i] - b["bucket"]
            else:
                own = ~own
            bars = [q.bar for q in asked[i]]
            use = np.flatnonzero(own if None in bars else own & (s[r] >= min(bars)))
            for q in asked[i]:
                q.add(s[r][use], b, use)
    return [(int(at[i]), int(ids[i]), n, q.positive, q.score, place, None if unknown else vec, -score) for i, own in enumerate(asked) for n, q in enumerate(own) for score, unknown, vec, place in q.rows]


def _search(folder: str, k: int, same: bool):
    names = _FOUND.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def found():
            held.sort(key=lambda b: b["bucket"])
            for block in blocks_in(folder):
                rows = search_block(opened(block), held, k, same)
                columns = [[block["block"]] * len(rows), *(list(c) for c in zip(*rows))] if rows else [[]] * len(names)
                yield pa.RecordBatch.from_pydict({n.split()[0]: pa.array(c, pa.int32() if n.endswith("int") else pa.int64()) for n, c in zip(names, columns)})
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                held.append(opened(row))
                if len(held) == HELD:
                    yield from found()
        if held:
            yield from found()

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor's query, with their rank."""
    order = Window.partitionBy("anchor_at", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asking(low: int, high: int):
    def run(block: pa.Table, positives: pa.Table) -> pa.Table:
        """A block with a query for each of its anchors' positives."""
        own: dict[int, list] = {}
        for r in sorted(positives.to_pylist(), key=lambda r: r["rank"]):
            s = r["score"]
            window = -(-low * s // 100), high * s // 100
            if window[0] <= window[1]:
                own.setdefault(r["anchor_at"], []).append([*window, None, r["vec_id"], s])
        at = np.frombuffer(block["at"][0].as_py(), np.int64).tolist()
        return block.set_column(block.column_names.index("queries"), "queries", pa.array([json.dumps([own.get(x, []) for x in at])]))

    return run


def _raised(block: pa.Table, bars: pa.Table) -> pa.Table:
    """A block whose queries have the kth scores that were found so far as their bars."""
    known = {(r["anchor_at"], r["query"]): r["bar"] for r in bars.to_pylist()}
    at, asked = np.frombuffer(block["at"][0].as_py(), np.int64).tolist(), json.loads(block["queries"][0].as_py())
    for x, own in zip(at, asked):
        for n, q in enumerate(own):
            q[2] = known.get((x, n))
    return block.set_column(block.column_names.index("queries"), "queries", pa.array([json.dumps(asked)]))


def _with(blocks: DataFrame, more: DataFrame, f, name: str) -> tuple[DataFrame, str]:
    """(blocks changed by f with the rows of `more` that are theirs, their folder)."""
    made = blocks.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(f, _BLOCKS)
    out, _, folder = written_with_sums(made, name)
    return out, folder


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, low: int = LOW, high: int = HIGH, size: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, embedding)."""
    buckets = buckets_of(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"), size)
    blocks, _, folder = written_with_sums(buckets.mapInArrow(trimmed(_anchors(every, block)), _BLOCKS), "anchor-blocks")
    near = written(ranked(buckets.mapInArrow(trimmed(_search(folder, positives, True)), _FOUND), positives), "positives")
    blocks, folder = _with(blocks, near.select("block", "anchor_at", "rank", "vec_id", "score"), _asking(low, high), "asking-blocks")

    first = [r.bucket for r in buckets.select("bucket").orderBy("bucket").limit(SEED).collect()]
    edge = first[-1] if first else 0
    seeds = written(ranked(buckets.where(F.col("bucket") <= edge).mapInArrow(trimmed(_search(folder, negatives, False)), _FOUND), negatives).drop("rank"), "seeds")
    bars = seeds.groupBy("block", "anchor_at", "query").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") == negatives)
    _, folder = _with(blocks, bars, _raised, "raised-blocks")
    rest = buckets.where(F.col("bucket") > edge).mapInArrow(trimmed(_search(folder, negatives, False)), _FOUND)
    best = ranked(seeds.unionByName(rest), negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return mine(rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding"))


ORACLE = """WITH r AS (SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.no, a.vec_id AS anchor_id, a.label = c.label AS same, c.no AS other, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.no <> c.no),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.no = p.no AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.no, p.other ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10"""
