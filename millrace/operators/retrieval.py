"""Exact cosine retrieval over the star of datasets, documents, paragraphs and sentences.

Every search filters by flags and datasets, scores each remaining row in the JVM against a one-row broadcast query, and
keeps scores strictly above the threshold; only then it joins: what the joins shuffle is the matches, without vectors
or contents. The best k are taken last (ties go to the smaller id), and the contents of these k rows are fetched by a
broadcast of the k ids. Datasets are a small table: they are broadcast when Spark's statistics say so. Without a match
the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vector import cosine, squared
from millrace.operators.predicates import checked
from millrace.schema import DEFAULT_SIMILARITY, DEFAULT_TOP_N
from millrace.session import reachable


def scored(rows: DataFrame, query: DataFrame, vector: str = "embedding", nan_policy: str = "drop") -> DataFrame:
    """rows with their similarity to the one row of query (v). The query's length is computed once."""
    q = query.select(F.col("v").alias("_query"), squared("v").alias("_length")).limit(1)
    return rows.crossJoin(F.broadcast(q)).withColumn("similarity", cosine(vector, "_query", nan_policy=nan_policy, b_squared="_length")).drop("_query", "_length")


def top(df: DataFrame, similarity: float | None = None, k: int | None = None, key: str = "id") -> DataFrame:
    t, n = DEFAULT_SIMILARITY if similarity is None else similarity, DEFAULT_TOP_N if k is None else k
    return df.where(F.col("similarity") > float(t)).orderBy(F.desc("similarity"), key).limit(n)


def knn(df: DataFrame, query: DataFrame, columns: list[str], similarity: float | None = None, k: int | None = None, vector: str = "embedding", key: str = "id", nan_policy: str = "drop") -> DataFrame:
    """The best k rows of any table with a vector column, projected to the given columns and the score."""
    own = df.select(*dict.fromkeys([*checked(df, columns), key, vector]))
    return top(scored(own, query, vector, nan_policy), similarity, k, key).select(*columns, "similarity")


def matches(rows: DataFrame, query: DataFrame, similarity: float | None, vector: str, dataset_ids: list[int] | None, scope: DataFrame | None) -> DataFrame:
    """rows of the datasets whose score is above the threshold, without their vectors."""
    if dataset_ids is not None:
        rows = rows.where(F.col("dataset_id").isin(dataset_ids))
    if scope is not None:
        rows = rows.join(scope.select("dataset_id").distinct(), "dataset_id", "left_semi")
    t = DEFAULT_SIMILARITY if similarity is None else similarity
    return scored(rows.where(F.col(vector).isNotNull()), query, vector).where(F.col("similarity") > float(t)).drop(vector)


def named(hits: DataFrame, documents: DataFrame, datasets: DataFrame) -> DataFrame:
    """hits with their document's and visible dataset's names. A deleted document still yields hits."""
    d = documents.select(F.col("id").alias("document_id"), F.col("name").alias("document_name"))
    ds = datasets.where("deleted = 0").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return hits.join(d, "document_id").join(ds, "dataset_id")


HIT_COLUMNS = ["id", "document_id", "document_name", "dataset_id", "dataset_name", "title", "status", "is_active", "similarity"]
#: What is fetched for the hits alone.
PARAGRAPH_DETAIL, SENTENCE_DETAIL = ["content", "hit_num", "create_time", "update_time"], ["content", "hit_num"]


def detailed(hits: DataFrame, rows: DataFrame, columns: list[str], k: int | None = None) -> DataFrame:
    """A search's hits, in order, with columns of their rows. The hits are at most k rows: up to HITS they go to the rows, not the rows to them."""
    few = (DEFAULT_TOP_N if k is None else k) <= HITS
    return rows.select("id", *columns).join(F.broadcast(hits) if few else hits, "id").select(*HIT_COLUMNS, *columns, F.col("similarity").alias("comprehensive_score")).orderBy(F.desc("similarity"), "id")


def paragraph_search(paragraphs: DataFrame, documents: DataFrame, datasets: DataFrame, query: DataFrame, dataset_ids: list[int] | None = None, similarity: float | None = None, k: int | None = None, scope: DataFrame | None = None, vector: str = "embedding") -> DataFrame:
    p = paragraphs.where("is_active AND deleted = 0").select("id", "document_id", "dataset_id", "title", "status", "is_active", vector)
    hits = top(named(matches(p, query, similarity, vector, dataset_ids, scope), documents, datasets), similarity, k).select(*HIT_COLUMNS)
    return detailed(hits, paragraphs, PARAGRAPH_DETAIL, k)


def title_search(paragraphs: DataFrame, documents: DataFrame, datasets: DataFrame, query: DataFrame, dataset_ids: list[int] | None = None, similarity: float | None = None, k: int | None = None) -> DataFrame:
    """Paragraphs by their titles' vectors; documents are joined outer, datasets outer and then filtered."""
    p = paragraphs.where("is_active AND deleted = 0").select("id", "document_id", "dataset_id", "title", "status", "is_active", "title_embedding")
    hits = matches(p, query, similarity, "title_embedding", dataset_ids, None)
    d = documents.select(F.col("id").alias("document_id"), F.col("name").alias("document_name"))
    ds = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), F.col("deleted").alias("dataset_deleted"))
    rows = hits.join(d, "document_id", "left").join(ds, "dataset_id", "left").where("dataset_deleted = 0")
    return detailed(top(rows, similarity, k).select(*HIT_COLUMNS), paragraphs, PARAGRAPH_DETAIL, k)


def sentence_search(sentences: DataFrame, paragraphs: DataFrame, documents: DataFrame, datasets: DataFrame, query: DataFrame, dataset_ids: list[int] | None = None, similarity: float | None = None, k: int | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Split sentences (type 1) and summaries (type 2): only the former need an active paragraph, the latter an active document.

    Ids are unique in each table, so rows are distinct as they are.
    """
    s = matches(sentences.where("deleted = 0").drop("deleted"), query, similarity, "embedding", dataset_ids, scope)
    d = documents.select(F.col("id").alias("document_id"), F.col("name").alias("document_name"), F.col("is_active").alias("d_active"))
    ds = datasets.where("deleted = 0").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    p = paragraphs.select(F.col("id").alias("p_id"), F.col("title").alias("p_title"), F.col("status").alias("p_status"), F.col("is_active").alias("p_active"))
    rows = s.join(ds, "dataset_id").join(d, "document_id").join(p, (F.col("type") == 1) & (F.col("paragraph_id") == F.col("p_id")), "left")
    rows = rows.where("(type = 1 AND p_active) OR (type = 2 AND d_active)").select(
        "id",
        "document_id",
        "document_name",
        "dataset_id",
        "dataset_name",
        F.when(F.col("type") == 1, F.col("p_title")).otherwise("").alias("title"),
        F.when(F.col("type") == 1, F.col("p_status")).otherwise("1").alias("status"),
        F.when(F.col("type") == 1, F.col("p_active")).otherwise(F.col("d_active")).alias("is_active"),
        "similarity",
    )
    return detailed(top(rows, similarity, k), sentences, SENTENCE_DETAIL, k)


def search(mode: str, scope: str, paragraph, sentence) -> DataFrame | None:
    """Dispatch: dataset scope searches sentences for "embedding" and paragraphs for "blend"; applications always sentences."""
    if mode not in ("embedding", "blend"):
        return None
    return paragraph() if scope == "dataset" and mode == "blend" else sentence()


def top_per_group(df: DataFrame, query: DataFrame, group: str, k: int, similarity: float = 0.0, vector: str = "embedding") -> DataFrame:
    best = Window.partitionBy(group).orderBy(F.desc("similarity"), "id")
    return scored(df, query, vector).where(F.col("similarity") > similarity).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Queries that go to the tasks at a time, the bytes that their vectors have at most, and queries that a task scores at a time.
QUERIES, QUERY_BYTES, AT_ONCE = 200_000, 128 << 20, 512
#: Hits whose contents are fetched by a broadcast; more are joined by a shuffle.
HITS = 100_000


def batch_search(rows: DataFrame, queries: DataFrame, k: int, similarity: float = 0.0) -> DataFrame:
    """query_id, id, similarity, rank of the best k rows (id, embedding) for each query (id, embedding).

    The queries are the stated set; up to QUERIES of them, and QUERY_BYTES of their vectors, are broadcast and all rows are
    scored against them in one pass, by matrix products. A task keeps a running best k a query and tells them once, when its rows are through.
    """
    spark = rows.sparkSession
    reachable(spark)
    known = queries.where("embedding IS NOT NULL").select("id", "embedding")
    n, components = known.agg(F.count(F.lit(1)), F.sum(F.size("embedding"))).first()
    passes = max(1, -(-n // QUERIES), -(-8 * (components or 0) // QUERY_BYTES))
    found = spark.createDataFrame([], "query_id long, id long, similarity double")
    for p in range(passes):
        block = known.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).toArrow()
        if not block.num_rows:
            continue
        vectors = block.column("embedding").combine_chunks()
        q = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(block.num_rows, -1)
        length = np.linalg.norm(q, axis=1, keepdims=True)
        unit = np.divide(q, length, out=np.full_like(q, np.nan), where=length > 0)
        shared = spark.sparkContext.broadcast((block.column("id").to_numpy(), unit))
        found = found.unionByName(rows.where("embedding IS NOT NULL").select("id", "embedding").mapInArrow(_best(shared, k, similarity), "query_id long, id long, similarity double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _merged(held: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray, s: np.ndarray, at: int, k: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best k of what is held and of a batch's scores s (queries from `at` on x rows). Rows below a query's k-th best are not sorted."""
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    mine = (held[0] >= at) & (held[0] < at + len(s))
    q, i, v = (x[mine] for x in held)
    full = np.bincount(q - at, minlength=len(s)) >= k
    bound = np.full(len(s), np.inf)
    np.minimum.at(bound, q - at, v)
    least = np.maximum(least, np.where(full, bound, -np.inf))
    row, col = np.nonzero((s >= least[:, None]) & (s > similarity))
    q, i, v = np.concatenate([q, row + at]), np.concatenate([i, own[col]]), np.concatenate([v, s[row, col]])
    order = np.lexsort((i, -v, q))
    q, i, v = q[order], i[order], v[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], i[rank < k], v[rank < k]


def _best(shared, k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        parts = list(range(0, len(ids), AT_ONCE))
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in parts]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("id").to_numpy()
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            length = np.linalg.norm(x, axis=1)
            for n, at in enumerate(parts):
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.round(unit[at : at + AT_ONCE] @ x.T / length, 6)
                held[n] = _merged(held[n], own, np.where(np.isnan(s), -np.inf, s), at, k, similarity)
        for q, i, v in held:
            yield pa.RecordBatch.from_pydict({"query_id": ids[q], "id": i, "similarity": v})

    return run
