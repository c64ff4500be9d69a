"""The knowledge base's tables, derived from documents, labels, embeddings and the other given tables.

dataset = documents.source; a paragraph is a document with its vector, if it has one; labels give the active and
deleted flags; sentence 2n is document n's split sentence (type 1), 2n+1 its summary (type 2). Titles and sentences
borrow their vectors from the whole table of vectors, in turn; hit counts and times come from the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import summary
from millrace.sources.readers import table

DATASET = "cast(substr(source, 4) AS int)"
#: Times that the given tables lack: days after a first one, from the id.
CREATED, UPDATED = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(cast(id % 365 AS int))", "TIMESTAMP_NTZ'2025-01-01 00:00:00' + make_dt_interval(cast(id % 28 AS int))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flags = lab.select("doc_id", "quality", "toxic")
    return d.join(flags, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("name"), "text", "n_chars", F.expr(DATASET).alias("dataset_id"), F.expr("coalesce(quality, 1) = 1").alias("is_active"), F.expr("coalesce(toxic, 0)").alias("deleted")
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select(F.expr(DATASET).alias("id"), F.col("source").alias("name"), F.lit(0).alias("deleted"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    d = documents(spark, sf_dir)
    return d.join(v, "id", "left").select(
        "id", F.col("id").alias("document_id"), F.col("name").alias("title"), F.col("text").alias("content"), "dataset_id", "is_active", "deleted", "embedding", F.lit("1").alias("status"),
        F.expr("cast(id % 7 AS int)").alias("hit_num"), F.expr(CREATED).alias("create_time"), F.expr(UPDATED).alias("update_time"),
    )


def _vectors(spark: SparkSession, sf_dir: str, number: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(the vectors by number, their count as a row to broadcast): row x borrows vector x modulo the count."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(number), F.col("embedding").alias(name))
    return v, F.broadcast(v.agg(F.count(F.lit(1)).alias("_vectors")))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with a title_embedding."""
    v, n = _vectors(spark, sf_dir, "title_vector", "title_embedding")
    return paragraphs(spark, sf_dir).crossJoin(n).withColumn("title_vector", F.expr("(id + 1) % _vectors")).join(v, "title_vector", "left").drop("title_vector", "_vectors")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(DATASET).alias("dataset_id"))
    v, n = _vectors(spark, sf_dir, "vector_id", "embedding")
    two = d.select("doc_id", "dataset_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).crossJoin(n)
    content = F.when(F.col("k") == 0, F.col("text")).otherwise(summary(F.col("text")))
    s = two.select(
        F.expr("doc_id * 2 + k").alias("id"), F.expr("k + 1").alias("type"), F.col("doc_id").alias("document_id"), "dataset_id", F.col("doc_id").alias("paragraph_id"), content.alias("content"),
        F.expr("cast(doc_id % 5 AS int)").alias("hit_num"), F.expr("(31 * doc_id + k) % _vectors").alias("vector_id"), F.lit(0).alias("deleted"),
    )
    return s.join(v, "vector_id", "left").drop("vector_id")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """application_id, dataset_id: the labels of the vectors that a dataset's documents have."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("application_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(DATASET).alias("dataset_id"))
    return d.join(v, "doc_id").select("application_id", "dataset_id").distinct()
