"""Exact deduplication by stateful streaming. DataFrame functions only on this path.

Texts are equal when they are identical after each run of ASCII white space became one space. A stream reads
the content store and keeps, in disk-backed state without expiry, for each digest the stable identifier of the
row that stays, its locator in the content store and the number of rows. Rows that hit a digest of another row
have their full normalised bytes compared with those that the locator names; should two texts share a digest,
those that differ are grouped by their bytes instead.

Store and state may stand: a later batch meets all earlier ones. A locator is the number of its batch and a place in it;
it never changes, and two batches never share one. Bytes are compared in the groups that the new batch has touched, and
in those whose digest was found to stand for several texts.

Null texts count as empty. Of equal texts the smallest doc_id stays; null doc_ids come last; among repeated
doc_ids the smallest locator stays, so one row of each group stays. keep_id is null where all doc_ids of a group
are null. An empty table gives an empty result. Columns of any other name are carried inside one struct, so they
clash with nothing. Texts of any length are digested and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_NUMBERS, exists, shared_dir, small_side, subfolders, written

#: Rows of a group that one task compares with the row that stays.
ROWS_PER_SALT = 2048
#: State on disk. Each partition's store holds little, so it must not reserve megabytes of disk or memory in advance.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table there, or None before the first write."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def add_to_store(docs: DataFrame, store: str, digest: Callable[[Column], Column] = sha256, text: str = "text", key: str = "doc_id") -> int:
    """Writes docs into the content store as its next batch, and returns the batch's number: whole rows, their digest, and their place in the batch.

    A batch whose write did not end is written again in its place.
    """
    spark = docs.sparkSession
    batch = sum(exists(spark, f"{store}/{n}/_SUCCESS") for n in subfolders(spark, store))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows.select(
        "row", F.col(f"row.`{key}`").cast("long").alias("id"), digest(normalised(F.col(f"row.`{text}`"))).alias("digest"), F.monotonically_increasing_id().alias("place"), F.lit(batch).cast("long").alias("batch")
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/n={batch}")
    return batch


def contents(spark: SparkSession, store: str) -> DataFrame:
    """row, id, digest, locator of all batches."""
    return spark.read.parquet(store).select("row", "id", "digest", F.struct("batch", "place").alias("locator"))


def advance(spark: SparkSession, store: str, state: str) -> DataFrame:
    """Lets the stream take in what the store has gained and returns the state: digest, keep_id, keep_locator, n.

    The state stays in `state` (checkpoint and RocksDB files), so that later rows meet all earlier ones.
    """
    schema = "id long, digest string, place long, batch long"
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        seen = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(store)
        best = seen.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "batch", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
        query = best.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    kept = spark.read.format("statestore").load(state)
    first = kept.schema["value"].dataType.names
    return kept.select(F.col("key.digest").alias("digest"), F.col(f"value.`{first[0]}`").alias("first"), F.col(f"value.`{first[1]}`").alias("n")).select(
        "digest", F.col("first.id").alias("keep_id"), F.struct(F.col("first.batch").alias("batch"), F.col("first.place").alias("place")).alias("keep_locator"), "n"
    )


def resolve(docs: DataFrame, digest: Callable[[Column], Column] = sha256, text: str = "text", key: str = "doc_id", store: str | None = None, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(content, labels): content has row, id, digest, locator; labels has locator, id, digest, keep_id, keep_locator, n for each row.

    docs become the next batch of the store, and both results have the rows of all batches. Without a store, one of its own
    is made for docs alone.
    """
    spark = docs.sparkSession
    store, state = store or shared_dir(spark, "dedup-content"), state or shared_dir(spark, "dedup-state")
    batch = add_to_store(docs, store, digest, text, key)
    content = contents(spark, store)
    if not content.limit(1).count():
        empty = content.select("locator", "id", "digest", F.col("id").alias("keep_id"), F.col("locator").alias("keep_locator"), F.lit(1).cast("long").alias("n"))
        return content, empty
    known = written(advance(spark, store, state), "dedup-index")
    labels = written(content.select("locator", "id", "digest").join(known, "digest"), "dedup-labels")

    # Full bytes are compared on hits: only rows of groups move with their texts, large groups in salted parts.
    groups = known.where("n > 1").select("digest", "keep_locator", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts"))
    told = _read(spark, f"{state}-collisions")
    if batch:
        touched = content.where(F.col("locator.batch") == batch).select("digest")
        groups = groups.join((touched if told is None else touched.union(told)).distinct(), "digest", "left_semi")
    groups = small_side(groups)
    texts = content.select("locator", "digest", normalised(F.col(f"row.`{text}`")).alias("bytes")).join(groups, "digest")
    own = texts.where("locator = keep_locator").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("bytes").alias("kept_bytes"))
    hits = texts.where("locator <> keep_locator").select("locator", "digest", "bytes", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int").alias("salt"))
    differ = written(hits.join(own, ["digest", "salt"]).where("bytes <> kept_bytes").select("locator", "digest", "bytes"), "dedup-collisions")
    collisions = differ.count()
    if collisions:  # the digest failed: these rows, and the groups they leave, are told apart by their bytes
        differ.select("digest").distinct().write.mode("append").parquet(f"{state}-collisions")
        apart = differ.select("locator", "bytes")
        of = labels.join(F.broadcast(apart) if collisions <= 10_000 else apart, "locator", "left").withColumn("other", F.coalesce("bytes", F.lit("")))
        again = of.groupBy("digest", F.col("bytes").isNotNull().alias("apart"), "other").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "locator")).alias("first"), F.count(F.lit(1)).alias("m")
        )
        labels = written(
            of.withColumn("apart", F.col("bytes").isNotNull()).join(again, ["digest", "apart", "other"]).select(
                "digest", "locator", "id", F.col("first.id").alias("keep_id"), F.col("first.locator").alias("keep_locator"), F.col("m").alias("n")
            ),
            "dedup-labels",
        )
    return content, labels


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, text: str = "text", key: str = "doc_id", store: str | None = None, state: str | None = None) -> DataFrame:
    """One row for each row of docs, and of the store's earlier batches: doc_id, keep_id, group_size, kept, text_sha256."""
    _, labels = resolve(docs, digest, text, key, store, state)
    return labels.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), (F.col("locator") == F.col("keep_locator")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with docs' own columns."""
    content, labels = resolve(docs, sha256, text, key)
    gone = small_side(labels.where("locator <> keep_locator").select("locator"), BROADCAST_NUMBERS // 2)
    return content.join(gone, "locator", "left_anti").select("row.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
