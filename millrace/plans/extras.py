"""Connectors, sinks, logs, shapes and re-embedding."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema as sc
from millrace.functions import shape
from millrace.operators import cache as ca
from millrace.operators import dml
from millrace.plans.ctes import with_tables
from millrace.plans.registry import register
from millrace.plans.text import _VECTOR
from millrace.session import scratch
from millrace.sources import knowledge as kb
from millrace.sources import readers, search
from millrace.sources.readers import table


@register("SELECT doc_id AS id, CAST(NULL AS VARCHAR) AS content, lang AS title, CAST(substr(source, 4) AS BIGINT) AS dataset_id, source AS dataset_name, doc_id AS document_id, CAST(NULL AS VARCHAR) AS document_name, CAST(NULL AS BIGINT) AS paragraph_id, CAST(NULL AS INT) AS hit_num, CAST(NULL AS VARCHAR) AS status FROM documents")
def rows_to_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the shape of a search hit; fields that they lack are null."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.expr(kb.DATASET).alias("dataset_id"), F.col("source").alias("dataset_name"), F.col("doc_id").alias("document_id"))
    return shape.conform(docs, sc.HIT)


@register("SELECT item_id, true AS packed, lower(text) AS body FROM benchmark")
def gunzip_body(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that came gzipped, unpacked and then worked on."""
    b = table(spark, d, "benchmark").select("item_id", shape.gzipped("text").alias("z"))
    return b.select("item_id", (F.hex(F.substring("z", 1, 2)) == "1F8B").alias("packed"), F.lower(shape.gunzip("z")).alias("body"))


@register("SELECT event_id, event_type AS method, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 200 END AS response_status FROM events")
def forward_log_merge(spark: SparkSession, d: str) -> DataFrame:
    """Requests are logged first and their responses later; the latest row of each wins."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("method"), F.lit(None).cast("int").alias("response_status"), F.lit(0).alias("version"))
    answered = e.where("event_id % 3 <> 0").withColumn("response_status", F.lit(200)).withColumn("version", F.lit(1))
    return dml.upsert(e, answered, ["event_id"], "version").drop("version")


@register("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 2 WHERE n_name IS NOT NULL")
def null_rejecting_join(spark: SparkSession, d: str) -> DataFrame:
    """A left join whose right side may not be null: Catalyst makes it an inner join."""
    n = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").where("n_name IS NOT NULL").select("c_custkey", "n_name")


@register("SELECT c_custkey AS id, c_name AS name FROM customer")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """All rows written as CSV with a header and read again."""
    out = scratch(spark, "export")
    dml.export_csv(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), out)
    return spark.read.schema("id long, name string").option("header", True).csv(out)


@register("SELECT replace(text, chr(10), ' ') AS value FROM benchmark")
def text_file_sink(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "markdown")
    table(spark, d, "benchmark").select(F.translate("text", "\n", " ").alias("value")).write.text(out)
    return spark.read.text(out)


@register(with_tables(f"SELECT document_id, md5(content) AS md5, embedding IS NULL AS was_missing, {_VECTOR.format(m='md5(content)')} AS vector FROM p", "p"))
def reembed_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph's vector computed anew, written, and read back beside whether it had one."""
    p = kb.paragraphs(spark, d).select("document_id", F.md5("content").alias("md5"), F.col("embedding").isNull().alias("was_missing"), ca.hashing_vector(F.col("content")).alias("embedding"))
    out = scratch(spark, "embeddings")
    dml.insert(p, out)
    return spark.read.schema(p.schema).parquet(out).select("document_id", "md5", "was_missing", F.col("embedding").cast("array<double>").alias("vector"))


@register("SELECT unnest(['gpt-small', 'gpt-large']) AS name, 'EMBEDDING' AS model_type")
def provider_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A multi-line JSON catalogue {code, data: [...]} as rows."""
    out = scratch(spark, "catalogue")
    text = json.dumps({"code": 200, "data": [{"name": n, "model_type": "EMBEDDING"} for n in ("gpt-small", "gpt-large")]}, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(out)
    return readers.json_catalogue(spark, out, "name: string, model_type: string")


@register("SELECT unnest(['Spark joins', 'Spark sorts']) AS title, unnest(['http://a', 'http://c']) AS url")
def search_connector(spark: SparkSession, d: str) -> DataFrame:
    """The meta-search source over results given as JSON."""
    search.register(spark)
    results = [{"title": "Spark joins", "url": "http://a"}, {"title": "Cooking", "url": "http://b"}, {"title": "Spark sorts", "url": "http://c"}]
    return spark.read.format("millrace_search").options(query="spark", limit="5", results=json.dumps(results)).load().select("title", "url")


_PROBLEMS = "SELECT item_id, unnest(range(0, len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS content FROM benchmark"
_NATURAL = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


@register(f"SELECT {_NATURAL.format("item_id || ':' || k")} AS problem_id, {_NATURAL.format("item_id || ':' || k || ':mapping'")} AS mapping_id, content, 0 AS hit_num, item_id AS paragraph_id FROM ({_PROBLEMS})")
def problem_insert(spark: SparkSession, d: str) -> DataFrame:
    """A request's list of problems written as problem rows and mapping rows, two tables, and read back joined. Ids come from natural keys."""
    lines = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("k", "content")).withColumn("id", dml.natural_id(F.col("item_id"), F.col("k")))
    problems, mappings = scratch(spark, "problems"), scratch(spark, "problem-mappings")
    dml.insert(lines.select("id", "content", F.lit(0).alias("hit_num")), problems, batch=dml.BATCH)
    dml.insert(lines.select(dml.natural_id(F.col("item_id"), F.col("k"), F.lit("mapping")).alias("id"), F.col("id").alias("problem_id"), F.col("item_id").alias("paragraph_id")), mappings, batch=dml.BATCH)
    p = spark.read.schema("id long, content string, hit_num int").parquet(problems).withColumnRenamed("id", "problem_id")
    m = spark.read.schema("id long, problem_id long, paragraph_id long").parquet(mappings).withColumnRenamed("id", "mapping_id")
    return p.join(m, "problem_id").select("problem_id", "mapping_id", "content", "hit_num", "paragraph_id")


@register(
    f"""SELECT p_partkey, CASE WHEN p_size % 10 = 9 THEN 'regional' ELSE 'default' END AS provider, CASE WHEN p_size % 10 = 9 THEN 'text-embedding-v4' WHEN p_size % 3 = 0 OR p_size % 3 = 1 THEN '{sc.DEFAULT_EMBEDDING_MODEL}' ELSE lower(p_brand) END AS model FROM part"""
)
def model_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A missing or "default" model name stands for the real one, and an area may have a provider of its own, before any cache is asked."""
    name = F.expr("CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'default' ELSE lower(p_brand) END")
    asked = ca.provider(F.expr("CASE WHEN p_size % 10 = 9 THEN 86 ELSE 1 END"), name, sc.DEFAULT_EMBEDDING_MODEL, {86: ("regional", "text-embedding-v4")})
    return table(spark, d, "part").select("p_partkey", asked.alias("m")).select("p_partkey", "m.provider", "m.model")


_NAMES = ca.LookupCache(live=60, idle=60)


@register("SELECT c_custkey, n_name AS username FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def cached_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names looked up through a cache that keeps the small table for a minute."""
    names = _NAMES.get((spark.sparkContext.applicationId, d), lambda _: table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("username")).cache())
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(names, "c_nationkey", "left").select("c_custkey", "username")


@register("SELECT doc_id, replace(text, 'a', '') AS clean, trim(text) = '' AS blank, starts_with(text, 'The') AS starts FROM documents")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    """NUL characters removed (here in the place of each a), blank and prefix tests."""
    from millrace.functions.text import without_nul

    docs = table(spark, d, "documents")
    return docs.select("doc_id", without_nul(F.translate("text", "a", "\0")).alias("clean"), (F.trim("text") == "").alias("blank"), F.col("text").startswith("The").alias("starts"))


@register("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY)")
def recent_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an event in an interval before the latest one: a semi join against a time range."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = o.crossJoin(F.broadcast(last)).where("o_orderdate >= last - INTERVAL 90 DAY").select(F.col("o_custkey").alias("c_custkey"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(recent, "c_custkey", "left_semi").join(n, "c_nationkey").select("c_custkey", "n_name")
