"""Scans, filters, joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import mask_secret
from millrace.operators import dml, stats
from millrace.operators import predicates as pr
from millrace.plans.ctes import with_tables
from millrace.plans.registry import register
from millrace.schema import DEFAULT_EMBEDDING_MODEL
from millrace.sources import knowledge as kb
from millrace.sources.readers import file_url, new_uploads, suffix, table


@register("SELECT doc_id, lang AS title, n_chars AS char_length FROM documents")
def scan_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), F.col("n_chars").alias("char_length"))


@register("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr' AND source = 'src3'")
def filter_by_example(spark: SparkSession, d: str) -> DataFrame:
    return pr.by_example(table(spark, d, "documents"), {"lang": "fr", "source": "src3"}, ["doc_id", "source", "n_chars"])


@register("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 1")
def first_by_example(spark: SparkSession, d: str) -> DataFrame:
    return pr.first_by_example(table(spark, d, "documents"), {"lang": "de"}, "doc_id", ["doc_id", "lang", "source"])


@register("SELECT doc_id, text FROM documents WHERE doc_id = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return pr.by_example(table(spark, d, "documents"), {"doc_id": 42}, ["doc_id", "text"])


@register("SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000042' LIMIT 1")
def secondary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """An id by the equality of a secondary key."""
    return table(spark, d, "customer").where("c_name = 'Customer#000000042'").select(F.col("c_custkey").alias("id")).limit(1)


@register("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS applicaiton_type FROM customer WHERE c_custkey = 5")
def lookup_alias_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey = 5").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("applicaiton_type"))


@register("SELECT count(*) AS n, max(n_chars) AS longest FROM documents WHERE lang = 'en'")
def scalar_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@register(with_tables("SELECT id, dataset_id FROM dd WHERE dataset_id IN (SELECT dataset_id FROM app WHERE application_id = 1)", "dd", "app"))
def dataset_ids_semi_join(spark: SparkSession, d: str) -> DataFrame:
    scope = kb.applications(spark, d).where("application_id = 1").select("dataset_id")
    return kb.documents(spark, d).select("id", "dataset_id").join(scope, "dataset_id", "left_semi").select("id", "dataset_id")


@register("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled FROM documents d")
def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    return stats.existence(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], "labelled")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def cache_miss_anti(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(v, "doc_id", "left_anti")


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("SELECT conv_id, turn, role FROM conversations")
def json_nested_explode(spark: SparkSession, d: str) -> DataFrame:
    """A record's nested message list, written as JSON, read by its schema and exploded."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("turn", "role")).alias("message_list"))).alias("details"))
    parsed = t.select("conv_id", F.from_json("details", "message_list array<struct<turn: long, role: string>>").alias("x"))
    return parsed.select("conv_id", F.explode("x.message_list").alias("m")).select("conv_id", "m.turn", "m.role")


@register("SELECT event_id, CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS meta FROM events")
def json_default_meta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("meta"))
    return e.select("event_id", F.coalesce("meta", F.lit("{}")).alias("meta"))


@register("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7%'")
def name_contains(spark: SparkSession, d: str) -> DataFrame:
    return pr.name_contains(table(spark, d, "customer").select("c_custkey", "c_name"), "7", "c_name")


@register("SELECT c_custkey, c_name FROM customer")
def optional_filter_off(spark: SparkSession, d: str) -> DataFrame:
    return pr.name_contains(table(spark, d, "customer").select("c_custkey", "c_name"), None, "c_name")


@register("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def rls_owner(spark: SparkSession, d: str) -> DataFrame:
    return pr.owned_by(table(spark, d, "customer").select("c_custkey", "c_nationkey"), 7, "c_nationkey")


@register("SELECT c_nationkey = 1 AS own, count(*) AS n FROM customer GROUP BY ALL")
def rls_superuser(spark: SparkSession, d: str) -> DataFrame:
    """The superuser sees their own rows and all others."""
    seen = pr.owned_by(table(spark, d, "customer").select("c_custkey", "c_nationkey"), 1, "c_nationkey")
    return seen.groupBy((F.col("c_nationkey") == 1).alias("own")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT c_custkey, c_name, n_name AS username FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_join_username(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("username"))
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(n, "c_nationkey", "left").drop("c_nationkey")


@register(with_tables(f"SELECT ds.id, coalesce(n_name, '{DEFAULT_EMBEDDING_MODEL}') AS model_name FROM ds LEFT JOIN nation ON n_nationkey = ds.id * 2", "ds"))
def lookup_default_model(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "nation").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("model_name"))
    ds = kb.datasets(spark, d).withColumn("model_id", F.col("id") * 2)
    return ds.join(m, "model_id", "left").select("id", F.coalesce("model_name", F.lit(DEFAULT_EMBEDDING_MODEL)).alias("model_name"))


@register("SELECT b.item_id AS problem_id, b.text AS problem, d.doc_id AS paragraph_id FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id")
def problem_paragraph_join(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("problem_id"), F.col("doc_id").alias("paragraph_id"))
    problems = table(spark, d, "benchmark").select(F.col("item_id").alias("problem_id"), F.col("text").alias("problem"))
    return problems.join(mapping, "problem_id").select("problem_id", "problem", "paragraph_id")


@register("SELECT p.i AS paragraph_id, q.i AS problem_id FROM (SELECT unnest([3, 5, 8]) AS i) p CROSS JOIN (SELECT unnest([1, 2]) AS i) q")
def problem_paragraph_cross(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of two lists of a request."""
    one = spark.range(1).select(F.array(F.lit(3), F.lit(5), F.lit(8)).alias("p"), F.array(F.lit(1), F.lit(2)).alias("q"))
    return one.select(F.explode("p").alias("paragraph_id"), "q").select("paragraph_id", F.explode("q").alias("problem_id"))


@register("SELECT o_orderkey AS file_id, coalesce(c_custkey, o_orderkey) AS document_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = 3")
def replace_or_default_document(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(known, o["o_custkey"] == known["c_custkey"], "left").select(F.col("o_orderkey").alias("file_id"), F.coalesce("c_custkey", "o_orderkey").alias("document_id"))


@register("SELECT c_custkey, c_name, total FROM (SELECT *, count(*) OVER () AS total FROM customer) ORDER BY c_custkey LIMIT 20 OFFSET 40")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    return dml.page(table(spark, d, "customer").select("c_custkey", "c_name"), 3, 20, ["c_custkey"])


@register("SELECT p_partkey, p_name, total FROM (SELECT *, (SELECT count(*) FROM part) AS total FROM part) ORDER BY p_name, p_partkey LIMIT 15")
def order_by_name(spark: SparkSession, d: str) -> DataFrame:
    return dml.page(table(spark, d, "part").select("p_partkey", "p_name"), 1, 15, ["p_name", "p_partkey"])


@register("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def distinct_dataset_list(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each dataset, by aggregation: no sort of whole partitions."""
    first = table(spark, d, "documents").groupBy("source").agg(F.min(F.struct("doc_id", "lang")).alias("x"))
    return first.select("source", "x.doc_id", "x.lang")


@register(with_tables("SELECT DISTINCT * FROM (SELECT 'DATASET' AS type, CAST(id AS BIGINT) AS id, ['MANAGE', 'USE'] AS operations FROM ds UNION SELECT 'APPLICATION', CAST(application_id AS BIGINT), ['MANAGE', 'USE'] FROM app UNION SELECT 'DATASET', CAST(dataset_id AS BIGINT), ['USE'] FROM app WHERE application_id IS NOT NULL)", "ds", "app"))
def permission_union(spark: SparkSession, d: str) -> DataFrame:
    both, use = F.array(F.lit("MANAGE"), F.lit("USE")).alias("operations"), F.array(F.lit("USE")).alias("operations")
    app = kb.applications(spark, d)
    own = kb.datasets(spark, d).select(F.lit("DATASET").alias("type"), F.col("id").cast("long").alias("id"), both)
    apps = app.select(F.lit("APPLICATION").alias("type"), F.col("application_id").cast("long").alias("id"), both)
    shared = app.where(F.col("application_id").isNotNull()).select(F.lit("DATASET").alias("type"), F.col("dataset_id").cast("long").alias("id"), use)
    return own.union(apps).union(shared).distinct()


@register(with_tables("SELECT t.type || ':' || o.operation || ':' || t.id AS permission FROM (SELECT 'DATASET' AS type, id FROM ds UNION ALL SELECT DISTINCT 'APPLICATION', application_id FROM app) t JOIN (SELECT 'DATASET' AS type, unnest(['MANAGE', 'USE', 'DELETE']) AS operation UNION ALL SELECT 'APPLICATION', unnest(['MANAGE', 'USE'])) o ON o.type = t.type", "ds", "app"))
def permission_strings(spark: SparkSession, d: str) -> DataFrame:
    ops = spark.createDataFrame([("DATASET", x) for x in ("MANAGE", "USE", "DELETE")] + [("APPLICATION", x) for x in ("MANAGE", "USE")], "type string, operation string")
    own = kb.datasets(spark, d).select(F.lit("DATASET").alias("type"), "id")
    apps = kb.applications(spark, d).select(F.lit("APPLICATION").alias("type"), F.col("application_id").alias("id")).distinct()
    return stats.permission_strings(ops, own.union(apps))


@register("SELECT md5(text) AS md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def md5_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.md5("text").alias("md5"), "doc_id").groupBy("md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@register("SELECT doc_id AS id, source AS bucket_name, md5(text) AS md5, 'http://localhost/' || source || '/' || md5(text) || '.txt' AS url FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 2 = 0 AND k.source = d.source AND k.text = d.text) AND doc_id = (SELECT min(doc_id) FROM documents m WHERE m.doc_id % 2 = 1 AND m.source = d.source AND m.text = d.text)")
def upload_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Files that their bucket does not have yet: documents with odd ids come in, those with even ids are stored."""
    f = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("bucket_name"), F.md5("text").alias("md5"))
    fresh = new_uploads(f.where("id % 2 = 1"), f.where("id % 2 = 0"))
    return fresh.withColumn("url", file_url("http://localhost", F.col("bucket_name"), F.concat("md5", F.lit(".txt"))))


@register("SELECT page_id, regexp_extract(url, '\\.([^.]+)$', 1) AS suffix FROM pages")
def file_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", suffix(F.col("url")).alias("suffix"))


@register("SELECT c_custkey, substr(c_name, 1, 4) || repeat('*', greatest(length(c_name) - 4, 0)) AS credential FROM customer")
def credential_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", mask_secret(F.col("c_name")).alias("credential"))


@register("SELECT o_orderkey, CAST(ceil(o_totalprice / 2200.0) AS BIGINT) AS tiles, least(o_totalprice, 2200.0) AS first_height FROM orders")
def image_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 2200 of a height."""
    return table(spark, d, "orders").select("o_orderkey", F.ceil(F.col("o_totalprice") / 2200.0).alias("tiles"), F.least("o_totalprice", F.lit(2200.0)).alias("first_height"))
