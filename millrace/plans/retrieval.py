"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vector import parse, unparse
from millrace.operators import retrieval as r
from millrace.plans.ctes import cosine, with_tables
from millrace.plans.registry import register
from millrace.sources import knowledge as kb
from millrace.sources.readers import table

#: The cached query vector, and a query given as text.
QUERY = 7
LITERAL = "[" + ",".join(str(((i * 37) % 21 - 10) / 10) for i in range(64)) + "]"


def _query(spark: SparkSession, d: str) -> DataFrame:
    return kb.cache(spark, d).where(F.col("id") == QUERY)


def _star(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return kb.paragraphs(spark, d), kb.documents(spark, d), kb.datasets(spark, d)


def _paragraph_sql(where: str, t: float, k: int, vector: str = "p.embedding", tables: str = "p", query: str = f"(SELECT v FROM c WHERE id = {QUERY})") -> str:
    return with_tables(
        f"""SELECT *, similarity AS comprehensive_score FROM (SELECT p.id, p.document_id, d.name AS document_name, p.dataset_id, ds.name AS dataset_name, p.title, p.status, p.is_active, p.content, p.hit_num, p.create_time, p.update_time, {cosine(vector, query)} AS similarity
        FROM {tables} JOIN dd d ON d.id = p.document_id JOIN ds ON ds.id = p.dataset_id WHERE p.is_active AND p.deleted = 0 AND ds.deleted = 0 AND {where}) WHERE similarity > {t} ORDER BY similarity DESC, id LIMIT {k}""",
        "p", "dd", "ds", "c", "app",
    )


@register(_paragraph_sql("p.dataset_id = 3", 0.0, 10))
def knn_paragraph_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    return r.paragraph_search(*_star(spark, d), _query(spark, d), [3])


@register(_paragraph_sql("p.dataset_id IN (1, 3, 5, 8)", 0.1, 20))
def knn_paragraph_by_dataset_list(spark: SparkSession, d: str) -> DataFrame:
    return r.paragraph_search(*_star(spark, d), _query(spark, d), [1, 3, 5, 8], 0.1, 20)


@register(_paragraph_sql("p.dataset_id IN (0, 2)", 0.05, 10, query=f"CAST('{LITERAL}' AS FLOAT[])"))
def knn_literal_vector(spark: SparkSession, d: str) -> DataFrame:
    q = spark.range(1).select(parse(F.lit(LITERAL)).alias("v"))
    return r.paragraph_search(*_star(spark, d), q, [0, 2], 0.05, 10)


@register(_paragraph_sql("p.dataset_id IN (SELECT dataset_id FROM app WHERE application_id = 2)", 0.0, 15))
def knn_application_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = kb.applications(spark, d).where("application_id = 2")
    return r.paragraph_search(*_star(spark, d), _query(spark, d), None, 0.0, 15, scope)


@register(
    with_tables(
        f"""SELECT *, similarity AS comprehensive_score FROM (SELECT p.id, p.document_id, d.name AS document_name, p.dataset_id, ds.name AS dataset_name, p.title, p.status, p.is_active, p.content, p.hit_num, p.create_time, p.update_time,
        {cosine("t.embedding", f"(SELECT v FROM c WHERE id = {QUERY})")} AS similarity
        FROM p LEFT JOIN embeddings t ON t.vec_id = (p.id + 1) % (SELECT count(*) FROM embeddings) LEFT JOIN dd d ON d.id = p.document_id LEFT JOIN ds ON ds.id = p.dataset_id
        WHERE p.is_active AND p.deleted = 0 AND ds.deleted = 0 AND p.dataset_id IN (2, 4, 6)) WHERE similarity > 0.05 ORDER BY similarity DESC, id LIMIT 10""",
        "p", "dd", "ds", "c",
    )
)
def knn_title(spark: SparkSession, d: str) -> DataFrame:
    return r.title_search(kb.titled(spark, d), kb.documents(spark, d), kb.datasets(spark, d), _query(spark, d), [2, 4, 6], 0.05, 10)


def _sentence_sql(where: str, t: float, k: int) -> str:
    return with_tables(
        f"""SELECT *, similarity AS comprehensive_score FROM (SELECT DISTINCT s.id, s.content, s.hit_num, s.document_id, d.name AS document_name, s.dataset_id, ds.name AS dataset_name, CASE WHEN s.type = 1 THEN p.title ELSE '' END AS title,
        CASE WHEN s.type = 1 THEN p.status ELSE '1' END AS status, CASE WHEN s.type = 1 THEN p.is_active ELSE d.is_active END AS is_active, {cosine("s.embedding", f"(SELECT v FROM c WHERE id = {QUERY})")} AS similarity
        FROM ss s JOIN ds ON ds.id = s.dataset_id JOIN dd d ON d.id = s.document_id LEFT JOIN p ON s.type = 1 AND s.paragraph_id = p.id
        WHERE s.deleted = 0 AND ds.deleted = 0 AND ((s.type = 1 AND p.is_active) OR (s.type = 2 AND d.is_active)) AND {where}) WHERE similarity > {t} ORDER BY similarity DESC, id LIMIT {k}""",
        "ss", "p", "dd", "ds", "c", "app",
    )


@register(_sentence_sql("s.dataset_id IN (1, 4, 9)", 0.1, 20))
def knn_sentence_conditional(spark: SparkSession, d: str) -> DataFrame:
    return r.sentence_search(kb.sentences(spark, d), *_star(spark, d), _query(spark, d), [1, 4, 9], 0.1, 20)


@register(_sentence_sql("s.dataset_id IN (SELECT dataset_id FROM app WHERE application_id = 5)", 0.2, 10))
def search_mode_application(spark: SparkSession, d: str) -> DataFrame:
    """Application scope: both modes search sentences."""
    scope = kb.applications(spark, d).where("application_id = 5")
    return r.search("blend", "application", None, lambda: r.sentence_search(kb.sentences(spark, d), *_star(spark, d), _query(spark, d), None, 0.2, 10, scope))


@register(_paragraph_sql("p.dataset_id = 1", 0.0, 10))
def search_mode_blend(spark: SparkSession, d: str) -> DataFrame:
    """Dataset scope, blend: paragraphs."""
    return r.search("blend", "dataset", lambda: r.paragraph_search(*_star(spark, d), _query(spark, d), [1]), None)


@register(with_tables(f"SELECT * FROM (SELECT vec_id, label, {cosine('embedding', f'(SELECT v FROM c WHERE id = {QUERY})')} AS similarity FROM embeddings) WHERE similarity > 0.1 ORDER BY similarity DESC, vec_id LIMIT 25", "c"))
def knn_generic_table(spark: SparkSession, d: str) -> DataFrame:
    return r.knn(table(spark, d, "embeddings"), _query(spark, d), ["vec_id", "label"], 0.1, 25, key="vec_id")


@register(
    with_tables(
        f"""SELECT id, dataset_id, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY similarity DESC, id) AS INT) AS rank FROM
        (SELECT id, dataset_id, {cosine("embedding", f"(SELECT v FROM c WHERE id = {QUERY})")} AS similarity FROM p WHERE is_active AND deleted = 0) WHERE similarity > 0) WHERE rank <= 3""",
        "p", "c",
    )
)
def knn_top_per_dataset(spark: SparkSession, d: str) -> DataFrame:
    p = kb.paragraphs(spark, d).where("is_active AND deleted = 0").select("id", "dataset_id", "embedding")
    return r.top_per_group(p, _query(spark, d), "dataset_id", 3).select("id", "dataset_id", "similarity", "rank")


@register(
    f"""WITH c AS (SELECT vec_id AS id, embedding AS v FROM embeddings), x AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN list_transform(embedding, lambda y: CAST(0 AS FLOAT)) ELSE embedding END AS embedding FROM embeddings)
    SELECT * FROM (SELECT id, {cosine("embedding", f"(SELECT v FROM c WHERE id = {QUERY})")} AS similarity FROM x) WHERE similarity > -1 ORDER BY similarity DESC, id LIMIT 30"""
)
def knn_null_and_zero_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a vector and zero vectors never match."""
    v = F.expr("CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN transform(embedding, y -> cast(0 AS float)) ELSE embedding END")
    return r.knn(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("embedding")), _query(spark, d), ["id"], -1.0, 30)


@register(
    f"""SELECT query_id, id, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM
    (SELECT q.vec_id AS query_id, e.vec_id AS id, {cosine("e.embedding", "q.embedding")} AS similarity FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0) WHERE similarity > 0) WHERE rank <= 5"""
)
def batch_retrieve_many_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the vectors whose id is divisible by 100, against all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return r.batch_search(v, v.where("id % 100 = 0"), 5)


@register(
    f"""WITH c AS (SELECT vec_id AS id, embedding AS v FROM embeddings) SELECT vec_id AS id, {cosine("embedding", f"(SELECT v FROM c WHERE id = {QUERY})")} AS similarity FROM embeddings"""
)
def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    return r.scored(table(spark, d, "embeddings"), _query(spark, d)).select(F.col("vec_id").alias("id"), "similarity")


@register("SELECT vec_id, embedding, true AS same FROM embeddings")
def vector_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text and parsed again."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("given"), parse(unparse("embedding")).alias("embedding"))
    return v.select("vec_id", "embedding", (F.col("given") == F.col("embedding")).alias("same"))


@register(
    with_tables(
        """SELECT k AS rank, title, url FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC, page_id) AS INT) AS k, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url, page_id FROM
        (SELECT *, length(html) AS n FROM pages)) WHERE k <= 10""",
        "c",
    )
)
def search_rank_select(spark: SparkSession, d: str) -> DataFrame:
    """A ranker's `title~~url` lines, parsed: a stand-in ranks pages by length and names the first ten."""
    from millrace.functions.text import html_title, tagged

    pages = table(spark, d, "pages").select("page_id", "url", html_title(F.col("html")).alias("title"), F.length("html").alias("n"))
    best = pages.orderBy(F.desc("n"), "page_id").limit(10).withColumn("line", F.concat_ws("~~", "title", "url"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "page_id", "line"))), lambda x: x["line"]), "\n")
    answer = best.agg(F.concat(F.lit("<output>"), lines, F.lit("</output>")).alias("answer"))
    parsed = answer.select(F.posexplode(F.split(tagged(F.col("answer"), "output")[0], "\n")).alias("k", "line"))
    return parsed.select((F.col("k") + 1).alias("rank"), F.split("line", "~~")[0].alias("title"), F.split("line", "~~")[1].alias("url"))
