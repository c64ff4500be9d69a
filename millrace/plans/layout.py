"""Queries over tables that are laid out for them: vector blocks, lookups, pages by position, ids, bitmaps, variants, the streamed cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import semi
from millrace.operators import cache as ca
from millrace.operators import layout, ranking, stats, together, vector_blocks
from millrace.operators import retrieval as r
from millrace.plans.ctes import cosine, with_tables
from millrace.plans.registry import register
from millrace.plans.retrieval import QUERY, _paragraph_sql, _query
from millrace.session import scratch
from millrace.sources import knowledge as kb
from millrace.sources.readers import table
from millrace.streaming import embeddings, feed

# --- exact top-k that skips blocks ----------------------------------------------------------------------


@register(with_tables(f"SELECT * FROM (SELECT vec_id, label, {cosine('embedding', f'(SELECT v FROM c WHERE id = {QUERY})')} AS similarity FROM embeddings) WHERE similarity > 0.1 ORDER BY similarity DESC, vec_id LIMIT 25", "c"))
def knn_blocks_generic(spark: SparkSession, d: str) -> DataFrame:
    """The best rows of a table of vectors in blocks, of which those that can't hold one aren't read."""
    path = scratch(spark, "vector-blocks")
    vector_blocks.build(table(spark, d, "embeddings"), path)
    return vector_blocks.search(spark, path, _query(spark, d), ["vec_id", "label"], 0.1, 25, key="vec_id")


@register(_paragraph_sql("p.dataset_id IN (1, 3, 5, 8)", 0.1, 20))
def knn_blocks_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of some datasets by blocks: flags are stored with the vectors, names are joined before the best are taken, contents are fetched for the hits."""
    path, p = scratch(spark, "paragraph-blocks"), kb.paragraphs(spark, d)
    vector_blocks.build(p.select("id", "document_id", "dataset_id", "title", "status", "is_active", "deleted", "embedding"), path)
    visible = F.col("is_active") & (F.col("deleted") == 0) & F.col("dataset_id").isin([1, 3, 5, 8])
    documents, datasets = kb.documents(spark, d), kb.datasets(spark, d)
    hits = vector_blocks.search(spark, path, _query(spark, d), [c for c in r.HIT_COLUMNS if c != "similarity"], 0.1, 20, where=visible, refine=lambda m: r.named(m, documents, datasets))
    return r.detailed(hits, p, r.PARAGRAPH_DETAIL)


# --- lookups ------------------------------------------------------------------------------------------


@register("SELECT sale_id, client_id, status, total FROM sales WHERE sale_id = 4242")
def lookup_sorted_key(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sales-sorted")
    layout.write_sorted(table(spark, d, "sales"), path, "sale_id")
    return layout.lookup(spark, path, "sale_id", 4242, ["sale_id", "client_id", "status", "total"])


@register("SELECT client_id, email, segment FROM clients WHERE email IN (SELECT email FROM clients WHERE client_id = 77)")
def lookup_secondary_key(spark: SparkSession, d: str) -> DataFrame:
    """Clients by an e-mail address, which isn't the key: files are sorted by the key, and bloom filters tell which may hold it."""
    path, clients = scratch(spark, "clients-sorted"), table(spark, d, "clients")
    layout.write_sorted(clients, path, "client_id", {"email": 1_000_000})
    asked = layout.lookup(spark, path, "client_id", 77, ["email"]).first()
    return layout.lookup(spark, path, "email", asked.email if asked else None, ["client_id", "email", "segment"])


# --- pages by position --------------------------------------------------------------------------------

_ORDER = [("priority", True), ("sold_at", False), ("sale_id", False)]


@register("SELECT sale_id, priority, sold_at, total FROM sales ORDER BY priority DESC NULLS LAST, sold_at NULLS LAST, sale_id NULLS LAST LIMIT 40 OFFSET 200")
def page_by_position(spark: SparkSession, d: str) -> DataFrame:
    """The sixth page of sales by priority: each page begins after the last row of the one before."""
    path = scratch(spark, "sales-by-priority")
    layout.write_sorted(table(spark, d, "sales").select("sale_id", "priority", "sold_at", "total"), path, "priority")
    sales, last = spark.read.parquet(path), None
    for _ in range(5):
        last = layout.next_position(layout.page_after(sales, _ORDER, 40, last), _ORDER)
    return layout.page_after(sales, _ORDER, 40, last)


@register("SELECT client_id, name, balance FROM clients ORDER BY balance DESC NULLS LAST, client_id OFFSET (SELECT greatest(0, count(*) - 30) FROM clients)")
def page_at_the_end(spark: SparkSession, d: str) -> DataFrame:
    """The last thirty clients by balance, nulls and ties included: the first page of the opposite order, turned round."""
    clients = table(spark, d, "clients").select("client_id", "name", "balance")
    return clients.orderBy(F.asc_nulls_first("balance"), F.desc("client_id")).limit(30)


# --- ids ------------------------------------------------------------------------------------------------


@register("SELECT count(*) AS n, count(*) AS different, 0 AS first, count(*) - 1 AS last, CAST(sum(amount) AS BIGINT) // 1000 AS amount FROM (SELECT amount FROM sale_lines UNION ALL SELECT amount FROM sale_lines WHERE flag = 'kept')")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lines, which have no key, get ids without gaps; a second batch goes on where the first ended."""
    path, lines = scratch(spark, "numbered-lines"), table(spark, d, "sale_lines").select("sale_id", "item_id", "amount", "flag")
    layout.append_with_ids(lines, path)
    layout.append_with_ids(lines.where("flag = 'kept'"), path)
    x = layout.with_ids(spark, path)
    return x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("different"), F.min("id").alias("first"), F.max("id").alias("last"), F.expr("CAST(sum(amount) AS BIGINT) div 1000").alias("amount"))


# --- distinct counts that add up ------------------------------------------------------------------------


@register(
    """WITH c AS (SELECT CAST(ts AS DATE) AS day, client_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
    SELECT 'day' AS unit, day AS period, count(DISTINCT client_id) AS users FROM c GROUP BY 2 UNION ALL SELECT 'week', CAST(date_trunc('week', day) AS DATE), count(DISTINCT client_id) FROM c GROUP BY 2 UNION ALL SELECT 'month', CAST(date_trunc('month', day) AS DATE), count(DISTINCT client_id) FROM c GROUP BY 2"""
)
def distinct_users_by_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Distinct clients by day, week and month of two increments (clicks by the half of the year's spring in which they arrived), from the days' bitmaps alone."""
    clicks = table(spark, d, "clicks").where("ts IS NOT NULL").select("ts", "client_id", F.coalesce(F.col("arrived_at") < F.lit("2024-03-01").cast("timestamp_ntz"), F.lit(False)).alias("early"))
    path = scratch(spark, "user-bitmaps")
    for k, own in enumerate((F.col("early"), ~F.col("early"))):
        stats.day_bitmaps(clicks.where(own), F.to_date("ts"), "client_id").write.parquet(f"{path}/increment={k}")
    bits = stats.merged_bitmaps(spark.read.parquet(path).drop("increment"))
    out = None
    for unit, period in (("day", F.col("day")), ("week", F.trunc("day", "week")), ("month", F.trunc("day", "month"))):
        own = stats.distinct_users(bits, period).select(F.lit(unit).alias("unit"), "period", "users")
        out = own if out is None else out.unionByName(own)
    return out


# --- semi-structured columns ----------------------------------------------------------------------------

_DOC = "CASE WHEN json_valid(props) THEN CAST(props AS JSON) END"


@register(
    f"""SELECT click_id, TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) AS k, json_extract_string(p, '$.device.os') AS os, TRY_CAST(string_split(json_extract_string(p, '$.device.ver'), '.')[1] AS INT) AS major,
    CASE WHEN json_type(p, '$.tags') = 'ARRAY' THEN CAST(json_array_length(p, '$.tags') AS INT) END AS n_tags, props IS NOT NULL AND p IS NULL AS broken FROM (SELECT click_id, props, {_DOC} AS p FROM clicks)"""
)
def variant_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of documents of mixed shapes: numbers that are texts in some, lists that are null in some, and texts that are no documents."""
    c = table(spark, d, "clicks").select("click_id", "props", semi.document("props").alias("p"))
    tags = semi.field("p", "$.tags", "array<variant>")
    return c.select(
        "click_id", semi.field("p", "$.k", "bigint").alias("k"), semi.field("p", "$.device.os", "string").alias("os"), F.split(semi.field("p", "$.device.ver", "string"), r"\.")[0].try_cast("int").alias("major"),
        F.when(tags.isNotNull(), F.size(tags)).alias("n_tags"), semi.broken("props").alias("broken"),
    )


@register(
    f"""SELECT click_id, CAST(i AS INT) AS place, TRY_CAST(json_extract_string(p, '$.items[' || i || '].sku') AS BIGINT) AS sku, TRY_CAST(json_extract_string(p, '$.items[' || i || '].qty') AS INT) AS qty
    FROM (SELECT click_id, p, unnest(range(CAST(json_array_length(p, '$.items') AS BIGINT))) AS i FROM (SELECT click_id, {_DOC} AS p FROM clicks) WHERE json_type(p, '$.items') = 'ARRAY')"""
)
def variant_elements(spark: SparkSession, d: str) -> DataFrame:
    """A row for each item of a document's list."""
    c = table(spark, d, "clicks").select("click_id", semi.document("props").alias("p"))
    e = semi.elements(c, "p", "$.items")
    return e.select("click_id", "place", semi.field("element", "$.sku", "bigint").alias("sku"), semi.field("element", "$.qty", "int").alias("qty"))


@register(
    f"""SELECT json_extract_string(p, '$.device.os') AS os, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(p, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(sum(CASE WHEN json_type(p, '$.items') = 'ARRAY' THEN json_array_length(p, '$.items') END) AS BIGINT) AS items
    FROM (SELECT {_DOC} AS p FROM clicks) WHERE p IS NOT NULL GROUP BY 1"""
)
def variant_merged_schema(spark: SparkSession, d: str) -> DataFrame:
    """Totals by device over the columns of the schema that all documents fit; `k`, whose type differs, stays a variant."""
    c = table(spark, d, "clicks").select(semi.document("props").alias("p")).where("p IS NOT NULL")
    t = semi.typed(c, "p", "x")
    return t.groupBy(F.col("x.device.os").alias("os")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("x.k", "$", "bigint")).alias("k"), F.sum(F.when(F.col("x.items").isNotNull(), F.size("x.items"))).cast("long").alias("items"))


# --- the cache that a stream fills ----------------------------------------------------------------------


def _vectors(texts: list[str]) -> list:
    """A stand-in for an embedder, of a text's md5; it refuses texts with a question mark."""
    import hashlib

    if any("?" in t for t in texts):
        raise ValueError("a question")
    return [[int(x, 16) / 16 - 0.5 for x in hashlib.md5(t.encode()).hexdigest()] for t in texts]


_VECTOR = "list_transform(range(1, 33), lambda k: CAST((instr('0123456789abcdef', md5(t)[k]) - 1) / 16.0 - 0.5 AS DOUBLE))"


@register(
    f"""SELECT md5(t) AS md5, model, CASE WHEN NOT contains(t, '?') THEN {_VECTOR} END AS answer, CASE WHEN contains(t, '?') THEN 'ValueError: a question' END AS error
    FROM (SELECT DISTINCT text AS t, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM conversations WHERE text IS NOT NULL)"""
)
def embedding_cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """Texts of conversations in three steps that share many; each text is computed once for each model, and what fails is told with its cause."""
    path, work = scratch(spark, "streamed-cache"), scratch(spark, "cache-work")
    texts = table(spark, d, "conversations").select("text", F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("model"), F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(0)).cast("int").alias("step"))
    answer = lambda t: ca.model_result(t, _vectors, T.ArrayType(T.DoubleType()), tries=1)
    feed.in_steps(texts, "step", [0, 1, 2], f"{work}/in", lambda s: embeddings.run_cache(s, None, path, work, answer))
    return spark.read.parquet(path).select("md5", "model", "answer", "error")


# --- several tables in one commit -----------------------------------------------------------------------

_LINES = "SELECT item_id, unnest(range(0, len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS content FROM benchmark"


@register(f"SELECT item_id * 1000 + k AS problem_id, content, item_id AS paragraph_id FROM ({_LINES})")
def problems_in_one_commit(spark: SparkSession, d: str) -> DataFrame:
    """Problems and their mappings become visible together; a commit that was lost before its mark is not seen in either table."""
    root = scratch(spark, "problems-together")
    lines = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("k", "content")).withColumn("id", F.col("item_id") * 1000 + F.col("k"))
    problems, mappings = lines.select("id", "content"), lines.select(F.col("id").alias("problem_id"), F.col("item_id").alias("paragraph_id"))
    even = F.col("id") % 2 == 0
    together.write(spark, root, {"problem": problems.where(even), "mapping": mappings.where(F.col("problem_id") % 2 == 0)})
    together.write(spark, root, {"problem": problems}, mark=False)
    together.write(spark, root, {"problem": problems.where(~even), "mapping": mappings.where("problem_id % 2 <> 0")})
    seen = together.snapshot(spark, root)
    p = together.read(spark, root, "problem", "id long, content string", seen).select(F.col("id").alias("problem_id"), "content")
    return p.join(together.read(spark, root, "mapping", "problem_id long, paragraph_id long", seen).drop("commit"), "problem_id")


@register(
    "SELECT sale_id, line_no, item_id, quantity FROM sale_lines WHERE sale_id IS NOT NULL AND sale_id % 10 NOT IN (3, 4) UNION ALL SELECT sale_id, line_no, item_id, 0 FROM sale_lines WHERE sale_id % 10 = 3 AND line_no = 1"
)
def children_replaced_in_one_commit(spark: SparkSession, d: str) -> DataFrame:
    """Lines of sales: some sales get new ones, some have none left; nothing that stays is written again."""
    root = scratch(spark, "lines-together")
    lines = table(spark, d, "sale_lines").where("sale_id IS NOT NULL").select("sale_id", "line_no", "item_id", "quantity")
    together.replace_children(spark, root, lines, lines, "sale_id")
    fresh = lines.where("sale_id % 10 = 3 AND line_no = 1").withColumn("quantity", F.lit(0))
    together.replace_children(spark, root, lines.where("sale_id % 10 IN (3, 4)"), fresh, "sale_id")
    return together.current_children(spark, root, "sale_id", "long", "sale_id long, line_no int, item_id long, quantity int")


# --- ranking --------------------------------------------------------------------------------------------

_QUESTION = "the garden and the river in the morning"
_ASKED = sorted(set(_QUESTION.split()))


def _bm25_sql(texts: str, key: str) -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS f{i}" for i, q in enumerate(_ASKED))
    seen = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(_ASKED)))
    score = " + ".join(f"ln(1 + (texts - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * n / mean))" for i in range(len(_ASKED)))
    return f"""WITH c AS (SELECT *, len(w) AS n, {counts} FROM (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {texts})), t AS (SELECT count(*) AS texts, avg(n) AS mean, {seen} FROM c)
    SELECT {key}, round({score}, 6) AS score FROM c, t WHERE greatest({", ".join(f"f{i}" for i in range(len(_ASKED)))}) > 0"""


@register(f"SELECT source, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM ({_bm25_sql('documents', 'source, doc_id')})) WHERE rank <= 3")
def rank_by_words(spark: SparkSession, d: str) -> DataFrame:
    """The best three documents of each dataset for a question, with their scores."""
    docs = table(spark, d, "documents")
    scored = ranking.bm25(docs.withColumn("at", F.struct("source", "doc_id")), _QUESTION, "at")
    return ranking.best(scored.select("at.source", "at.doc_id", "score"), 3, "doc_id", "source").select("source", "doc_id", "score", "rank")


def _length_model(texts: list[str]) -> list:
    """A stand-in for a ranking model: it prefers short texts, and refuses some."""
    if any("<" in t for t in texts):
        raise ValueError("markup")
    return [1.0 / (1 + len(t)) for t in texts]


@register(
    f"""SELECT doc_id, first_score, score, error, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id) AS INT) AS rank FROM (SELECT doc_id, r.score AS first_score, CASE WHEN NOT contains(text, '<') THEN round(1.0 / (1 + length(text)), 9) END AS score, CASE WHEN contains(text, '<') THEN 'ValueError: markup' END AS error
    FROM (SELECT * FROM ({_bm25_sql('documents', 'doc_id')}) ORDER BY score DESC, doc_id LIMIT 40) r JOIN documents USING (doc_id))"""
)
def rank_by_model(spark: SparkSession, d: str) -> DataFrame:
    """The best forty documents for a question, ranked again by a model: both scores are kept, and what the model refuses comes last with the cause."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    first = ranking.best(ranking.bm25(docs, _QUESTION, "doc_id"), 40, "doc_id").drop("rank")
    asked = ranking.by_model(docs.join(F.broadcast(first), "doc_id"), _length_model).withColumn("score", F.round("score", 9)).drop("text")
    return asked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "doc_id"))).select("doc_id", "first_score", "score", "error", "rank")
