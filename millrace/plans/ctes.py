"""The knowledge base's tables in SQL, as in sources.knowledge."""

from __future__ import annotations

_DS = "CAST(substr(source, 4) AS INT)"


def summary(text: str) -> str:
    """The stand-in summary: first and last ten words, each once."""
    words = f"regexp_split_to_array({text}, '[ \\n]+')"
    return f"array_to_string(list_concat({words}[1:10], {words}[greatest(11, len({words}) - 9):len({words})]), ' ')"


TABLES = {
    "p": f"""SELECT d.doc_id AS id, d.doc_id AS document_id, d.lang AS title, d.text AS content, {_DS} AS dataset_id, coalesce(l.quality, 1) = 1 AS is_active,
        coalesce(l.toxic, 0) AS deleted, e.embedding, '1' AS status, CAST(d.doc_id % 7 AS INT) AS hit_num, TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 365 AS INT)) AS create_time,
        TIMESTAMP '2025-01-01' + to_days(CAST(d.doc_id % 28 AS INT)) AS update_time FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "dd": f"""SELECT d.doc_id AS id, d.lang AS name, d.text, d.n_chars, {_DS} AS dataset_id, coalesce(l.quality, 1) = 1 AS is_active, coalesce(l.toxic, 0) AS deleted
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "ds": f"SELECT DISTINCT {_DS} AS id, source AS name, 0 AS deleted FROM documents",
    "ss": f"""SELECT doc_id * 2 + k AS id, k + 1 AS type, doc_id AS document_id, {_DS} AS dataset_id, doc_id AS paragraph_id, 0 AS deleted, e.embedding,
        CASE WHEN k = 0 THEN text ELSE {summary("text")} END AS content, CAST(doc_id % 5 AS INT) AS hit_num
        FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) z LEFT JOIN embeddings e ON e.vec_id = (31 * doc_id + k) % (SELECT count(*) FROM embeddings)""",
    "app": f"SELECT DISTINCT e.label AS application_id, {_DS} AS dataset_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id",
    "c": "SELECT vec_id AS id, embedding AS v FROM embeddings",
}


def with_tables(body: str, *names: str, more: str = "") -> str:
    ctes = [f"{n} AS ({TABLES[n]})" for n in names] + ([more] if more else [])
    return f"WITH {', '.join(ctes)} {body}"


def cosine(a: str, b: str) -> str:
    """The rounded score; null for a vector that is null or zero."""
    s = f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
    return f"round(CASE WHEN isnan({s}) THEN NULL ELSE {s} END, 6)"
