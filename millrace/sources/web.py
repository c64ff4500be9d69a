"""Fetched pages as rows: PDFs by their extractor, others by their visible text, with the html kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import html_text
from millrace.sources.pdf import pages_of, simple_extractor


def web_pages(fetched: DataFrame, key: str, extract: Callable[[bytes], list[str]] = simple_extractor) -> DataFrame:
    """key, url, text, html of fetched (key, url, content: bytes). A url that ends in .pdf is a PDF: its pages' texts are joined by line feeds and its html is null."""
    is_pdf = F.lower(F.regexp_replace("url", r"[?#].*$", "")).endswith(".pdf")
    plain = fetched.where(~F.coalesce(is_pdf, F.lit(False))).withColumn("html", F.make_valid_utf8(F.col("content").cast("string"))).select(key, "url", html_text(F.col("html")).alias("text"), "html")
    pdfs = fetched.where(is_pdf)
    parts = pages_of(pdfs.select(key, "content"), key, extract).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))  # a file's pages are one document
    texts = parts.select(key, F.array_join("p.text", "\n").alias("text"))
    return plain.unionByName(pdfs.select(key, "url").join(texts, key, "left").select(key, "url", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("html")))
