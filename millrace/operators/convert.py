"""Documents to markdown, page by page, behind a cache of documents and one of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cache import get_or_compute
from millrace.sources.pdf import pages_of, simple_extractor


def to_markdown(files: DataFrame, documents: DataFrame, pages: DataFrame, convert: Callable[[DataFrame], DataFrame], extract: Callable[[bytes], list[str]] = simple_extractor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, md5, markdown of files (id, content); the cache of documents (md5, markdown) grown; the cache of pages (md5, markdown) grown).

    Only files that the first cache lacks are read, each content once; only pages that the second lacks are converted
    (convert adds markdown to md5, text), each text once. Pages are merged in page order, a blank line between them.
    """
    told = files.select("id", "content", F.md5("content").alias("md5"))

    def converted(missing: DataFrame) -> DataFrame:
        own = pages_of(missing.select("md5", "content"), "md5", extract).where("page IS NOT NULL").select(F.col("md5").alias("file"), "page", F.md5("text").alias("md5"), "text")
        filled, _ = get_or_compute(own, pages, ["md5"], "markdown", convert)
        parts = filled.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "markdown"))).alias("p"))  # a file's pages are one document
        return missing.select("md5").join(parts.select(F.col("file").alias("md5"), F.array_join("p.markdown", "\n\n").alias("markdown")), "md5", "left").select("md5", F.coalesce("markdown", F.lit("")).alias("markdown"))

    filled, grown = get_or_compute(told, documents, ["md5"], "markdown", converted)
    texts = pages_of(told.dropDuplicates(["md5"]).select("md5", "content"), "md5", extract).where("page IS NOT NULL").select(F.md5("text").alias("md5"), "text")
    _, all_pages = get_or_compute(texts, pages, ["md5"], "markdown", convert)
    return filled.select("id", "md5", "markdown"), grown, all_pages
