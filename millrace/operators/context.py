"""Hits to prompts: grouping by document, XML, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import fill, xml_escape

CRLF = "\r\n"


def xml_groups(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """document_id, first_rank, source XML for each document, its hits in rank order. Names and contents are escaped."""
    groups = hits.groupBy("document_id").agg(F.min(rank).alias("first_rank"), F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), "document_name", "content"))).alias("hits"))
    contents = F.array_join(F.transform("hits", lambda h: xml_escape(h["content"])), CRLF)
    return groups.select("document_id", "first_rank", xml_escape(F.element_at("hits", 1)["document_name"]).alias("document_name"), contents.alias("contents"))


def xml_context(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """One row: the data element with a numbered source for each document, by best rank and then id. hits: a search's k rows."""
    g = xml_groups(hits, rank).agg(F.array_sort(F.collect_list(F.struct("first_rank", "document_id", "document_name", "contents"))).alias("groups"))
    source = F.transform(
        "groups",
        lambda x, k: F.concat(F.lit('<source id="'), (k + 1).cast("string"), F.lit('" name="'), x["document_name"], F.lit('">'), x["contents"], F.lit("</source>")),
    )
    return g.select(F.concat(F.lit("<data>"), F.array_join(source, CRLF), F.lit("</data>")).alias("context"))


def messages(system: Column, template: Column, context: Column, question: Column) -> Column:
    """[{system}, {user}]: the template with {data} and {question} filled."""
    user = fill(template, data=context, question=question)
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
