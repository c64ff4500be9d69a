"""Semi-structured text as VARIANT: documents of mixed shapes, their common schema, and typed columns of it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document(text: Column | str) -> Column:
    """The document of a text; null where it isn't one."""
    return F.try_parse_json(text)


def broken(text: Column | str) -> Column:
    """Whether a text is there but holds no document."""
    text = F.col(text) if isinstance(text, str) else text
    return text.isNotNull() & F.try_parse_json(text).isNull()


def field(doc: Column | str, path: str, kind: str) -> Column:
    """The value at a path as a type; null where there is none, or none that can be such a one (a number's text is a number)."""
    return F.try_variant_get(doc, path, kind)


def elements(df: DataFrame, doc: str, path: str, place: str = "place", element: str = "element") -> DataFrame:
    """A row for each element of the list at a path, with its place from 0; documents without it give none."""
    return df.select("*", F.posexplode(field(doc, path, "array<variant>")).alias(place, element))


def merged_schema(df: DataFrame, doc: str) -> str:
    """The schema that all documents fit, as Spark's type text: fields of all of them, and VARIANT where types differ."""
    found = df.agg(F.schema_of_variant_agg(doc).alias("s")).first().s
    return re.sub(r"\bVOID\b", "VARIANT", found.replace("OBJECT<", "STRUCT<"))


def typed(df: DataFrame, doc: str, name: str) -> DataFrame:
    """df with the documents as a struct of their merged schema."""
    return df.withColumn(name, F.try_variant_get(doc, "$", merged_schema(df, doc)))
