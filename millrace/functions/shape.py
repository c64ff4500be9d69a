"""Rows to fixed shapes, and bytes to text."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the schema's columns and types; columns that it lacks are null, others are left out."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _gunzip(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else gzip.decompress(x).decode("utf-8", "replace") for x in a.to_pylist()], pa.string())


def gunzip(c: Column | str) -> Column:
    return F.arrow_udf(_gunzip, T.StringType())(c)


def _gzip(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else gzip.compress(x.encode(), mtime=0) for x in a.to_pylist()], pa.binary())


def gzipped(c: Column | str) -> Column:
    return F.arrow_udf(_gzip, T.BinaryType())(c)
