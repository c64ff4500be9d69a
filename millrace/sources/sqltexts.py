"""Named SQL texts: `--# name` begins one; they run with named parameters over temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"^--#\s*(\S+)\s*$", re.M)


def parse(text: str) -> dict[str, str]:
    """name -> SQL; a name that comes twice is an error."""
    parts = _NAME.split(text)
    names = parts[1::2]
    if repeated := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"names that come twice: {sorted(repeated)}")
    return {n: body.strip().rstrip(";").strip() for n, body in zip(names, parts[2::2])}


class SqlTexts:
    def __init__(self, text: str):
        self.known = parse(text)

    def run(self, spark: SparkSession, name: str, tables: dict[str, DataFrame] | None = None, **parameters) -> DataFrame:
        """The text's rows; {table} stands for a DataFrame and :parameter for a value, which never becomes part of the SQL."""
        if name not in self.known:
            raise KeyError(name)
        return spark.sql(self.known[name], args=parameters, **(tables or {}))
