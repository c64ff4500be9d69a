"""Filters that plans share: by example, soft delete, ownership, optional ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schema import SUPERUSER


def checked(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The columns, if df has them all; names from outside never reach SQL text."""
    columns = list(columns)
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {unknown}")
    return columns


def by_example(df: DataFrame, example: dict | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows that equal the example in all its fields (None: is null); an empty example keeps all."""
    for k in checked(df, example or {}):
        df = df.where(F.col(k).eqNullSafe(F.lit(example[k])))
    return df.select(*checked(df, columns)) if columns is not None else df


def first_by_example(df: DataFrame, example: dict, key: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The row with the smallest key among those that equal the example."""
    found = by_example(df, example).orderBy(key).limit(1)
    return found.select(*checked(df, columns)) if columns is not None else found


def visible(df: DataFrame, flag: str = "deleted") -> DataFrame:
    return df.where(F.col(flag) == 0)


def owned_by(df: DataFrame, user: int, column: str = "user_id") -> DataFrame:
    """Row-level security: the superuser sees all rows."""
    return df if user == SUPERUSER else df.where(F.col(column) == user)


def optional(df: DataFrame, value, predicate) -> DataFrame:
    """df.where(predicate(value)), or df where the value is None."""
    return df if value is None else df.where(predicate(value))


def name_contains(df: DataFrame, text: str | None, column: str = "name") -> DataFrame:
    return optional(df, text, lambda t: F.col(column).contains(t))


def older_than(moment: Column, as_of: Column, interval: str = "INTERVAL 1 DAY") -> Column:
    return moment < as_of - F.expr(interval)


def normalised_params(params: dict, drop: Iterable[str] = ()) -> dict:
    """Request parameters in snake case, without the dropped ones; digits become integers and true/false booleans."""
    out = {}
    for k, v in params.items():
        if k in drop:
            continue
        name = "".join("_" + c.lower() if c.isupper() else c for c in k)
        if isinstance(v, str):
            v = int(v) if v.lstrip("-").isdigit() else {"true": True, "false": False}.get(v, v)
        out[name] = v
    return out
