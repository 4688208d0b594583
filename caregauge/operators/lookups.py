"""Joins that look up, keep or reject rows by key, and top-n."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def lookup(df: DataFrame, other: DataFrame, key: str, defaults: Mapping[str, str | None]) -> DataFrame:
    """Left lookup of columns, each with a default (or None) where the key is not found."""
    joined = df.join(other.select(key, *defaults), key, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items() if d is not None}
    return joined.withColumns(filled)


def top_n(df: DataFrame, n: int, order: str, tie: str) -> DataFrame:
    """The n largest rows; planned as a top-k per task, not a full sort."""
    return df.orderBy(F.col(order).desc_nulls_last(), F.col(tie).asc()).limit(n)


def pick(df: DataFrame, **choices: Sequence) -> DataFrame:
    """Slicers: keep the rows whose column holds one of the chosen values.

    Slicers left at None keep everything.
    """
    for column, chosen in choices.items():
        if chosen is not None:
            df = df.where(F.col(column).isin(list(chosen)))
    return df
