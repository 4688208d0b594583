"""Exact percentiles and percent ranks, also for groups too large for one task.

A plain window gathers a whole group in one task. Here the rows are first counted per
distinct value; values fall into buckets by an expression of the value alone, positions
are those within the bucket plus the sizes of the buckets below. The plan is lazy and
the same for any amount of data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import rounded

# Buckets per doubling of a value. Any number gives the same results: more buckets make
# the largest sorted unit smaller and the list of bucket sizes of a group longer.
BUCKETS = 64
# Values that differ by less than this may share a bucket however small they are.
FINEST = 0.0001


def _join_same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, NULL matching NULL; the result keeps the left ones."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = " AND ".join(f"{c} <=> _{c}" for c in columns)
    return left.join(renamed, F.expr(same), how).drop(*[f"_{c}" for c in columns])


def bucket_of(value: str, buckets: int = BUCKETS) -> str:
    """SQL for the bucket of a number: never smaller for a larger number, NULL for NULL.

    Below ``buckets`` steps of FINEST each step is a bucket, beyond that each doubling of
    the value has ``buckets`` of them; so a group has a few thousand at most.
    """
    steps = f"(abs(CAST({value} AS DOUBLE)) / {FINEST}D)"
    power = f"floor(log2({steps}))"
    size = f"CASE WHEN {steps} < {buckets} THEN floor({steps}) ELSE" \
        f" ({power} - floor(log2({buckets}D))) * {buckets} + floor({steps} / pow(2, {power}) * {buckets}) END"
    return f"CAST(CASE WHEN {value} < 0 THEN -1 - ({size}) ELSE {size} END AS BIGINT)"


def running_counts(
    values: DataFrame, by: Sequence[str], value: str, count: str, buckets: int = BUCKETS
) -> DataFrame:
    """Adds ``before`` (rows of the group with a smaller value) and ``total`` (all rows).

    ``values`` holds distinct (by, value) with a row count; NULL sorts first. The largest
    unit a task sorts are the distinct values of one bucket of one group, or the buckets
    of one group.
    """
    keys = ", ".join(by)
    parts = values.withColumn("part", F.expr(bucket_of(value, buckets)))
    offsets = (
        parts.groupBy(*by, "part")
        .agg(F.expr(f"sum({count}) AS size"))
        .selectExpr(
            *by,
            "part",
            f"sum(size) OVER (PARTITION BY {keys} ORDER BY part NULLS FIRST) - size AS offset",
            f"sum(size) OVER (PARTITION BY {keys}) AS total",
        )
    )
    order = f"PARTITION BY {keys}, part ORDER BY {value} ROWS UNBOUNDED PRECEDING"
    local = parts.withColumn("local", F.expr(f"sum({count}) OVER ({order}) - {count}"))
    return _join_same(local, offsets, [*by, "part"], "inner").selectExpr(
        *by, value, count, "local + offset AS before", "total"
    )


def percent_rank(
    df: DataFrame, by: Sequence[str], order: str, out: str, scale: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """Percent rank within ``by`` on an ascending column (NULL first), times 100."""
    counted = df.groupBy(*by, order).agg(F.expr("count(1) AS n"))
    share = "coalesce(CAST(before AS DOUBLE) / nullif(CAST(total - 1 AS DOUBLE), 0D), 0D)"
    ranked = running_counts(counted, by, order, "n", buckets).selectExpr(
        *by, order, f"{rounded(f'{share} * 100', scale)} AS {out}"
    )
    # One ranked row per distinct value: a value shared by very many rows is split by
    # the adaptive skew join.
    return _join_same(df, ranked, [*by, order], "inner")


def group_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: Mapping[str, float],
    count: str = "1",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Interpolated percentiles: one row per group, one double column per point.

    ``count`` says how often each row counts. NULL values are left out; a group without
    any value has no row.
    """
    known = df.where(f"{value} IS NOT NULL")
    counted = known.groupBy(*by, value).agg(F.expr(f"sum({count}) AS n"))
    placed = running_counts(counted, by, value, "n", buckets)

    def at(position: str) -> str:
        holds = f"before <= {position} AND {position} < before + n"
        return f"max(CASE WHEN {holds} THEN CAST({value} AS DOUBLE) END)"

    def point(p: float) -> str:
        position = f"(total - 1) * {p}D"
        low, high = f"floor({position})", f"ceil({position})"
        # position is the same on every row of a group
        share = f"max({position} - {low})"
        return f"{at(low)} * (1 - {share}) + {at(high)} * {share}"

    return placed.groupBy(*by).agg(*[F.expr(f"{point(p)} AS {name}") for name, p in points.items()])


def with_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: Mapping[str, float],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Each row with the percentiles of its group over the rows of ``df``."""
    return _join_same(df, group_percentiles(df, by, value, points, buckets=buckets), by, "left")
