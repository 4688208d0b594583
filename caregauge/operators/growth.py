"""Comparison with the year before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def year_over_year(df: DataFrame, by: Sequence[str], year: str, value: str) -> DataFrame:
    """Adds prior_year_discharges, volume_change and yoy_growth_pct.

    ``df`` has one row per (by, year). The frame holds exactly the year before, so a
    gap leaves NULL, and one shuffle does what a self-join would need two for. A group
    has at most as many rows as the calendar has years.
    """
    before = f"OVER (PARTITION BY {', '.join(by)} ORDER BY {year} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    change = f"{value} - prior_year_discharges"
    return df.selectExpr("*", f"max({value}) {before} AS prior_year_discharges").selectExpr(
        "*",
        f"{change} AS volume_change",
        f"round(CAST({change} AS DECIMAL(20,4)) / nullif(prior_year_discharges, 0) * 100, 2)"
        " AS yoy_growth_pct",
    )
