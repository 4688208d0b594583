"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(d: str) -> Column:
    """yyyyMMdd as an integer, by arithmetic rather than by formatting text."""
    return F.expr(f"year({d}) * 10000 + month({d}) * 100 + day({d})")


def us_week(d: str) -> Column:
    """Week number where week 1 holds January 1 and weeks start on Sunday."""
    return F.expr(
        f"CAST((dayofyear({d}) + dayofweek(trunc({d}, 'year')) - 2) div 7 + 1 AS INT)"
    )


def fiscal_year(d: str) -> Column:
    """October to September, named after the year it ends in."""
    return F.expr(f"year(add_months({d}, 3))")


def fiscal_quarter(d: str) -> Column:
    return F.expr(f"quarter(add_months({d}, 3))")
