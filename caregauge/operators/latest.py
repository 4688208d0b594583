"""Latest load per key, and latest year of a fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import sent_if_small


def latest_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The newest row per key (an SQL expression), as ``key`` plus the given columns.

    An aggregate rather than a ranked window: it combines on the map side, so a key
    with very many loads never gathers in one task. Ties fall to the larger row hash.
    """
    row = ", ".join(columns)
    newest = F.expr(f"max_by(struct({row}), struct({order}, xxhash64({row})))")
    return df.groupBy(F.expr(f"{key} AS key")).agg(newest.alias("row")).select("key", "row.*")


def with_end_date(fact: DataFrame, dates: DataFrame, *columns: str) -> DataFrame:
    """Inner join to the calendar on the end date.

    The calendar has one row per day of the years covered, whatever the size of the
    facts; it is broadcast if its source is as small as that.
    """
    calendar = dates.selectExpr("date_key AS end_date_key", "year", *columns)
    return fact.join(sent_if_small(calendar), "end_date_key")


def latest_year(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """One row: the largest calendar year among the fact's end dates.

    Reads one column of the fact and shuffles one row per task. Of a table partitioned by
    ``end_year`` it reads the last year alone, unless the calendar ends before that.
    """
    if "end_year" in fact.columns:
        within = dates.agg(F.max("year")).scalar()
        last = fact.where(F.col("end_year") <= within).agg(F.max("end_year")).scalar()
        fact = fact.where(F.col("end_year") == last)
    return with_end_date(fact.select("end_date_key"), dates).agg(F.max("year").alias("year"))


def at_latest_year(fact: DataFrame, dates: DataFrame, *columns: str) -> DataFrame:
    """Rows of a fact whose end date lies in the fact's latest year.

    The year is an uncorrelated sub-query. It selects the days of the calendar, and the
    same bound goes down to the fact scan: on the yyyyMMdd key, and on the partitions of
    a table that is partitioned by ``end_year``.
    """
    year = latest_year(fact, dates).scalar()
    recent = fact.where(F.col("end_date_key").between(year * 10000 + 101, year * 10000 + 1231))
    if "end_year" in fact.columns:
        recent = recent.where(F.col("end_year") == year)
    return with_end_date(recent, dates.where(F.col("year") == year), *columns)
