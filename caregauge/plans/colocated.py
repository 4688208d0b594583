"""Hospitals and the saved sums of their facts as tables in buckets of the hospital.

What meets by hospital then lies together: scorecards and benchmarks over three facts join and
aggregate by hospital without a shuffle. Sums rather than facts are bucketed, since one task reads
a bucket: a hospital has a row per measure and year in them, however many rows its facts have.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Star
from ..sinks.tables import replace_bucketed, save_bucketed, with_year
from .increments import in_years
from .summaries import VALUES, summarise

KEY = "hospital_key"
#: Buckets of each table, to be chosen once by the sums' size: a bucket of 128 MB or less is a task.
BUCKETS = 64


#: Partitions are named by end year; that of rows without an end date by a year that does not occur.
NO_YEAR = 0


def _by_part(fact: DataFrame, table: str) -> DataFrame:
    return summarise(fact, table).withColumn("part", F.coalesce("end_year", F.lit(NO_YEAR))).drop("end_year")


def save(star: Star, prefix: str, buckets: int = BUCKETS) -> None:
    """Saves tables ``<prefix>_hospitals`` and, for each fact, ``<prefix>_<fact>``, its sums by
    hospital, measure and end year."""
    save_bucketed(star.hospitals, f"{prefix}_hospitals", KEY, buckets)
    for table in VALUES:
        save_bucketed(_by_part(getattr(star, table), table), f"{prefix}_{table}", KEY, buckets, ["part"])


def refresh(star: Star, prefix: str, years: Mapping[str, list[int | None]], buckets: int = BUCKETS) -> None:
    """Hospitals again, and the sums of the given years of each fact (as ``increments.load_into``
    returns them). Sums of other years stay, and their facts are not read."""
    save_bucketed(star.hospitals, f"{prefix}_hospitals", KEY, buckets)
    for table in VALUES:
        if years.get(table):
            fact = getattr(star, table)
            touched = in_years(fact if "end_year" in fact.columns else with_year(fact), years[table])
            parts = [NO_YEAR if year is None else year for year in years[table]]
            replace_bucketed(_by_part(touched, table), f"{prefix}_{table}", KEY, buckets, "part", parts)


def opened(spark: SparkSession, prefix: str, star: Star) -> tuple[Star, dict[str, DataFrame]]:
    """The saved hospitals in a star with the given one's other tables, and the sums; both as
    ``summaries.scorecard`` and ``summaries.fanned_out`` take them."""
    names = ("dates", "measures", *VALUES)
    tables = {n: (lambda n=n: getattr(star, n)) for n in names}
    end_year = F.nullif(F.col("part"), F.lit(NO_YEAR))
    sums = {t: spark.table(f"{prefix}_{t}").withColumn("end_year", end_year).drop("part") for t in VALUES}
    return Star(hospitals=spark.table(f"{prefix}_hospitals"), **tables), sums


def drop(spark: SparkSession, prefix: str) -> None:
    """Drops the tables that ``save`` made, with their files; those that are gone are passed over."""
    for table in ("hospitals", *VALUES):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{table}")
