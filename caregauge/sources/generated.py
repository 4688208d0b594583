"""Relations that come from parameters: the calendar and the measure seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as C


def date_dimension(
    spark: SparkSession, start: str = K.CALENDAR_START, end: str = K.CALENDAR_END
) -> DataFrame:
    """One row per day with calendar and October-to-September fiscal attributes."""
    days = spark.range(0, 1, 1, 1).selectExpr(
        f"explode(sequence(DATE '{start}', DATE '{end}')) AS full_date"
    )
    return days.select(
        C.date_key("full_date").alias("date_key"),
        "full_date",
        F.year("full_date").alias("year"),
        F.quarter("full_date").alias("quarter"),
        F.month("full_date").alias("month"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        C.us_week("full_date").alias("week_of_year"),
        F.dayofweek("full_date").alias("day_of_week"),
        F.date_format("full_date", "EEEE").alias("day_name"),
        F.expr("dayofweek(full_date) IN (1, 7)").alias("is_weekend"),
        C.fiscal_year("full_date").alias("fiscal_year"),
        C.fiscal_quarter("full_date").alias("fiscal_quarter"),
    )


def measure_seed(spark: SparkSession) -> DataFrame:
    """The seeded measures, as an inline relation of literals."""
    rows = ", ".join(
        f"('{m}', '{name}', '{category}', {higher}, '{unit}')"
        for m, name, category, higher, unit in K.MEASURE_SEED
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows}"
        " AS seed(measure_id, measure_name, measure_category, higher_is_better, unit_of_measure)"
    )
