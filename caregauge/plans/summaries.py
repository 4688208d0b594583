"""Saved sums of the facts by hospital, measure and year, from which the scorecard is refreshed.

Sums, counts and extremes of different years merge, so that a refresh after a load reads the
years that the load touched, and a scorecard reads the sums of the latest year.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import compared, same_text
from ..operators.aggregates import mean, merged, one_of, partials, total, value_of
from ..operators.fanout import with_multipliers
from ..schemas import Star
from ..sinks.tables import read_table, replace_partitions, with_year
from .increments import in_years
from .performance import EXCESS, RATE, with_measure
from .views import scorecard_of

BY = ["hospital_key", "measure_key", "end_year"]
VALUES = {
    "readmissions": {"rate": RATE, "excess": EXCESS, "discharges": "number_of_discharges", "readmissions": "number_of_readmissions"},
    "satisfaction": {"stars": "star_rating", "answer": "answer_percent"},
    "quality": {"score": "score"},
}
FLAGS = {"quality": {"better": compared(K.BETTER), "worse": compared(K.WORSE)}}


def summarise(fact: DataFrame, table: str) -> DataFrame:
    """Sums of one fact (of the star's name ``table``) by hospital, measure and end year."""
    dated = fact if "end_year" in fact.columns else with_year(fact)
    return dated.groupBy(*BY).agg(*partials(VALUES[table], FLAGS.get(table)))


def refresh(star: Star, folder: str, years: Mapping[str, list[int | None]] | None = None) -> None:
    """Writes the sums of the given years of each fact (as ``increments.load_into`` returns them),
    or of all years. Sums of other years stay, and their facts are not read."""
    for table in VALUES:
        fact = getattr(star, table)
        if years is not None:
            if not years.get(table):
                continue
            fact = in_years(fact if "end_year" in fact.columns else with_year(fact), years[table])
        replace_partitions(summarise(fact, table), f"{folder}/{table}", ["end_year"])


def saved(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {table: read_table(spark, f"{folder}/{table}") for table in VALUES}


def fanned_out(star: Star, sums: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    """``outcomes.fanned_out`` out of saved sums: same figures, and no fact is read."""
    category = star.side("measures", star.measures.select("measure_key", "measure_id", "measure_category"))

    def per(table: str, **values: tuple[str, str | None]) -> DataFrame:
        named = sums[table].join(category, "measure_key", "left")
        return named.groupBy("hospital_key").agg(*merged(values))

    recommend = f"measure_id = '{K.RECOMMEND}'"
    return with_multipliers(
        star.hospitals.select("hospital_key", *columns),
        "hospital_key",
        {
            "readmission": per("readmissions", rate=("rate", None), excess=("excess", None), discharges=("discharges", None)),
            "survey": per("satisfaction", stars=("stars", None), recommend=("answer", recommend)),
            "quality": per(
                "quality",
                mortality=("score", str(same_text("measure_category", K.MORTALITY))),
                hai=("score", str(same_text("measure_category", K.SAFETY))),
            ),
        },
    )


def scorecard(star: Star, sums: Mapping[str, DataFrame]) -> DataFrame:
    """The hospital scorecard out of saved sums: same rows as ``views.hospital_scorecard``."""

    def latest(table: str) -> DataFrame:
        last = sums[table].agg(F.max("end_year")).scalar()
        return sums[table].where(F.col("end_year") == last)

    def over(ids: list[str] | tuple[str, ...], column: str, value: str, scale: int):
        some = one_of(column, ids)
        top, bottom = (f"sum(CASE WHEN {some} THEN {value}_{part} END)" for part in ("sum", "cnt"))
        return F.expr(f"CAST(round({top} / nullif({bottom}, 0), {scale}) AS DECIMAL(18,{scale}))")

    rates = latest("readmissions").groupBy("hospital_key").agg(
        mean("rate", 2).alias("avg_readmission_rate_pct"),
        mean("excess", 4).alias("avg_excess_ratio"),
        total("discharges").alias("total_discharges"),
        total("readmissions").alias("total_readmissions"),
    )
    survey = with_measure(latest("satisfaction"), star, "measure_id").groupBy("hospital_key").agg(
        value_of("measure_id", K.OVERALL_RATING, "stars_max").alias("overall_star_rating"),
        value_of("measure_id", K.RECOMMEND, "answer_max").alias("pct_would_recommend"),
        over(K.COMMUNICATION, "measure_id", "answer", 1).alias("avg_communication_pct"),
        over(K.ENVIRONMENT, "measure_id", "answer", 1).alias("avg_environment_pct"),
    )
    quality = with_measure(latest("quality"), star, "measure_category").groupBy("hospital_key").agg(
        over([K.MORTALITY], "measure_category", "score", 4).alias("avg_mortality_rate"),
        over([K.SAFETY], "measure_category", "score", 4).alias("avg_hai_sir"),
        F.sum("better").alias("quality_above_national"),
        F.sum("worse").alias("quality_below_national"),
        F.sum("rows").alias("quality_measures_total"),
    )
    return scorecard_of(star.hospitals, rates, survey, quality)
