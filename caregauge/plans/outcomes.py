"""Mortality, infection and benchmark queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.clean import percent
from ..functions.labels import compared, performance_tier, same_text
from ..operators.aggregates import average, counted_list, deviation, mean, ordered_list, partials, rows, value_of
from ..operators.fanout import fanout_partials, repeated_count, repeated_mean
from ..operators.latest import at_latest_year, with_end_date
from ..operators.lookups import present_in
from ..schemas import Star
from .performance import EXCESS, RATE, with_measure


def _outcome_by_hospital(
    star: Star, category: str, columns: Mapping[str, str], composite: str, group: str, scope: str,
    worse: tuple[str, Column],
) -> DataFrame:
    """Latest-year scores of a category per hospital, one column per measure.

    Rows are counted per measure first; a hospital then has at most as many rows as the
    category has measures. ``scope`` "fact" takes the latest year of the whole fact,
    "category" that of the category.
    """
    in_category = star.measures.where(same_text("measure_category", category))
    of_category = star.side("measures", in_category.select("measure_key", "measure_id"))

    def kept(fact: DataFrame) -> DataFrame:
        return fact.join(of_category.select("measure_key"), "measure_key", "left_semi")

    if scope == "category":
        recent = at_latest_year(kept(star.quality), star.dates)
    else:
        recent = kept(at_latest_year(star.quality, star.dates))
    per_measure = (
        recent.groupBy("hospital_key", "measure_key")
        .agg(*partials({"score": "score"}, {"worse": compared(K.WORSE)}))
        .join(of_category, "measure_key")
    )
    per = per_measure.groupBy("hospital_key").agg(
        *[value_of("measure_id", m, "score_max").alias(c) for c, m in columns.items()],
        mean("score", 4).alias(composite),
        worse[1].alias(worse[0]),
    )
    who = ["facility_id", "facility_name", "city", "state", "hospital_type", group]
    return (
        per.join(star.hospitals_with(*who), "hospital_key")
        .select(*who, *per.columns[1:])
        .orderBy(F.desc(composite), "facility_id")
    )


def mortality_by_hospital(star: Star, scope: str = "fact", counted: bool = False) -> DataFrame:
    """``worse_than_national`` names a measure once per row, or ``counted`` once with its count."""
    listed = counted_list if counted else ordered_list
    return _outcome_by_hospital(
        star, K.MORTALITY, K.MORTALITY_COLUMNS, "composite_mortality_rate", "mortality_group", scope,
        ("worse_than_national", listed("measure_id", "worse")),
    )


def infections_by_hospital(star: Star, scope: str = "fact") -> DataFrame:
    return _outcome_by_hospital(
        star, K.SAFETY, K.INFECTION_COLUMNS, "composite_hai_sir", "safety_group", scope,
        ("hai_worse_than_national_count", F.sum("worse")),
    )


def quality_trend(star: Star) -> DataFrame:
    flags = {"better": compared(K.BETTER), "same": compared(K.SAME), "worse": compared(K.WORSE)}
    by = ["year", "measure_category", "measure_id", "measure_name"]
    counted = (
        with_end_date(star.quality.where("measure_key IS NOT NULL"), star.dates)
        .groupBy("hospital_key", "year", "measure_key")
        .agg(*partials({"score": "score"}, flags, squares=["score"]))
    )
    per = with_measure(counted, star, *by[1:])
    return (
        present_in(per, star.hospitals_with(), "hospital_key")
        .groupBy(*by)
        .agg(
            rows().alias("hospital_count"),
            mean("score", 4).alias("national_avg_score"),
            deviation("score", 4).alias("score_std_dev"),
            F.round(F.min("score_min"), 4).alias("min_score"),
            F.round(F.max("score_max"), 4).alias("max_score"),
            F.sum("better").alias("better_than_national"),
            F.sum("same").alias("same_as_national"),
            F.sum("worse").alias("worse_than_national"),
        )
        .orderBy("year", "measure_category", "measure_name")
    )


def overall_scorecard(star: Star) -> DataFrame:
    """One row per hospital over all periods, with its performance tier."""
    rates = star.readmissions.groupBy("hospital_key").agg(
        average(RATE, 2).alias("avg_readmission_pct")
    )
    stars = (
        with_measure(star.satisfaction, star, "measure_id")
        .groupBy("hospital_key")
        .agg(value_of("measure_id", K.OVERALL_RATING, "star_rating").alias("overall_stars"))
    )
    labels = star.quality.groupBy("hospital_key").agg(
        F.expr(f"count_if({compared(K.BETTER)})").alias("quality_better"),
        F.expr(f"count_if({compared(K.WORSE)})").alias("quality_worse"),
        rows().alias("quality_total"),
    )
    who = [
        "facility_id", "facility_name", "city", "state", "hospital_type", "hospital_ownership",
        "overall_rating",
    ]
    joined = star.hospitals.select("hospital_key", *who)
    for per in (rates, stars, labels):
        joined = joined.join(per, "hospital_key", "left")
    return joined.select(
        *who,
        "avg_readmission_pct",
        "overall_stars",
        "quality_better",
        "quality_worse",
        "quality_total",
        percent("quality_better", "quality_total", 1).alias("pct_quality_above_national"),
        performance_tier("overall_rating", "avg_readmission_pct", "overall_stars").alias(
            "performance_tier"
        ),
    ).orderBy(F.desc("overall_rating"), "avg_readmission_pct", "facility_id")


def fanned_out(star: Star, *columns: str) -> DataFrame:
    """Hospitals with the partial aggregates of their three facts and the multipliers."""
    category = star.measures.select("measure_key", "measure_id", "measure_category")
    quality = star.quality.join(star.side("measures", category), "measure_key", "left")
    survey = star.satisfaction.join(star.side("measures", category), "measure_key", "left")

    def scores(kind: str) -> str:
        return f"CASE WHEN {same_text('measure_category', kind)} THEN score END"

    recommend = f"CASE WHEN measure_id = '{K.RECOMMEND}' THEN answer_percent END"
    return fanout_partials(
        star.hospitals.select("hospital_key", *columns),
        "hospital_key",
        {
            "readmission": (
                star.readmissions,
                {"rate": RATE, "excess": EXCESS, "discharges": "number_of_discharges"},
            ),
            "survey": (survey, {"stars": "star_rating", "recommend": recommend}),
            "quality": (quality, {"mortality": scores(K.MORTALITY), "hai": scores(K.SAFETY)}),
        },
    )


def state_benchmark(star: Star) -> DataFrame:
    """Per state over the product of the three facts: star counts are multiplied rows."""
    return benchmark_of(fanned_out(star, "state", "overall_rating"))


def benchmark_of(hospitals: DataFrame) -> DataFrame:
    """The state benchmark of ``fanned_out`` hospitals."""
    return (
        hospitals
        .groupBy("state")
        .agg(
            rows().alias("hospital_count"),
            repeated_mean("rate", "readmission_others", 2).alias("state_avg_readmission_pct"),
            repeated_mean("excess", "readmission_others", 4).alias("state_avg_excess_ratio"),
            repeated_mean("stars", "survey_others", 2).alias("state_avg_star_rating"),
            repeated_mean("mortality", "quality_others", 4).alias("state_avg_mortality"),
            repeated_mean("hai", "quality_others", 4).alias("state_avg_hai_sir"),
            repeated_count("overall_rating = 5").alias("five_star_hospitals"),
            repeated_count("overall_rating = 4").alias("four_star_hospitals"),
            repeated_count("overall_rating <= 2").alias("low_rated_hospitals"),
        )
        .orderBy("state_avg_readmission_pct", "state")
    )


def state_benchmark_corrected(star: Star) -> DataFrame:
    """The state benchmark with every fact averaged by itself and hospitals counted once."""

    return (
        fanned_out(star, "state", "overall_rating")
        .groupBy("state")
        .agg(
            rows().alias("hospital_count"),
            mean("rate", 2).alias("state_avg_readmission_pct"),
            mean("excess", 4).alias("state_avg_excess_ratio"),
            mean("stars", 2).alias("state_avg_star_rating"),
            mean("mortality", 4).alias("state_avg_mortality"),
            mean("hai", 4).alias("state_avg_hai_sir"),
            F.expr("count_if(overall_rating = 5)").alias("five_star_hospitals"),
            F.expr("count_if(overall_rating = 4)").alias("four_star_hospitals"),
            F.expr("count_if(overall_rating <= 2)").alias("low_rated_hospitals"),
        )
        .orderBy("state_avg_readmission_pct", "state")
    )


def hospital_type_comparison(star: Star) -> DataFrame:
    return types_of(fanned_out(star, "hospital_type"))


def types_of(hospitals: DataFrame) -> DataFrame:
    """The type comparison of ``fanned_out`` hospitals."""
    return (
        hospitals
        .groupBy("hospital_type")
        .agg(
            rows().alias("hospital_count"),
            repeated_mean("excess", "readmission_others", 4).alias("avg_excess_readmission_ratio"),
            repeated_mean("rate", "readmission_others", 2).alias("avg_readmission_pct"),
            repeated_mean("stars", "survey_others", 2).alias("avg_satisfaction_stars"),
            repeated_mean("mortality", "quality_others", 4).alias("avg_mortality_rate"),
            repeated_mean("hai", "quality_others", 4).alias("avg_hai_sir"),
        )
        .orderBy("avg_readmission_pct", "hospital_type")
    )
