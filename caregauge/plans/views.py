"""The five reporting views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.clean import percent
from ..functions.labels import compared, performance_tier
from ..operators.aggregates import average, deviation, mean, one_of, partials, rows, total, value_of
from ..operators.fanout import repeated_count, repeated_mean, repeated_sum
from ..operators.latest import at_latest_year, with_end_date
from ..schemas import Star
from .efficiency import VOLUMES, categorised, dated_volumes
from .outcomes import fanned_out
from .performance import EXCESS, RATE, with_measure


def of_hospitals(fact: DataFrame, star: Star, hospitals: DataFrame) -> DataFrame:
    """A fact's rows of some of the hospitals."""
    return fact.join(star.side("hospitals", hospitals.select("hospital_key")), "hospital_key", "left_semi")


def hospital_scorecard(star: Star, chosen: Column | None = None) -> DataFrame:
    """One row per hospital, each fact at its own latest year.

    ``chosen``, a condition on the hospitals, keeps each fact to the chosen ones before it is
    aggregated; the latest years are those of the whole facts.
    """
    hospitals = star.hospitals if chosen is None else star.hospitals.where(chosen)

    def latest(fact: DataFrame) -> DataFrame:
        recent = at_latest_year(fact, star.dates)
        return recent if chosen is None else of_hospitals(recent, star, hospitals)

    rates = (
        latest(star.readmissions)
        .groupBy("hospital_key")
        .agg(
            average(RATE, 2).alias("avg_readmission_rate_pct"),
            average(EXCESS, 4).alias("avg_excess_ratio"),
            F.sum("number_of_discharges").alias("total_discharges"),
            F.sum("number_of_readmissions").alias("total_readmissions"),
        )
    )
    survey = (
        with_measure(latest(star.satisfaction), star, "measure_id")
        .groupBy("hospital_key")
        .agg(
            value_of("measure_id", K.OVERALL_RATING, "star_rating").alias("overall_star_rating"),
            value_of("measure_id", K.RECOMMEND, "answer_percent").alias("pct_would_recommend"),
            average("answer_percent", 1, one_of("measure_id", K.COMMUNICATION)).alias(
                "avg_communication_pct"
            ),
            average("answer_percent", 1, one_of("measure_id", K.ENVIRONMENT)).alias(
                "avg_environment_pct"
            ),
        )
    )
    quality = (
        with_measure(latest(star.quality), star, "measure_category")
        .groupBy("hospital_key")
        .agg(
            average("score", 4, one_of("measure_category", [K.MORTALITY])).alias("avg_mortality_rate"),
            average("score", 4, one_of("measure_category", [K.SAFETY])).alias("avg_hai_sir"),
            F.expr(f"count_if({compared(K.BETTER)})").alias("quality_above_national"),
            F.expr(f"count_if({compared(K.WORSE)})").alias("quality_below_national"),
            rows().alias("quality_measures_total"),
        )
    )
    return scorecard_of(hospitals, rates, survey, quality)


def scorecard_of(hospitals: DataFrame, rates: DataFrame, survey: DataFrame, quality: DataFrame) -> DataFrame:
    """Hospitals with their figures of each fact, one row each at most, by ``hospital_key``."""
    who = [
        "facility_id", "facility_name", "city", "state", "zip_code", "county_name",
        "hospital_type", "hospital_ownership", "emergency_services", "overall_rating",
        "readmission_group", "safety_group", "mortality_group", "patient_exp_group",
    ]
    joined = hospitals.select("hospital_key", *who)
    for per in (rates, survey, quality):
        joined = joined.join(per, "hospital_key", "left")
    return joined.select(
        *who,
        *rates.columns[1:],
        *survey.columns[1:],
        *quality.columns[1:],
        percent("quality_above_national", "quality_measures_total", 1).alias("pct_above_national"),
        performance_tier(
            "overall_rating", "avg_readmission_rate_pct", "overall_star_rating"
        ).alias("performance_tier"),
    )


def readmission_trends(star: Star, rules=K.CATEGORY_RULES_SHORT) -> DataFrame:
    """Per year, quarter, state, type and measure."""
    measure = ["measure_id", "measure_name", "clinical_category"]
    period = ["year", "quarter"]
    per = (
        dated_volumes(star, "quarter")
        .where("measure_key IS NOT NULL")
        .groupBy("hospital_key", *period, "measure_key")
        .agg(*partials(VOLUMES))
        .join(star.side("measures", categorised(star, rules)), "measure_key")
    )
    return (
        per.join(star.hospitals_with("state", "hospital_type"), "hospital_key")
        .groupBy(*period, "state", "hospital_type", *measure)
        .agg(
            rows().alias("hospital_count"),
            total("discharges").alias("total_discharges"),
            total("readmissions").alias("total_readmissions"),
            mean("rate", 2).alias("avg_readmission_pct"),
            mean("excess", 4).alias("avg_excess_ratio"),
        )
    )


def quality_summary(star: Star) -> DataFrame:
    """Per year, state, type and measure, rows with a score only."""
    flags = {
        "better": compared(K.BETTER),
        "same": compared(K.SAME),
        "worse": compared(K.WORSE),
    }
    measure = ["measure_category", "measure_id", "measure_name"]
    scored = star.quality.where("score IS NOT NULL AND measure_key IS NOT NULL")
    counted = (
        with_end_date(scored, star.dates)
        .groupBy("hospital_key", "year", "measure_key")
        .agg(*partials({"score": "score"}, flags, squares=["score"]))
    )
    per = with_measure(counted, star, *measure)
    return (
        per.join(star.hospitals_with("state", "hospital_type"), "hospital_key")
        .groupBy("year", "state", "hospital_type", *measure)
        .agg(
            rows().alias("hospital_count"),
            mean("score", 4).alias("national_avg_score"),
            deviation("score", 4).alias("score_std_dev"),
            F.round(F.min("score_min"), 4).alias("min_score"),
            F.round(F.max("score_max"), 4).alias("max_score"),
            F.sum("better").alias("hospitals_better"),
            F.sum("same").alias("hospitals_same"),
            F.sum("worse").alias("hospitals_worse"),
            F.sum("rows").alias("_rows"),
        )
        .withColumn("pct_better_than_national", percent("hospitals_better", "_rows", 1))
        .drop("_rows")
    )


def satisfaction_detail(star: Star) -> DataFrame:
    """Per year, hospital and survey measure."""
    counted = (
        with_end_date(star.satisfaction.where("measure_key IS NOT NULL"), star.dates)
        .groupBy("hospital_key", "year", "measure_key")
        .agg(
            average("star_rating", 2).alias("avg_star_rating"),
            average("answer_percent", 1).alias("avg_answer_pct"),
            F.max("completed_surveys").alias("completed_surveys"),
            F.max("response_rate_pct").alias("response_rate_pct"),
        )
    )
    per = with_measure(counted, star, "measure_id", "measure_name")
    who = ["facility_id", "facility_name", "city", "state", "hospital_type", "patient_exp_group"]
    return per.join(star.hospitals_with(*who), "hospital_key").select(
        "year", *who, "measure_id", "measure_name", *counted.columns[3:]
    )


def state_summary(star: Star) -> DataFrame:
    """Per state over the product of the three facts; see ``operators.fanout``."""
    return states_of(fanned_out(star, "state", "overall_rating"))


def states_of(hospitals: DataFrame) -> DataFrame:
    """The state view of ``fanned_out`` hospitals."""
    weighted = hospitals.selectExpr(
        "*",
        "overall_rating AS rating_sum",
        "CASE WHEN overall_rating IS NOT NULL THEN 1 ELSE 0 END AS rating_cnt",
    )
    return weighted.groupBy("state").agg(
        rows().alias("hospital_count"),
        repeated_mean("rating", "all_rows", 2).alias("avg_overall_rating"),
        repeated_mean("rate", "readmission_others", 2).alias("avg_readmission_pct"),
        repeated_mean("excess", "readmission_others", 4).alias("avg_excess_ratio"),
        repeated_sum("discharges", "readmission_others").alias("total_discharges"),
        repeated_mean("stars", "survey_others", 2).alias("avg_star_rating"),
        repeated_mean("recommend", "survey_others", 1).alias("avg_pct_recommend"),
        repeated_mean("mortality", "quality_others", 4).alias("avg_mortality_rate"),
        repeated_mean("hai", "quality_others", 4).alias("avg_hai_sir"),
        repeated_count("overall_rating = 5").alias("hospitals_5star"),
        repeated_count("overall_rating = 4").alias("hospitals_4star"),
        repeated_count("overall_rating = 3").alias("hospitals_3star"),
        repeated_count("overall_rating <= 2").alias("hospitals_1_2star"),
    )


def all_views(star: Star) -> dict[str, DataFrame]:
    """The views by their published names."""
    return {
        "vw_hospital_scorecard": hospital_scorecard(star),
        "vw_readmission_trends": readmission_trends(star),
        "vw_quality_summary": quality_summary(star),
        "vw_satisfaction_detail": satisfaction_detail(star),
        "vw_state_benchmark": state_summary(star),
    }
