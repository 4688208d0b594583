"""Readmission and satisfaction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import same_text
from ..operators.aggregates import average, mean, one_of, partials, rounded, rows, value_of
from ..operators.latest import at_latest_year, with_end_date
from ..operators.lookups import present_in
from ..operators.ranks import BUCKETS, group_percentiles, with_percentiles
from ..schemas import Star

RATE = "readmission_rate_pct"
EXCESS = "excess_readmission_ratio"
QUARTILES = {"p25": 0.25, "median_pct": 0.5, "p75": 0.75}


def with_measure(df: DataFrame, star: Star, *columns: str, category: str | None = None) -> DataFrame:
    """Inner join to the measure dimension.

    Facts are grouped by the measure key first where they can be, so that names do not
    travel as grouping keys.
    """
    measures = star.measures
    if category is not None:
        measures = measures.where(same_text("measure_category", category))
    return df.join(star.side("measures", measures.select("measure_key", *columns)), "measure_key")


def readmission_by_hospital(star: Star) -> DataFrame:
    """Latest year per hospital. Facts without a measure count, but not as a measure."""
    per = (
        at_latest_year(star.readmissions, star.dates)
        .groupBy("hospital_key")
        .agg(
            average(EXCESS, 4).alias("avg_excess_readmission_ratio"),
            average(RATE, 2).alias("avg_readmission_rate_pct"),
            average("predicted_readmission_rate", 4).alias("avg_predicted_rate"),
            average("expected_readmission_rate", 4).alias("avg_expected_rate"),
            F.sum("number_of_discharges").alias("total_discharges"),
            F.sum("number_of_readmissions").alias("total_readmissions"),
            F.countDistinct("measure_key").alias("measure_count"),
        )
    )
    who = ["facility_id", "facility_name", "city", "state", "hospital_type", "readmission_group"]
    return (
        per.join(star.hospitals_with(*who), "hospital_key")
        .select(*who, *per.columns[1:])
        .orderBy(F.desc("avg_readmission_rate_pct"), "facility_id")
    )


def _rates_by_measure_state(star: Star) -> DataFrame:
    """Latest-year readmission facts counted per hospital, measure and rate, with state."""
    counted = (
        at_latest_year(star.readmissions, star.dates)
        .where("measure_key IS NOT NULL")
        .groupBy("hospital_key", "measure_key", RATE)
        .agg(*partials({"excess": EXCESS}))
    )
    per = with_measure(counted, star, "measure_id", "measure_name", category=K.READMISSION)
    return per.join(star.hospitals_with("state"), "hospital_key")


def readmission_percentiles(star: Star, buckets: int = BUCKETS) -> DataFrame:
    """Per measure, state and distinct rate, with quartiles over the distinct rates.

    The rate is part of the grouping, so counts are per rate and the average, smallest
    and largest rate are that rate. The "national" averages are per state.
    """
    grouped = (
        _rates_by_measure_state(star)
        .groupBy("measure_name", "measure_id", "state", RATE)
        .agg(
            rows().alias("hospital_count"),
            mean("excess", 4).alias("national_avg_excess_ratio"),
        )
    )
    shown = F.round(RATE, 2)
    return (
        with_percentiles(grouped, ["measure_id", "state"], RATE, QUARTILES, buckets)
        .select(
            "measure_name",
            "measure_id",
            "state",
            "hospital_count",
            "national_avg_excess_ratio",
            shown.alias("national_avg_readmission_pct"),
            shown.alias("min_readmission_pct"),
            shown.alias("max_readmission_pct"),
            *[F.expr(f"{rounded(name, 2)} AS {name}") for name in QUARTILES],
        )
        .orderBy("measure_name", "state", "national_avg_readmission_pct")
    )


def readmission_percentiles_by_group(star: Star, buckets: int = BUCKETS) -> DataFrame:
    """One row per measure and state, quartiles over all rows of the group."""
    rates = _rates_by_measure_state(star).withColumnRenamed("rows", "n")
    by = ["measure_id", "state"]
    # one row per hospital, measure and rate: hospitals with several rates count once
    per_hospital = rates.groupBy("hospital_key", "measure_name", *by).agg(
        F.expr(f"sum({RATE} * n)").alias("rate_sum"),
        F.expr(f"sum(CASE WHEN {RATE} IS NOT NULL THEN n END)").alias("rate_cnt"),
        F.min(RATE).alias("rate_min"),
        F.max(RATE).alias("rate_max"),
    )
    groups = per_hospital.groupBy("measure_name", *by).agg(
        rows().alias("hospital_count"),
        mean("rate", 2).alias("avg_readmission_pct"),
        F.round(F.min("rate_min"), 2).alias("min_readmission_pct"),
        F.round(F.max("rate_max"), 2).alias("max_readmission_pct"),
    )
    points = group_percentiles(rates, by, RATE, QUARTILES, count="n", buckets=buckets)
    points = points.selectExpr(*by, *[f"{rounded(n, 2)} AS {n}" for n in QUARTILES])
    return groups.join(points, by, "left").orderBy("measure_name", "state")


def readmission_trend(star: Star) -> DataFrame:
    per = (
        with_measure(
            with_end_date(star.readmissions, star.dates), star, "measure_name", category=K.READMISSION
        )
        .groupBy("hospital_key", "year", "measure_name")
        .agg(*partials({"excess": EXCESS, "rate": RATE}))
    )
    return (
        present_in(per, star.hospitals_with(), "hospital_key")
        .groupBy("year", "measure_name")
        .agg(
            rows().alias("hospital_count"),
            mean("excess", 4).alias("avg_excess_ratio"),
            mean("rate", 2).alias("avg_readmission_pct"),
        )
        .orderBy("year", "measure_name")
    )


def excess_readmissions(star: Star) -> DataFrame:
    """Latest-year rows with more readmissions than expected."""
    # the latest year is that of the whole fact, not of the rows at risk
    recent = at_latest_year(star.readmissions, star.dates).where(f"{EXCESS} > 1.0")
    who = ["facility_id", "facility_name", "city", "state", "hospital_type"]
    return (
        with_measure(recent, star, "measure_name")
        .join(star.hospitals_with(*who), "hospital_key")
        .orderBy(F.desc(EXCESS), "facility_id", "measure_name", "number_of_discharges")
        .select(
            *who,
            "measure_name",
            F.round(EXCESS, 4).alias("excess_ratio"),
            F.round(RATE, 2).alias(RATE),
            "number_of_discharges",
            "number_of_readmissions",
        )
    )


def satisfaction_by_hospital(star: Star) -> DataFrame:
    per = (
        with_measure(at_latest_year(star.satisfaction, star.dates), star, "measure_id")
        .groupBy("hospital_key")
        .agg(
            value_of("measure_id", K.OVERALL_RATING, "star_rating").alias("overall_star_rating"),
            value_of("measure_id", K.RECOMMEND, "answer_percent").alias("pct_recommend"),
            average("answer_percent", 1, one_of("measure_id", K.COMMUNICATION)).alias(
                "avg_communication_score"
            ),
            average("answer_percent", 1, one_of("measure_id", K.ENVIRONMENT)).alias(
                "avg_environment_score"
            ),
            F.max("completed_surveys").alias("completed_surveys"),
            F.max("response_rate_pct").alias("response_rate_pct"),
        )
    )
    who = ["facility_id", "facility_name", "city", "state", "hospital_type", "patient_exp_group"]
    return (
        per.join(star.hospitals_with(*who), "hospital_key")
        .select(*who, *per.columns[1:])
        .orderBy(F.desc("overall_star_rating"), F.desc("pct_recommend"), "facility_id")
    )


def satisfaction_by_state(star: Star, buckets: int = BUCKETS) -> DataFrame:
    """Per state, survey measure and distinct answer share, with the group's median."""
    counted = (
        at_latest_year(star.satisfaction, star.dates)
        .where("measure_key IS NOT NULL")
        .groupBy("hospital_key", "measure_key", "answer_percent")
        .agg(*partials({"stars": "star_rating"}))
    )
    per = (
        with_measure(counted, star, "measure_id", "measure_name", category=K.EXPERIENCE)
        .join(star.hospitals_with("state"), "hospital_key")
    )
    grouped = per.groupBy("state", "measure_id", "measure_name", "answer_percent").agg(
        rows().alias("hospital_count"), mean("stars", 2).alias("avg_star_rating")
    )
    median = {"median_pct_always": 0.5}
    return (
        with_percentiles(grouped, ["state", "measure_id"], "answer_percent", median, buckets)
        .select(
            "state",
            "measure_id",
            "measure_name",
            "hospital_count",
            F.round("answer_percent", 1).alias("avg_pct_always"),
            "avg_star_rating",
            F.expr(f"{rounded('median_pct_always', 1)} AS median_pct_always"),
        )
        .orderBy("state", "measure_name", "avg_pct_always")
    )


def satisfaction_trend(star: Star) -> DataFrame:
    rating = star.measures.where(f"measure_id = '{K.OVERALL_RATING}'").select("measure_key")
    per = (
        with_end_date(star.satisfaction, star.dates)
        .join(star.side("measures", rating), "measure_key")
        .groupBy("hospital_key", "year")
        .agg(*partials({"stars": "star_rating", "answer": "answer_percent"}))
    )
    return (
        per.join(star.hospitals_with("state"), "hospital_key")
        .groupBy("year", "state")
        .agg(
            mean("stars", 2).alias("avg_star_rating"),
            mean("answer", 1).alias("avg_answer_pct"),
            rows().alias("hospital_count"),
        )
        .orderBy("year", "state")
    )


def readmission_and_satisfaction(star: Star) -> DataFrame:
    """Hospitals with both a latest readmission rate and a latest star rating."""
    rates = (
        at_latest_year(star.readmissions, star.dates)
        .groupBy("hospital_key")
        .agg(
            average(RATE, 2).alias("avg_readmission_pct"),
            average(EXCESS, 4).alias("avg_excess_ratio"),
        )
        .where("avg_readmission_pct IS NOT NULL")
    )
    stars = (
        with_measure(at_latest_year(star.satisfaction, star.dates), star, "measure_id")
        .groupBy("hospital_key")
        .agg(
            value_of("measure_id", K.OVERALL_RATING, "star_rating").alias("overall_star_rating"),
            value_of("measure_id", K.RECOMMEND, "answer_percent").alias("pct_would_recommend"),
        )
        .where("overall_star_rating IS NOT NULL")
    )
    who = ["facility_id", "facility_name", "state", "hospital_type"]
    return (
        rates.join(stars, "hospital_key")
        .join(star.hospitals_with(*who), "hospital_key")
        .select(*who, *rates.columns[1:], *stars.columns[1:])
        .orderBy(F.desc("avg_readmission_pct"), "facility_id")
    )
