"""Data sets behind the report visuals, documented look-ups and sheet formulas.

Functions take the view (or query) they read, so that a caller may pass a saved table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels
from ..functions.clean import derived_rate
from ..operators.aggregates import average, count_by, rounded, rows, spread_pivot
from ..operators.growth import year_over_year
from ..operators.latest import with_end_date
from ..operators.lookups import lookup, pick, top_n
from ..schemas import Star
from .performance import EXCESS, RATE, with_measure

LATEST_RATE = "avg_readmission_rate_pct"


# -- documented look-ups ---------------------------------------------------------------
# The output columns of the look-ups and report tables.


def one_hospital(star: Star, facility_id: str, *columns: str) -> DataFrame:
    """Key and columns of the hospital with this id, case ignored, as a side to join to."""
    same = labels.same_text("facility_id", facility_id)
    return star.side("hospitals", star.hospitals.where(same).select("hospital_key", *columns))


def rows_of(fact: DataFrame, star: Star, facility_id: str, *columns: str) -> DataFrame:
    """One hospital's rows of a fact, with columns of the hospital.

    Its key is an uncorrelated sub-query, so that the scan itself is given the key: of a fact in
    the layout of ``sinks.tables`` it reads a few pages.
    """
    hospital = star.hospitals.where(labels.same_text("facility_id", facility_id))
    own = fact.where(F.col("hospital_key") == hospital.select("hospital_key").scalar())
    return own.join(one_hospital(star, facility_id, *columns), "hospital_key")


def facility_readmissions(star: Star, facility_id: str) -> DataFrame:
    rows = rows_of(star.readmissions, star, facility_id, "facility_name", "state")
    return (
        with_measure(rows, star, "measure_name")
        .select("facility_name", "state", "measure_name", RATE, EXCESS)
        .orderBy("measure_name")
    )


def worse_than_expected(scorecard: DataFrame) -> DataFrame:
    return (
        scorecard.where(F.col("avg_excess_ratio") > 1.0)
        .orderBy(F.desc("avg_excess_ratio"), "facility_id")
        .select("facility_name", "state", LATEST_RATE, "avg_excess_ratio")
    )


def states_by_rate(states: DataFrame) -> DataFrame:
    return states.orderBy("avg_readmission_pct", "state")


def top_performers(scorecard: DataFrame) -> DataFrame:
    return (
        scorecard.where(F.col("performance_tier") == K.TOP)
        .orderBy(F.desc("overall_star_rating"), LATEST_RATE, "facility_id")
        .select(
            "facility_name", "state", "hospital_type", "overall_star_rating", LATEST_RATE,
            "avg_mortality_rate", "performance_tier",
        )
    )


# -- relationships of the report model -----------------------------------------------------


def scorecard_with_survey(scorecard: DataFrame, detail: DataFrame) -> DataFrame:
    """Each hospital with its survey rows; one without any stays, once."""
    survey = detail.select(
        "facility_id", "year", "measure_id", "measure_name", "avg_star_rating", "avg_answer_pct"
    )
    card = scorecard.select("facility_id", "facility_name", "state", "performance_tier")
    return card.join(survey, "facility_id", "left")


def scorecard_with_state(scorecard: DataFrame, states: DataFrame) -> DataFrame:
    """Each hospital beside the figures of its state."""
    figures = states.selectExpr(
        "state",
        "avg_readmission_pct AS state_avg_readmission_pct",
        "avg_excess_ratio AS state_avg_excess_ratio",
        "avg_star_rating AS state_avg_star_rating",
        "avg_mortality_rate AS state_avg_mortality_rate",
        "avg_hai_sir AS state_avg_hai_sir",
    )
    card = scorecard.select(
        "facility_id", "facility_name", "state", LATEST_RATE, "avg_excess_ratio",
        "overall_star_rating", "performance_tier",
    )
    return card.join(figures, "state", "left")


def scorecard_with_trends(scorecard: DataFrame, trends: DataFrame) -> DataFrame:
    """Each hospital beside the yearly volume of its state and type.

    The trend view has no facility, so the relationship runs over state and type. Trends
    are summed per year first: a hospital has one row per year, not one per measure.
    """
    yearly = trends.groupBy("state", "hospital_type", "year").agg(
        F.sum("total_discharges").alias("peer_discharges"),
        F.sum("total_readmissions").alias("peer_readmissions"),
    )
    card = scorecard.select("facility_id", "state", "hospital_type", "performance_tier")
    return card.join(yearly, ["state", "hospital_type"], "left")


# -- hospital page -----------------------------------------------------------------------


def highest_readmission_rates(scorecard: DataFrame, n: int = 20) -> DataFrame:
    columns = scorecard.select("facility_id", "facility_name", LATEST_RATE)
    return top_n(columns, n, LATEST_RATE, "facility_id")


def state_map(states: DataFrame) -> DataFrame:
    return states.select("state", "avg_readmission_pct", "avg_overall_rating")


def average_stars(scorecard: DataFrame, target: int = 4) -> DataFrame:
    return scorecard.agg(average("overall_star_rating", 4).alias("avg_star_rating")).select(
        "avg_star_rating", F.lit(1).alias("low"), F.lit(5).alias("high"), F.lit(target).alias("target")
    )


def survey_domains(detail: DataFrame) -> DataFrame:
    domains = detail.where(F.col("measure_id").isin(list(K.DOMAINS)))
    return domains.groupBy("measure_name").agg(
        average("avg_answer_pct", 4).alias("avg_answer_pct")
    )


def volume_and_rate(scorecard: DataFrame) -> DataFrame:
    return scorecard.select("facility_id", "facility_name", "total_discharges", LATEST_RATE)


def tier_distribution(scorecard: DataFrame) -> DataFrame:
    counts = count_by(scorecard, "performance_tier")
    return counts.orderBy(F.desc("hospital_count"), "performance_tier")


def hospital_detail(scorecard: DataFrame, facility_id: str) -> DataFrame:
    """One hospital of a scorecard; ``views.hospital_scorecard`` can be built for it alone."""
    return scorecard.where(labels.same_text("facility_id", facility_id))


def hospital_history(star: Star, facility_id: str) -> DataFrame:
    """Yearly readmission figures of one hospital."""
    rows = rows_of(star.readmissions, star, facility_id, "facility_id")
    return (
        with_end_date(rows, star.dates)
        .groupBy("facility_id", "year")
        .agg(
            F.sum("number_of_discharges").alias("total_discharges"),
            F.sum("number_of_readmissions").alias("total_readmissions"),
            average(RATE, 2).alias("avg_readmission_pct"),
            average(EXCESS, 4).alias("avg_excess_ratio"),
        )
        .orderBy("year")
    )


def survey_history(star: Star, facility_id: str) -> DataFrame:
    """Yearly survey figures of one hospital, per measure."""
    rows = rows_of(star.satisfaction, star, facility_id, "facility_id")
    return (
        with_measure(with_end_date(rows, star.dates), star, "measure_id", "measure_name")
        .groupBy("facility_id", "year", "measure_id", "measure_name")
        .agg(
            average("star_rating", 2).alias("avg_star_rating"),
            average("answer_percent", 1).alias("avg_answer_pct"),
            F.max("completed_surveys").alias("completed_surveys"),
        )
        .orderBy("year", "measure_id")
    )


def quality_history(star: Star, facility_id: str) -> DataFrame:
    """Yearly quality scores of one hospital, per measure."""
    rows = rows_of(star.quality, star, facility_id, "facility_id")
    return (
        with_measure(with_end_date(rows, star.dates), star, "measure_id", "measure_category")
        .groupBy("facility_id", "year", "measure_category", "measure_id")
        .agg(
            average("score", 4).alias("avg_score"),
            F.expr(f"count_if({labels.compared(K.BETTER)})").alias("better"),
            F.expr(f"count_if({labels.compared(K.WORSE)})").alias("worse"),
        )
        .orderBy("year", "measure_id")
    )


def comparison_counts(star: Star, **choices) -> DataFrame:
    """Quality rows per measure and label, for the chosen slicers."""
    rows = with_measure(with_end_date(star.quality, star.dates), star, "measure_id", "measure_category")
    return pick(rows, **choices).groupBy("measure_id", "compared_to_national").agg(F.expr("count(1) AS row_count"))


# -- efficiency page ---------------------------------------------------------------------


def annual_volume(trends: DataFrame, *by: str) -> DataFrame:
    """Discharges per year, national or by further columns such as state."""
    return (
        trends.groupBy("year", *by)
        .agg(F.sum("total_discharges").alias("total_discharges"))
        .orderBy("year", *by)
    )


def category_volume(trends: DataFrame) -> DataFrame:
    return annual_volume(trends, "clinical_category")


def state_growth(trends: DataFrame) -> DataFrame:
    yearly = annual_volume(trends, "state").select(
        "state",
        F.col("year").alias("current_year"),
        F.col("total_discharges").alias("current_discharges"),
    )
    return year_over_year(yearly, ["state"], "current_year", "current_discharges")


def state_category_matrix(trends: DataFrame, categories=tuple(K.CATEGORIES)) -> DataFrame:
    """Average of the trend view's rates per state and category."""
    return spread_pivot(trends, "state", "clinical_category", categories, "avg_readmission_pct", 4)


def efficiency_ranking(utilization: DataFrame) -> DataFrame:
    return utilization.select(
        "year", "facility_id", "facility_name", "efficiency_percentile"
    ).orderBy(F.desc("year"), "efficiency_percentile", "facility_id")


def excess_bed_days(scorecard: DataFrame, per_readmission=K.BED_DAYS_PER_READMISSION) -> DataFrame:
    return scorecard.agg(
        F.expr(f"sum(total_readmissions * {per_readmission}) AS total_excess_bed_days")
    )


def volume_tiers(utilization: DataFrame) -> DataFrame:
    return utilization.groupBy("volume_tier").agg(
        F.countDistinct("facility_id").alias("hospital_count")
    )


# -- outcome page ------------------------------------------------------------------------


def _score_by_measure(quality: DataFrame, category: str, *by: str) -> DataFrame:
    return (
        quality.where(labels.same_text("measure_category", category))
        .groupBy(*by, "measure_name")
        .agg(average("national_avg_score", 4).alias("avg_score"))
    )


def mortality_trend(quality: DataFrame) -> DataFrame:
    return _score_by_measure(quality, K.MORTALITY, "year").orderBy("year", "measure_name")


def infection_rates(quality: DataFrame, reference: float = 1.0) -> DataFrame:
    return _score_by_measure(quality, K.SAFETY).withColumn("reference", F.lit(reference))


def comparison_shares(quality: DataFrame) -> DataFrame:
    """Better, same and worse as percent of the compared rows of each measure."""
    kinds = ["better", "same", "worse"]
    sums = quality.groupBy("measure_name").agg(*[F.sum(f"hospitals_{k}").alias(k) for k in kinds])
    whole = "nullif(CAST(better + same + worse AS DOUBLE), 0D)"
    return sums.selectExpr(
        "measure_name", *[f"{rounded(f'{k} * 100D / {whole}', 4)} AS pct_{k}" for k in kinds]
    )


def peer_table(scorecard: DataFrame, order: str = LATEST_RATE, ascending: bool = True) -> DataFrame:
    key = F.col(order).asc() if ascending else F.col(order).desc()
    return scorecard.select(
        "facility_id", "facility_name", "state", "hospital_type", LATEST_RATE, "avg_excess_ratio",
        "overall_star_rating", "avg_mortality_rate", "avg_hai_sir", "pct_above_national",
        "performance_tier",
    ).orderBy(key, "facility_id")


def outcome_quadrants(scorecard: DataFrame, mortality_cut: float, hai_cut: float) -> DataFrame:
    """Mortality against infections with a flag per axis; the cuts are the caller's."""
    both = scorecard.where(
        F.col("avg_mortality_rate").isNotNull() & F.col("avg_hai_sir").isNotNull()
    )
    return both.select(
        "facility_id",
        "avg_mortality_rate",
        "avg_hai_sir",
        (F.col("avg_mortality_rate") > mortality_cut).alias("high_mortality"),
        (F.col("avg_hai_sir") > hai_cut).alias("high_hai"),
    )


# -- report measures ---------------------------------------------------------------------


def national_average(scorecard: DataFrame) -> DataFrame:
    """Average hospital rate with every slicer ignored: pass the unfiltered scorecard."""
    return scorecard.agg(average(LATEST_RATE, 4).alias("national_avg_rate"))


def with_totals(scorecard: DataFrame, *by: str) -> DataFrame:
    """Hospitals, rates and discharges by the columns, with totals over each and over all, in one pass.

    ``level`` says which columns a row adds up over: a bit each, the last column's the lowest; 0 is a
    plain group.
    """
    sets = [[]]
    for column in by:
        sets += [[*held, column] for held in sets]
    return scorecard.groupingSets([[F.col(c) for c in held] for held in sets], *by).agg(
        F.grouping_id().cast("int").alias("level"),
        rows().alias("hospital_count"),
        average(LATEST_RATE, 4).alias("avg_rate"),
        F.sum("total_discharges").alias("total_discharges"),
        F.expr(f"count_if(performance_tier = '{K.TOP}')").alias("top_performers"),
    )


def against_national(chosen: DataFrame, scorecard: DataFrame) -> DataFrame:
    """Each chosen hospital's rate minus the average over all hospitals."""
    overall = national_average(scorecard).scalar()
    return chosen.select(
        "facility_id",
        "state",
        LATEST_RATE,
        (F.col(LATEST_RATE) - overall).alias("difference_from_national"),
    )


def share_above_national(scorecard: DataFrame) -> DataFrame:
    """Share of hospitals with more than half their measures above; 0 without hospitals."""
    share = "count_if(pct_above_national > 50) / nullif(CAST(count(1) AS DOUBLE), 0D)"
    return scorecard.agg(
        F.expr(f"coalesce(CAST({rounded(share, 6)} AS DOUBLE), 0D) AS share_above")
    )


def top_performer_count(scorecard: DataFrame) -> DataFrame:
    return scorecard.agg(
        F.expr(f"count_if(performance_tier = '{K.TOP}') AS top_performers")
    )


# -- sheets ------------------------------------------------------------------------------


def state_survey_matrix(star: Star, ids=None, years=None) -> DataFrame:
    """Average answer share per state and survey measure, over the survey rows.

    ``ids`` names the columns; by default they are the survey measures of the seed, and a caller
    whose dimension holds others passes theirs. ``years`` keeps the rows of some years.
    """
    if ids is None:
        ids = sorted(seed[0] for seed in K.MEASURE_SEED if seed[2] == K.EXPERIENCE)
    rows = star.satisfaction.where("measure_key IS NOT NULL")
    if years is not None:
        rows = pick(with_end_date(rows, star.dates), year=years)
    counted = (
        rows
        .groupBy("hospital_key", "measure_key")
        .agg(F.sum("answer_percent").alias("s"), F.count("answer_percent").alias("n"))
    )
    per = (
        with_measure(counted, star, "measure_id", category=K.EXPERIENCE)
        .join(star.hospitals_with("state"), "hospital_key")
    )
    cell = F.expr("round(sum(s) / nullif(sum(n), 0), 4)")
    return per.groupBy("state").pivot("measure_id", ids).agg(cell)


def readmission_sheet(star: Star) -> DataFrame:
    """The sheet formulas as columns: rate, ratio flag, looked-up type, rating band."""
    rows = star.readmissions.select(
        "hospital_key", "measure_key", "number_of_discharges", "number_of_readmissions", EXCESS
    )
    wanted = {"hospital_type": "Not Found", "overall_rating": None}
    return lookup(rows, star.hospitals_with(*wanted), "hospital_key", wanted).select(
        "hospital_key",
        derived_rate("number_of_readmissions", "number_of_discharges").alias(RATE),
        labels.ratio_flag(EXCESS).alias("ratio_flag"),
        "hospital_type",
        labels.rating_band("overall_rating").alias("rating_band"),
    )
