"""Volume and utilisation queries. Rows without discharges stay out of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.clean import percent, ratio
from ..functions.labels import keyword_label, volume_tier
from ..operators.aggregates import mean, partials, rows, total
from ..operators.growth import year_over_year
from ..operators.latest import with_end_date
from ..operators.lookups import present_in
from ..operators.ranks import BUCKETS, percent_rank
from ..schemas import Star
from .performance import EXCESS, RATE

VOLUMES = {
    "discharges": "number_of_discharges",
    "readmissions": "number_of_readmissions",
    "rate": RATE,
    "excess": EXCESS,
}


def dated_volumes(star: Star, *columns: str) -> DataFrame:
    counted = star.readmissions.where("number_of_discharges IS NOT NULL")
    return with_end_date(counted, star.dates, *columns)


def categorised(star: Star, rules) -> DataFrame:
    """Measures with their clinical category: the rules run once per measure, not per row."""
    return star.measures.select(
        "measure_key",
        "measure_id",
        "measure_name",
        keyword_label("measure_name", rules).alias("clinical_category"),
    )


def discharge_volume(star: Star) -> DataFrame:
    """Per year, state and type. The average is per fact row, whatever its name says."""
    per = dated_volumes(star).groupBy("hospital_key", "year").agg(*partials(VOLUMES))
    return (
        per.join(star.hospitals_with("state", "hospital_type"), "hospital_key")
        .groupBy("year", "state", "hospital_type")
        .agg(
            rows().alias("hospital_count"),
            total("discharges").alias("total_discharges"),
            F.expr("round(CAST(sum(discharges_sum) AS DECIMAL(20,4)) / sum(discharges_cnt), 0)").alias(
                "avg_discharges_per_hospital"
            ),
            total("readmissions").alias("total_readmissions"),
        )
        .orderBy("year", "state", "hospital_type")
    )


def volume_growth(star: Star) -> DataFrame:
    """Discharges per hospital and year against the year before."""
    annual = (
        dated_volumes(star)
        .groupBy("hospital_key", F.col("year").alias("current_year"))
        .agg(F.sum("number_of_discharges").alias("current_discharges"))
    )
    grown = year_over_year(annual, ["hospital_key"], "current_year", "current_discharges")
    who = ["facility_id", "facility_name", "state"]
    return (
        grown.join(star.hospitals_with(*who), "hospital_key")
        .select(*who, *grown.columns[1:])
        .orderBy(F.desc("current_year"), F.desc("yoy_growth_pct"), "facility_id")
    )


def volume_by_category(star: Star, rules=K.CATEGORY_RULES) -> DataFrame:
    """Per year, clinical category and state; ``rules`` may be the corrected list."""
    per = (
        dated_volumes(star)
        .join(star.side("measures", categorised(star, rules)), "measure_key")
        .groupBy("hospital_key", "year", "clinical_category")
        .agg(*partials(VOLUMES))
    )
    return (
        per.join(star.hospitals_with("state"), "hospital_key")
        .groupBy("year", "clinical_category", "state")
        .agg(
            rows().alias("hospital_count"),
            total("discharges").alias("total_discharges"),
            total("readmissions").alias("total_readmissions"),
            mean("rate", 2).alias("avg_readmission_pct"),
        )
        .orderBy("year", F.desc("total_discharges"), "clinical_category", "state")
    )


def utilization_intensity(star: Star, buckets: int = BUCKETS) -> DataFrame:
    """Density, readmission share, volume tier and percentile per hospital and year.

    Percentile 0 is the hospital with the smallest share of readmissions.
    """
    # per measure first, so that a hospital's measures are counted without a distinct
    volumes = {k: VOLUMES[k] for k in ("discharges", "readmissions")}
    measured = (
        dated_volumes(star)
        .where("measure_key IS NOT NULL")
        .groupBy("hospital_key", "year", "measure_key")
        .agg(*partials(volumes))
        .join(star.side("measures", star.measures.select("measure_key")), "measure_key", "left_semi")
    )
    per = measured.groupBy("hospital_key", "year").agg(
        total("discharges").alias("total_discharges"),
        rows().alias("conditions_tracked"),
        total("readmissions").alias("total_readmissions"),
    )
    per = present_in(per, star.hospitals_with(), "hospital_key")
    per = per.withColumn("_share", ratio("total_readmissions", "total_discharges"))
    ranked = percent_rank(per, ["year"], "_share", "efficiency_percentile", buckets=buckets)
    who = ["facility_id", "facility_name", "city", "state", "hospital_type"]
    return (
        ranked.join(star.hospitals_with(*who), "hospital_key")
        .select(
            *who,
            "year",
            "total_discharges",
            "conditions_tracked",
            "total_readmissions",
            F.round(ratio("total_discharges", "conditions_tracked"), 0).alias("discharge_density"),
            percent("total_readmissions", "total_discharges", 2).alias("overall_readmit_pct"),
            volume_tier("total_discharges").alias("volume_tier"),
            "efficiency_percentile",
        )
        .orderBy(F.desc("year"), F.desc("total_discharges"), "facility_id")
    )


def readmission_burden(
    star: Star, bed_days=K.BED_DAYS_PER_READMISSION, buckets: int = BUCKETS
) -> DataFrame:
    """Estimated bed-days per hospital, year and distinct rate, ranked by the rate."""
    per = (
        dated_volumes(star)
        .groupBy("hospital_key", "year", RATE)
        .agg(
            F.sum("number_of_discharges").alias("total_discharges"),
            F.sum("number_of_readmissions").alias("total_readmissions"),
        )
    )
    per = present_in(per, star.hospitals_with(), "hospital_key")
    ranked = percent_rank(per, ["year"], RATE, "efficiency_percentile", buckets=buckets)
    who = ["facility_id", "facility_name", "state"]
    return (
        ranked.join(star.hospitals_with(*who), "hospital_key")
        .select(
            *who,
            "year",
            "total_discharges",
            "total_readmissions",
            F.round(RATE, 2).alias("avg_readmission_pct"),
            F.expr(f"round(total_readmissions * {bed_days}, 0)").alias("est_readmission_bed_days"),
            "efficiency_percentile",
        )
        .orderBy(F.desc("year"), F.desc("avg_readmission_pct"), "facility_id")
    )
