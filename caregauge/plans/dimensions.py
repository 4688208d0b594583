"""Dimension loads: measures and hospitals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.latest import latest_per_key
from ..operators.lookups import missing_from
from ..sources.generated import measure_seed

HOSPITAL_COLUMNS = [
    "hospital_key",
    "facility_id",
    "facility_name",
    "city",
    "state",
    "zip_code",
    "county_name",
    "hospital_type",
    "hospital_ownership",
    "emergency_services",
    "overall_rating",
    "mortality_group",
    "safety_group",
    "readmission_group",
    "patient_exp_group",
    "created_at",
    "updated_at",
]
# The only columns a later delivery changes in a known hospital.
REFRESHED = [
    "facility_name", "overall_rating", "readmission_group", "patient_exp_group", "updated_at",
]


def load_measures(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """The measure dimension: the existing rows plus the seeds not among them, case ignored."""
    seed = measure_seed(spark).withColumn("measure_key", F.xxhash64("measure_id"))
    if existing is None:
        return seed
    # 25 seeds against a dimension: the seed side is the one to send around
    ids = existing.select(clean.code("measure_id").alias("measure_id"))
    known = ids.join(F.broadcast(seed.select("measure_id")), "measure_id", "left_semi")
    return existing.unionByName(missing_from(seed, known, "measure_id"))


def clean_hospitals(staging: DataFrame) -> DataFrame:
    """One cleaned row per facility id, from its latest delivery; blank ids drop out.

    Ids that differ in case alone are one hospital; the key is formed from the upper-case
    id, the id itself stays as last delivered.
    """
    columns = [
        "facility_id",
        "facility_name", "city", "state", "zip_code", "county_name", "hospital_type",
        "hospital_ownership", "emergency_services", "hospital_overall_rating",
        "mortality_group", "safety_group", "readmission_group", "patient_exp_group",
    ]
    latest = latest_per_key(
        staging.where(clean.not_blank("facility_id")),
        "upper(trim(facility_id))",
        "raw_load_ts",
        columns,
    )
    now = F.current_timestamp()
    return latest.select(
        F.xxhash64("key").alias("hospital_key"),
        F.trim("facility_id").alias("facility_id"),
        F.trim("facility_name").alias("facility_name"),
        clean.sentence_case("city").alias("city"),
        clean.code("state").alias("state"),
        F.trim("zip_code").alias("zip_code"),
        clean.sentence_case("county_name").alias("county_name"),
        F.trim("hospital_type").alias("hospital_type"),
        F.trim("hospital_ownership").alias("hospital_ownership"),
        clean.yes_flag("emergency_services").alias("emergency_services"),
        F.col("hospital_overall_rating").alias("overall_rating"),
        *[F.trim(c).alias(c) for c in columns[-4:]],
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def insert_hospitals(staging: DataFrame, existing: DataFrame) -> DataFrame:
    """The hospitals of a delivery that the dimension does not hold, by id, case ignored."""
    held = existing.select(clean.code("facility_id").alias("_id"))
    new = clean_hospitals(staging).withColumn("_id", clean.code("facility_id"))
    return missing_from(new, held, "_id").select(HOSPITAL_COLUMNS)


def upsert_hospitals(staging: DataFrame, existing: DataFrame) -> DataFrame:
    """Next snapshot of the dimension after a delivery.

    Known hospitals take over four columns and the update time, unknown ones are added,
    the others stay. Both sides are unique per facility, so one full join does it all.
    """
    new, old = clean_hospitals(staging).alias("new"), existing.alias("old")
    both = old.join(new, F.expr("upper(trim(old.facility_id)) = upper(trim(new.facility_id))"), "full_outer")

    def next_value(c: str) -> str:
        first, other = ("new", "old") if c in REFRESHED else ("old", "new")
        return f"CASE WHEN {first}.facility_id IS NOT NULL THEN {first}.{c} ELSE {other}.{c} END AS {c}"

    return both.selectExpr(*[next_value(c) for c in HOSPITAL_COLUMNS])
