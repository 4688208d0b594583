"""Fact loads from staging text.

Surrogate keys are hashes of the business keys, so a load needs no lookup to find the
hospital's key, only the check that the hospital exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import clean
from ..functions.calendar import date_key
from ..functions.labels import keyword_label
from ..operators.storage import sent_if_small


def _loaded(
    staging: DataFrame,
    hospitals: DataFrame,
    measures: DataFrame,
    measure_id: Column,
    key: str,
    numbers: dict[str, Column],
    delivered: str,
) -> DataFrame:
    """Cleaned rows of known hospitals with keys, surrogate key and load time.

    Rows are cleaned and find their measure before they meet the hospitals, so that a
    shuffled join moves narrow typed columns instead of delivered text. A hospital with
    very many rows is split there by the adaptive skew join.

    Ids match whatever their case. An unknown measure leaves a NULL key; ``unknown_measure`` then
    is a hash of what the column ``delivered`` calls it. The surrogate key is a hash of the row,
    so that equal delivered rows share it.
    """
    clean_rows = staging.where(clean.not_blank("facility_id")).select(
        clean.code("facility_id").alias("_facility"),
        F.upper(measure_id).alias("_measure"),
        F.xxhash64(clean.code(delivered)).alias("_delivered"),
        *[clean.us_date(d).alias(d) for d in ("start_date", "end_date")],
        *[c.alias(n) for n, c in numbers.items()],
    )
    known_measures = sent_if_small(measures.selectExpr("measure_key", "upper(trim(measure_id)) AS _measure"))
    known_hospitals = sent_if_small(hospitals.selectExpr("hospital_key", "upper(trim(facility_id)) AS _facility"))
    out = (
        clean_rows.join(known_measures, "_measure", "left")
        .join(known_hospitals, "_facility")
        .select(
            "hospital_key",
            "measure_key",
            F.when(F.col("measure_key").isNull(), F.col("_delivered")).alias("unknown_measure"),
            *[date_key(d).alias(f"{d}_key") for d in ("start_date", "end_date")],
            *numbers,
        )
    )
    return out.select(
        F.xxhash64(*out.columns).alias(key), "*", F.current_timestamp().alias("created_at")
    )


def load_readmissions(
    staging: DataFrame, hospitals: DataFrame, measures: DataFrame, match_ids: bool = False
) -> DataFrame:
    """Readmission fact; rows without a usable number of discharges are not loaded.

    The measure follows from keywords in its delivered name. ``match_ids`` tries the
    name as a measure id first, which the delivered samples would need.
    """
    named = staging.withColumn("_name", F.lower("measure_name"))
    measure_id = keyword_label("_name", K.MEASURE_ID_RULES, None, lowered=True)
    if match_ids:
        ids = [seed[0] for seed in K.MEASURE_SEED if seed[2] == K.READMISSION]
        own = clean.code("measure_name")
        measure_id = F.when(own.isin(ids), own).otherwise(measure_id)
    rate = "decimal(8,4)"
    numbers = {
        "number_of_discharges": clean.number("number_of_discharges", "int"),
        "number_of_readmissions": clean.number("number_of_readmissions", "int"),
        "predicted_readmission_rate": clean.number("predicted_readmission_rate", rate),
        "expected_readmission_rate": clean.number("expected_readmission_rate", rate),
        "excess_readmission_ratio": clean.number("excess_readmission_ratio", rate),
    }
    loaded = _loaded(
        named.where(numbers["number_of_discharges"].isNotNull()),
        hospitals, measures, measure_id, "readmission_key", numbers, "measure_name",
    )
    derived = clean.derived_rate("number_of_readmissions", "number_of_discharges")
    return loaded.withColumn("readmission_rate_pct", derived)


def load_satisfaction(staging: DataFrame, hospitals: DataFrame, measures: DataFrame) -> DataFrame:
    """Survey fact; rows keep their place when all their numbers are suppressed."""
    return _loaded(
        staging.where("hcahps_measure_id IS NOT NULL"),
        hospitals,
        measures,
        F.trim("hcahps_measure_id"),
        "satisfaction_key",
        {
            "star_rating": clean.number("patient_survey_star_rating", "decimal(3,1)"),
            "answer_percent": clean.number("hcahps_answer_percent", "decimal(5,2)"),
            "completed_surveys": clean.number("number_of_completed_surveys", "int"),
            "response_rate_pct": clean.number("survey_response_rate_percent", "decimal(5,2)"),
        },
        "hcahps_measure_id",
    )


def load_quality(staging: DataFrame, hospitals: DataFrame, measures: DataFrame) -> DataFrame:
    """Quality fact; a suppressed score is NULL and its comparison label stays."""
    return _loaded(
        staging.where("measure_id IS NOT NULL"),
        hospitals,
        measures,
        F.trim("measure_id"),
        "quality_key",
        {
            "condition": F.trim("condition"),
            "score": clean.number("score", "decimal(10,4)"),
            "lower_estimate": clean.number("lower_estimate", "decimal(10,4)"),
            "higher_estimate": clean.number("higher_estimate", "decimal(10,4)"),
            "denominator": clean.number("denominator", "int"),
            "compared_to_national": F.trim("compared_to_national"),
        },
        "measure_id",
    )


# What tells a delivered row from another: hospital, measure (an unknown one by what it was
# called) and period.
NATURAL_KEY = ("hospital_key", "measure_key", "unknown_measure", "start_date_key", "end_date_key")


def _same_key(other: str = "_") -> Column:
    return F.expr(" AND ".join(f"{c} <=> {other}{c}" for c in NATURAL_KEY))


def carried_on(earlier: DataFrame, delivered: DataFrame) -> DataFrame:
    """The earlier rows of a fact and those of a new delivery.

    Where the delivery has rows for a hospital, measure and period, they take the place of
    the earlier ones, so that a correction replaces what it corrects and a repeated delivery
    changes nothing. All rows of one delivery stay. NULL keys match each other; unknown measures
    match by what the deliveries call them.
    """
    new = delivered.select(*[F.col(c).alias(f"_{c}") for c in NATURAL_KEY]).distinct()
    kept = earlier.select(delivered.columns).join(new, _same_key(), "left_anti")
    return kept.unionByName(delivered)


def changed_keys(earlier: DataFrame, delivered: DataFrame, row_key: str) -> DataFrame:
    """Natural keys, each with an underscore before its name, whose delivered rows differ from the earlier ones.

    Rows are compared by their surrogate key, a hash of all their columns: by number and sum for
    each natural key, so that a key with very many rows is combined before it moves. Both sides go
    through one aggregate, which moves each key once and needs no join.
    """
    both = None
    for fact, sign in ((delivered, 1), (earlier, -1)):
        signed = (F.col(row_key).cast("decimal(20,0)") * sign).cast("decimal(20,0)").alias("_hash")
        side = fact.select(*NATURAL_KEY, F.lit(sign).alias("_sign"), signed)
        both = side if both is None else both.unionByName(side)
    compared = both.groupBy(*NATURAL_KEY).agg(
        F.count_if(F.col("_sign") == 1).alias("new_rows"), F.sum("_sign").alias("more"), F.sum("_hash").alias("differs")
    )
    changed = compared.where("new_rows > 0 AND (more != 0 OR differs != 0)")
    return changed.select(*[F.col(c).alias(f"_{c}") for c in NATURAL_KEY])


def with_changes(earlier: DataFrame, delivered: DataFrame, changed: DataFrame) -> DataFrame:
    """The earlier rows with those of the changed keys replaced by the delivered ones."""
    kept = earlier.join(changed, _same_key(), "left_anti")
    return kept.unionByName(delivered.join(changed, _same_key(), "left_semi").select(kept.columns))
