"""Distinct hospitals that add up: bitmaps of numbered hospitals, merged for any choice of slicers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.latest import with_end_date
from ..operators.lookups import pick
from ..schemas import Star
from .performance import with_measure

# Numbers that Spark's bitmap functions keep in one bitmap, and how many of them are given on average.
BITS, FILLED = 32_768, 16_384


def numbered(hospitals: DataFrame) -> DataFrame:
    """Rows (hospital_key, number): a number from 1 for each different key, dense enough for bitmaps.

    Keys are dealt over buckets by their hash and numbered within; more than ``BITS`` keys in a bucket,
    twice the mean, raise.
    """
    keys = hospitals.select("hospital_key").distinct()
    buckets = keys.count() // FILLED + 1
    bucket = F.pmod(F.xxhash64("hospital_key", F.lit("number")), F.lit(buckets))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("hospital_key"))
    number = F.col("bucket") * BITS + F.when(F.col("n") <= BITS, F.col("n")).otherwise(
        F.raise_error(F.lit("too many hospitals for one bitmap")).cast("int")
    )
    return keys.withColumn("bucket", bucket).withColumn("n", within).select("hospital_key", number.alias("number"))


def hospital_bitmaps(fact: DataFrame, star: Star, numbers: DataFrame | None = None) -> DataFrame:
    """Per year, measure, state, type and bucket, the bitmap of the hospitals with rows of a fact.

    Rows whose measure is unknown are left out, as in the views. The fact is reduced to distinct
    (hospital, year, measure) first. Save the result: any slicers are then counted from it by
    ``distinct_hospitals``, without the fact. ``numbers`` must be the same for bitmaps that are merged.
    """
    rows = with_end_date(fact.where("measure_key IS NOT NULL"), star.dates).select("hospital_key", "year", "measure_key")
    known = with_measure(rows.distinct(), star, "measure_id", "measure_category")
    placed = known.join(star.hospitals_with("state", "hospital_type"), "hospital_key")
    counted = placed.join(numbered(star.hospitals) if numbers is None else numbers, "hospital_key")
    return counted.groupBy(
        "year", "measure_id", "measure_category", "state", "hospital_type", F.bitmap_bucket_number("number").alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("hospitals"))


def distinct_hospitals(bitmaps: DataFrame, *by: str, **choices) -> DataFrame:
    """Different hospitals per ``by`` for the chosen slicers, by merging bitmaps."""
    merged = pick(bitmaps, **choices).groupBy(*by, "bucket").agg(F.bitmap_or_agg("hospitals").alias("hospitals"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("hospitals")).alias("hospital_count"))
