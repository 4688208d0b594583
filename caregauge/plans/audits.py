"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import code, not_blank
from ..operators.lookups import missing_from
from ..schemas import Star
from ..sources.files import CORRUPT


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _labelled(df: DataFrame, column: str, label: str, count: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(count)).select(F.lit(label).alias(column), count)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counted = [_labelled(df, "table_name", name, "row_count") for name, df in tables.items()]
    return _stack(counted).orderBy("table_name")


def star_row_counts(star: Star) -> DataFrame:
    return row_counts(
        {
            "dim_hospital": star.hospitals,
            "fact_readmissions": star.readmissions,
            "fact_patient_satisfaction": star.satisfaction,
            "fact_quality_metrics": star.quality,
        }
    )


def load_audit(staging: DataFrame, hospitals: DataFrame, fact: DataFrame) -> DataFrame:
    """Delivered readmission rows without a hospital, and loaded ones without a measure."""
    ids = staging.where(not_blank("facility_id")).select(
        code("facility_id").alias("facility_id")
    )
    hospitals = hospitals.select(code("facility_id").alias("facility_id"))
    # counted per id before the join: a hot id joins as one row
    per_id = ids.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    unmatched = missing_from(per_id, hospitals, "facility_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cnt")
    )
    return unmatched.select(F.lit("readmissions with no hospital match").alias("issue"), "cnt").unionByName(
        _labelled(
            fact.where(F.col("measure_key").isNull()), "issue",
            "readmissions with no measure match", "cnt",
        )
    )


def corrupt_lines(staging: DataFrame, delivery: str) -> DataFrame:
    """Delivered lines, and those of another width than the header, which are not loaded.

    Takes staging read with its corrupt lines.
    """
    first = staging.columns[0]  # a column must be read beside the lines' text
    return staging.agg(
        F.expr(f"count({first}) + count_if({first} IS NULL)").alias("line_count"),
        F.expr(f"count_if({CORRUPT} IS NOT NULL)").alias("corrupt_count"),
    ).select(F.lit(delivery).alias("delivery"), "line_count", "corrupt_count")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def broken_references(star: Star) -> DataFrame:
    """Rows per fact and key whose value is set but missing from its dimension.

    Each fact is read once: its keys become rows, are counted per value (so that no
    fact row travels to the join), and are looked for among all dimensions' keys.
    """
    facts = {
        "fact_readmissions": star.readmissions,
        "fact_patient_satisfaction": star.satisfaction,
        "fact_quality_metrics": star.quality,
    }
    keys = ["hospital_key", "measure_key", "start_date_key", "end_date_key"]
    used = _stack(
        [
            fact.selectExpr(*[f"CAST({k} AS BIGINT) AS {k}" for k in keys])
            .unpivot([], keys, "key_name", "key_value")
            .where("key_value IS NOT NULL")
            .groupBy("key_name", "key_value")
            .agg(F.expr("count(1) AS n"))
            .selectExpr(f"'{name}' AS table_name", "*")
            for name, fact in facts.items()
        ]
    )
    known = _stack(
        [
            dimension.selectExpr(f"'{key}' AS key_name", f"CAST({column} AS BIGINT) AS key_value")
            for key, dimension, column in (
                ("hospital_key", star.hospitals, "hospital_key"),
                ("measure_key", star.measures, "measure_key"),
                ("start_date_key", star.dates, "date_key"),
                ("end_date_key", star.dates, "date_key"),
            )
        ]
    )
    lost = used.join(known, ["key_name", "key_value"], "left_anti")
    counts = lost.groupBy("table_name", "key_name").agg(F.sum("n").alias("n"))
    # twelve rows: one per fact and key
    every = star.dates.sparkSession.sql(
        "SELECT * FROM VALUES "
        + ", ".join(f"('{f}', '{k}')" for f in facts for k in keys)
        + " AS every(table_name, key_name)"
    )
    return every.join(counts, ["table_name", "key_name"], "left").selectExpr(
        "table_name", "key_name", "coalesce(n, 0) AS row_count"
    )
