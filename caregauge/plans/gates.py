"""Gates of a load: what must hold before loaded tables take the place of the current ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.clean import code
from ..schemas import Star
from .audits import broken_references


class LoadRefused(ValueError):
    """A load that would break a key; ``broken`` says which and how often."""

    def __init__(self, broken: Mapping[str, int]):
        self.broken = dict(broken)
        super().__init__("; ".join(f"{what}: {n}" for what, n in sorted(broken.items())))


def collisions(hospitals: DataFrame, measures: DataFrame) -> dict[str, int]:
    """Surplus and missing keys of the dimensions: ids and surrogate keys are to be unique, ids
    whatever their case."""
    found = {}
    for table, df, key, name in (
        ("dim_hospital", hospitals, "hospital_key", "facility_id"),
        ("dim_measure", measures, "measure_key", "measure_id"),
    ):
        for column, value in ((key, F.col(key)), (name, code(name))):
            counted = df.groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("n"))
            row = counted.agg(
                F.expr("coalesce(sum(CASE WHEN k IS NULL THEN n ELSE n - 1 END), 0)").alias("n")
            ).first()
            if row["n"]:
                found[f"{table}.{column} not unique"] = row["n"]
    return found


def dangling(star: Star) -> dict[str, int]:
    """Fact rows whose hospital, measure or date is missing from its dimension."""
    rows = broken_references(star).where("row_count > 0").collect()  # twelve at most
    return {f"{r['table_name']}.{r['key_name']} unknown": r["row_count"] for r in rows}


def refuse(broken: Mapping[str, int]) -> None:
    if broken:
        raise LoadRefused(broken)


def observed(fact: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """A fact whose write also tells rows, rows without hospital and unknown measures, and the first and last day."""
    seen = Observation(name)
    low, high = F.least("start_date_key", "end_date_key"), F.greatest("start_date_key", "end_date_key")
    watched = fact.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("hospital_key").isNull()).alias("no_hospital"),
        F.count_if(F.col("measure_key").isNull()).alias("no_measure"),
        F.min(low).alias("first_day"),
        F.max(high).alias("last_day"),
    )
    return watched, seen
