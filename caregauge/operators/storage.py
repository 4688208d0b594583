"""The size of a plan's sources, and session settings."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_SIZE = 1 << 62


def source_bytes(df: DataFrame) -> int:
    """Bytes of everything the plan reads, by Spark's own statistics.

    A source of unknown size counts as very large.
    """
    if not hasattr(df, "_jdf"):  # a remote session shows no plan
        return UNKNOWN_SIZE
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


# A side whose source files are no larger than this may be sent to every task.
BROADCAST_LIMIT = 16 * 1024 * 1024


def sent_if_small(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if its sources are small, else as it is.

    Spark's own estimate multiplies the sides of joins below and so misses small
    dimensions; a larger one is left to a shuffled join, which splits hot keys.
    """
    return F.broadcast(df) if source_bytes(df) <= BROADCAST_LIMIT else df


# Session settings the operators count on: adaptive plans that split hot keys, and stages whose
# generated method is too long for the JVM to compile (8,000 bytes; it would be interpreted row by
# row) run by operator instead.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets SETTINGS in a session of the caller's own."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def advise(spark: SparkSession) -> None:
    """Warns of settings that differ from SETTINGS; changes none."""
    other = [f"{k}={v}" for k, v in SETTINGS.items() if spark.conf.get(k) != v]
    if other:
        warnings.warn(f"this session should have {', '.join(other)} (see storage.configure)", stacklevel=3)
