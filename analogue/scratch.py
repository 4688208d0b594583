"""Files that registered queries write and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session may go without that setting."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="caregauge-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/query-{uuid.uuid4().hex}"


def delivered(staged: DataFrame, place: str, headers: dict[str, str] | None = None) -> str:
    """Staged text as CSV files with a header line, spaces and all; returns the folder."""
    named = staged.withColumnsRenamed(headers or {})
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    named.write.mode("append").options(header=True, quote='"', escape='"', **spaces).csv(place)
    return place
