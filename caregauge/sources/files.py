"""Delivered CSV files as staging frames."""

from __future__ import annotations

import csv
import re
from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..schemas import HEADER_NAMES

CORRUPT = "_corrupt_record"


# Standard quoting: a quote inside a quoted text is doubled, a backslash is a letter. A line
# break ends a line even inside quotes, so that large files are read by many tasks;
# ``multi_line`` reads such texts whole, one task per file.
QUOTING = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _load_time(delivered_at: str | None) -> Column:
    """The delivery's time: as given, or that of each file."""
    if delivered_at is None:
        return F.col("_metadata.file_modification_time")
    return F.lit(delivered_at).cast("timestamp")


def first_lines(spark: SparkSession, path) -> DataFrame:
    """Rows (file, line): the first line of each file that is not blank.

    A task takes a file whole and stops after its first lines, whatever the file's size. This
    needs reading of files in another way than data, hence a session of its own (of the same
    application).
    """
    apart = spark.newSession()
    whole = str(1 << 40)
    for key, value in {
        "spark.sql.files.maxPartitionBytes": whole,
        "spark.sql.files.openCostInBytes": whole,
        "spark.sql.execution.arrow.maxRecordsPerBatch": "16",
    }.items():
        apart.conf.set(key, value)
    lines = apart.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))

    def first(batches):
        for batch in batches:
            for at, line in enumerate(batch.column("line").to_pylist()):
                if line.strip():
                    yield batch.slice(at, 1)
                    return

    return lines.mapInArrow(first, "file string, line string")


def header_columns(line: str, schema: StructType) -> list[str]:
    """Staging names of a header line's columns, in its order."""
    names = [staging_name(c) for c in next(csv.reader([line.removeprefix("\ufeff")]))]
    twice = [n for n, k in Counter(names).items() if k > 1 and n in schema.names]
    if twice:
        raise ValueError(f"the header names {', '.join(twice)} more than once: {line[:200]}")
    if schema.names[0] not in names:
        raise ValueError(f"no {schema.names[0]} in the header: {line[:200]}")
    # columns that staging does not have may have any name, even none
    return [n if n in schema.names else f"_other_{k}" for k, n in enumerate(names)]


def no_rows(spark: SparkSession, schema: StructType, *more: StructField) -> DataFrame:
    """A delivery without rows."""
    return spark.createDataFrame([], StructType([*schema.fields, *more, StructField("raw_load_ts", TimestampType())]))


def read_staging(
    spark: SparkSession,
    path,
    schema: StructType,
    keep_corrupt: bool = False,
    by_name: bool = False,
    delivered_at: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files with one header line each, plus raw_load_ts.

    Columns are taken by position or, ``by_name``, by each file's own header: files are read in
    groups of equal headers, so that a folder may hold deliveries whose columns differ in
    order or number. A column that a file lacks is NULL, one that staging lacks is left out;
    a header without the facility's id, or with a column twice, raises.

    Lines of another width than the schema (by name: than their file's header) are read as far as they
    go; ``keep_corrupt`` adds their text in ``_corrupt_record``. The load time is that of each
    file, unless ``delivered_at`` names one.
    """
    reader = spark.read.options(**QUOTING, multiLine=multi_line, header=True, enforceSchema=True)
    if keep_corrupt:
        reader = reader.option("columnPruning", False)  # else only the columns used are looked at
    corrupt = [StructField(CORRUPT, StringType())] if keep_corrupt else []
    if not by_name:
        df = reader.schema(StructType(schema.fields + corrupt)).csv(path)
        return df.withColumn("raw_load_ts", _load_time(delivered_at))
    files: dict[str, list[str]] = {}
    for row in first_lines(spark, path).collect():  # as many as Spark lists files on the driver
        files.setdefault(row["line"], []).append(unquote(row["file"]))
    parts = []
    for line, of_line in sorted(files.items()):
        text = [StructField(c, StringType()) for c in header_columns(line, schema)]
        raw = reader.schema(StructType(text + corrupt)).csv(sorted(of_line))
        kept = [F.col(CORRUPT)] if keep_corrupt else []
        raw = raw.withColumn("_load_time", _load_time(delivered_at))
        parts.append(_renamed(raw, schema, [*kept, F.col("_load_time").alias("raw_load_ts")]))
    if not parts:
        return no_rows(spark, schema, *corrupt)
    return reduce(DataFrame.unionByName, parts)


def parse_lines(lines: DataFrame, line: str, schema: StructType) -> DataFrame:
    """Lines of text (without the header line) as staging columns, by the reader's rules."""
    fields = StructType(schema.fields + [StructField(CORRUPT, StringType())])
    return lines.select(F.from_csv(F.col(line), fields.toDDL(), QUOTING).alias("row")).select("row.*")


def staging_name(header: str) -> str:
    """Staging column of a file header."""
    known = HEADER_NAMES.get(header.strip())
    return known or re.sub(r"[^a-z0-9]+", "_", header.strip().lower()).strip("_")


def rename_headers(df: DataFrame, schema: StructType) -> DataFrame:
    """Text columns with file headers, in any order, as the staging columns.

    A column the file lacks is NULL; a column the staging table lacks is dropped.
    """
    return _renamed(df, schema, [])


def _renamed(df: DataFrame, schema: StructType, more: list[Column]) -> DataFrame:
    found = {staging_name(c): c for c in df.columns}
    return df.select(
        *[
            F.col(f"`{found[f.name]}`").try_cast(f.dataType).alias(f.name)
            if f.name in found
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *more,
    )
