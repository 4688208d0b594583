"""Writing frames as tables, views and report files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """(Re)creates a parquet table. The target must not be one of the sources."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def with_year(df: DataFrame) -> DataFrame:
    """With ``end_year``, by which facts are partitioned; NULL without an end date."""
    return df.withColumn("end_year", F.floor(F.col("end_date_key") / 10000).cast("int"))


def _by_year(df: DataFrame) -> DataFrame:
    """With ``end_year``, the rows of a year together in files of the advisory size, each in the
    order of its hospitals.

    The rebalancing splits a large year over tasks and merges small ones.
    """
    order = [c for c in ("end_year", "hospital_key") if c == "end_year" or c in df.columns]
    return with_year(df).hint("rebalance", "end_year").sortWithinPartitions(*order)


# One hospital's rows are found without reading the rest: pages in the order of hospitals,
# their bounds in the page index, and a Bloom filter that says that a row group has no row of it.
FACT_LAYOUT = {
    "parquet.block.size": 32 << 20,
    "parquet.page.row.count.limit": 4_000,
    "parquet.bloom.filter.enabled#hospital_key": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def write_fact(df: DataFrame, path: str) -> None:
    """A fact partitioned by end-date year, which prunes every latest-year query, each file in the
    order of its hospitals, which prunes look-ups of one.

    A row without an end date goes to the default partition.
    """
    _by_year(df).write.mode("overwrite").options(**FACT_LAYOUT).partitionBy("end_year").parquet(path)


def append_fact(df: DataFrame, path: str) -> None:
    """More rows of a fact written by ``write_fact``, in the same partitions."""
    _by_year(df).write.mode("append").options(**FACT_LAYOUT).partitionBy("end_year").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str], **options: object) -> None:
    """The partitions that ``df`` has rows of are replaced by these; files of others stay as they are."""
    df.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy(*by).parquet(path)


def replace_years(df: DataFrame, path: str, row_key: str) -> None:
    """The years of a fact that ``df`` has rows of are replaced by these rows; files of other years
    stay as they are.

    Each file holds a range of hospitals of a year, so that a look-up opens one file a year;
    ``row_key`` splits a hospital with very many rows over several. Ranges are found by a sample, so
    ``df`` should be read from files. It must not be made from the years it replaces.
    """
    ordered = ("end_year", "hospital_key", row_key)
    ranged = with_year(df).repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    replace_partitions(ranged, path, ["end_year"], **FACT_LAYOUT)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Appends; ``partition_by`` must be that of the table, or readers miss the new files."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_absent(
    df: DataFrame, path: str, key: Sequence[str], partition_by: Sequence[str] = ()
) -> None:
    """Appends the rows whose key the table does not hold yet; safe to repeat.

    Keys compare NULL-safe, and a key new to the table is taken once. Where the partition columns
    are part of the key, only the partitions that ``df`` has rows of are looked into. ``df`` is read for
    its keys and for its rows, so it should be cheap to read twice.
    """
    held = df.sparkSession.read.parquet(path)
    if partition_by and set(partition_by) <= set(key):
        wanted = [[F.col(c).eqNullSafe(F.lit(v)) for c, v in row.asDict().items()] for row in df.select(*partition_by).distinct().collect()]
        either = [reduce(and_, one) for one in wanted]
        held = held.where(reduce(or_, either, F.lit(False)))
    # keys alone are compared, by one aggregate; only rows of absent keys are moved whole
    keys = df.select(*key, F.lit(False).alias("_held")).unionByName(held.select(*key, F.lit(True).alias("_held")))
    absent = keys.groupBy(*key).agg(F.bool_or("_held").alias("_held")).where("NOT _held")
    absent = absent.select(*[F.col(c).alias(f"_{c}") for c in key]).persist()
    try:
        if absent.count():
            same = [df[c].eqNullSafe(F.col(f"_{c}")) for c in key]
            append_rows(df.join(absent, same, "left_semi").dropDuplicates(list(key)), path, partition_by)
    finally:
        absent.unpersist()


def create_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def materialise(df: DataFrame, table: str, partition_by: Sequence[str] = ("state",)) -> DataFrame:
    """Saves a view as a managed table, replacing an earlier one; call again to refresh."""
    df.write.mode("overwrite").partitionBy(*partition_by).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def export_reports(views: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One file set per report table; each is written by all tasks in parallel."""
    for name, df in views.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{folder}/{name}")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """A managed table in ``buckets`` buckets of ``key``, replacing an earlier one: joins and
    aggregates by the key of tables with as many buckets need no shuffle.

    One task reads a bucket, so that no key should have very many rows; rows are dealt once, and a
    partition has one file a bucket.
    """
    dealt = df.repartition(buckets, key).sortWithinPartitions(*partition_by, key)
    writer = dealt.write.mode("overwrite").partitionBy(*partition_by).bucketBy(buckets, key).sortBy(key)
    writer.format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def replace_bucketed(df: DataFrame, table: str, key: str, buckets: int, by: str, values: Sequence[int]) -> None:
    """The partitions of a table of ``save_bucketed`` with these values of ``by`` are replaced by the
    rows of ``df`` that have them; files of others stay as they are. ``buckets`` are the table's.

    One insert a value, none of which is NULL: it names its partition, so that the session's overwrite
    mode does not matter.
    """
    held = [c for c in df.sparkSession.table(table).columns if c != by]
    for value in values:
        dealt = df.where(F.col(by) == value).select(held).repartition(buckets, key).sortWithinPartitions(key)
        df.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({by} = {value}) SELECT * FROM {{rows}}", rows=dealt)
