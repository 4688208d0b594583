"""Tables written once in the shared folder, and bounded slices of Arrow batches."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the session names in ``spark.checkpoint.dir``.

    Only a local session (as in tests) that names none gets a folder of its own.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="caregauge-llm-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: object) -> DataFrame:
    """Writes the frame as Parquet in the shared folder and reads it again: cuts the lineage
    at files that outlive any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only, a null text as an empty one; extra columns go."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def hash_sample(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """About ``rows`` of a frame's ``total`` rows (all, if there are no more), by a hash of unique
    keys: each task decides for itself, and the same rows are chosen every time."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(rows / total * (1 << 40)))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@functools.lru_cache(maxsize=4)
def _sent(application: str, context: int) -> None:
    """Sends the package's sources to the workers of a context, once."""
    from pyspark import SparkContext

    package = Path(__file__).resolve().parent.parent
    file = os.path.join(tempfile.mkdtemp(prefix="caregauge-src-"), f"{package.name}.zip")
    with zipfile.ZipFile(file, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    SparkContext.getOrCreate().addPyFile(file)


def sends_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose workers find this package, wherever the driver was started."""

    @functools.wraps(query)
    def sent(spark: SparkSession, *given: object) -> DataFrame:
        _sent(spark.sparkContext.applicationId, id(spark.sparkContext))
        return query(spark, *given)

    return sent
