"""Token ids as Parquet list columns, in document order, for selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caregauge.llm.common import slices, texts
from caregauge.llm.tokens import batches_of, id_lists, text_encoder, with_end

#: Row groups of so many bytes and pages of so many bytes or rows: a read of a few documents
#: takes the pages that the page index names, a read of the counts leaves the ids alone.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2_000
#: Offsets of so many files, a few MB, may be sent to every task.
BROADCAST_FILES = 50_000


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> None:
    """Writes (doc_id, n_tokens, first, ids) in ascending doc_id order, one file per range.

    Ids are dictionary-coded, counts and doc_ids delta-coded (second version of the format);
    ``first`` is the number of ids before the document in its file. Null doc_ids come first;
    repeated ones are ordered by text, and spread over ranges if they are many. A null or empty
    text is ``end_id`` alone. An empty table gives files without rows.
    """

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        before = 0
        for batch in batches_of(batches):
            ends, ids = with_end(*encoder.encode(batch.column("text")), end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(before + ends[:-1]), id_lists(ends, ids)],
                names=["doc_id", "n_tokens", "first", "ids"],
            )
            before += int(ends[-1])

    docs = texts(docs)
    keys: list[Column] = [F.col("doc_id"), F.col("text_hash"), F.col("row")]
    ordered = (
        docs.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered.mapInArrow(encoded, f"doc_id {kind}, n_tokens long, first long, ids array<int>").write.options(
        **{
            "parquet.writer.version": "v2",
            "parquet.block.size": ROW_GROUP_BYTES,
            "parquet.page.size": PAGE_BYTES,
            "parquet.page.row.count.limit": PAGE_ROWS,
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": "true",
            # a file for each range, whatever the session says: ``first`` counts within the file
            "maxRecordsPerFile": 0,
        }
    ).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before.

    Files are in document order by the number of the range in their name (a number, not a text:
    it is padded to five digits only); each file's total is read from its counts alone. Filters
    on doc_id and column choices reach the scan. A file of another name, or two of one number, raise.
    """
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1)
    rows = spark.read.parquet(folder).select("*", F.expr("_metadata.file_name").alias("name"), named.cast("long").alias("file"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.min("name").alias("a"), F.max("name").alias("b"))
    single = F.when(F.col("a") == F.col("b"), F.col("tokens")).otherwise(
        F.raise_error(F.concat(F.lit("two token files of one range: "), "a", F.lit(", "), "b")).cast("long")
    )
    totals = totals.select("file", single.alias("tokens"))
    earlier = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("file", F.coalesce(earlier, F.lit(0)).alias("before"))
    if len(rows.inputFiles()) <= BROADCAST_FILES:  # else the lists of ids move to a shuffled join
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "file").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids"
    )


def checksums(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """The rows with ``ids_crc32`` of the little-endian unsigned 32-bit ids in place of the ids."""
    kept = [f for f in rows.schema.fields if f.name != ids]

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            lists = batch.column(ids)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            ends = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(crc, pa.int64())],
                names=[*(f.name for f in kept), "ids_crc32"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(summed, f"{schema}, ids_crc32 long")
