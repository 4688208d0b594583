"""Shards of near equal size by longest-processing-time scheduling of groups."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caregauge.llm.common import written

SHARDS = 8
#: Jobs that the shards' heap is given, at most twice as many: groups as large as a job's mean
#: share are jobs of their own, smaller ones are first joined to jobs within a task.
JOBS = 8_192
#: Groups that one task joins to jobs.
TASK_GROUPS = 100_000
#: Rows of the written table, as a power of two, whose rows of a group are numbered together.
BLOCK_BITS = 13


def schedule(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Longest first, each to the least loaded shard (the first of equal ones)."""
    heap = [(0, s) for s in range(shards)]
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, s = heap[0]
        out[i] = s
        heapq.heapreplace(heap, (load + int(sizes[i]), s))
    return out


def before_in(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the counts of earlier rows with the same key."""
    order = np.argsort(keys, kind="stable")
    total = np.cumsum(counts[order])
    first = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(keys) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, total - counts[order], 0)) if len(keys) else total
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = total - counts[order] - base
    return out


def joiner(key: str, jobs: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def join_items(rows: pd.DataFrame) -> pd.DataFrame:
        """Joins the items of one task to jobs; ``within`` counts the rows before an item in its job."""
        rows = rows.sort_values(["bytes", key], ascending=[False, True]).reset_index(drop=True)
        job = schedule(rows["bytes"].to_numpy(), min(jobs, len(rows)))
        name = (int(rows["task"].iloc[0]) << 20) + job
        return rows.assign(job=name, within=before_in(job, rows["rows"].to_numpy()))[[key, "job", "within"]]

    return join_items


def joined(items: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows (key, job, within): the items dealt by hash over tasks, each joining its own to its share of JOBS."""
    kind = items.schema[key].dataType.simpleString()
    dealt = items.withColumn("task", F.pmod(F.xxhash64(key), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(joiner(key, max(1, JOBS // tasks)), f"{key} {kind}, job long, within long")


def tasks_for(count: int) -> int:
    return max(1, -(-count // TASK_GROUPS))


def scheduler(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def schedule_jobs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "job"], ascending=[False, True]).reset_index(drop=True)
        shard = schedule(rows["bytes"].to_numpy(), shards)
        return rows.assign(shard=shard, first=before_in(shard, rows["rows"].to_numpy()))[["job", "shard", "first"]]

    return schedule_jobs


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of all documents.

    Size is the text's UTF-8 bytes and 1. Documents with equal texts form a group and share a
    shard (a null text is equal to an empty one). Groups of the mean job's size and larger are
    jobs; the rest is dealt by hash over tasks of TASK_GROUPS groups, each of which joins its
    groups to its share of JOBS jobs by longest-processing-time scheduling. Where there are more
    tasks than JOBS, their jobs are joined once more in the same way. One last task, of at most
    twice JOBS jobs, puts jobs into shards. So shards differ by a small job at most, unless one
    group is larger than a shard's share.

    Slots number a shard's rows from 0 without gaps: by job, group, block of the written rows and
    doc_id. A group has as many blocks as its rows need, so that one of very many rows is numbered
    by many tasks, whatever its doc_ids; a task adds up the counts of a group's blocks. Repeated
    rows have slots of their own; an empty table gives an empty one; extra columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows).withColumn("part", F.shiftright("row", BLOCK_BITS))
    parts = rows.groupBy("text_key", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    parts = written(parts)
    groups = parts.groupBy("text_key").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    groups = written(groups)
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    large = F.col("bytes") * JOBS >= F.lit(total)
    tasks = tasks_for(count)
    small = joined(groups.filter(~large), "text_key", tasks)
    if tasks > JOBS:
        small = written(small)
        inner = small.join(groups, "text_key").groupBy(F.col("job").alias("inner")).agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
        )
        outer = joined(inner, "inner", tasks_for(tasks)).withColumnsRenamed({"job": "outer", "within": "before"})
        small = small.join(outer, small["job"] == outer["inner"]).select(
            "text_key", F.col("outer").alias("job"), (F.col("before") + F.col("within")).alias("within")
        )
    own = groups.filter(large).select("text_key", (-1 - F.monotonically_increasing_id()).alias("job"), F.lit(0).cast("long").alias("within"))
    placed = written(small.unionByName(own)).join(groups, "text_key")
    jobs = placed.groupBy("job").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    shards_of = jobs.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(scheduler(shards), "job long, shard int, first long")
    starts = placed.join(shards_of, "job").select(
        "text_key", "shard", (F.col("first") + F.col("within")).alias("group_start")
    )
    earlier = F.sum("rows").over(Window.partitionBy("text_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = parts.join(starts, "text_key").select(
        "text_key", "part", "shard", (F.col("group_start") + F.coalesce(earlier, F.lit(0))).alias("start")
    )
    # Numbered before the join, and a left one, so that rows are never dealt by the text alone.
    turn = F.row_number().over(Window.partitionBy("text_key", "part").orderBy("doc_id", "row"))
    return rows.withColumn("turn", turn).join(cells, ["text_key", "part"], "left").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("turn") - 1).cast("long").alias("slot")
    )
