"""Runs registered queries against their SQL: python -m analogue.check [sf_dir] [name ...]

With LARGE=1 nothing counts as small: no side is broadcast for its size.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from caregauge import schemas
from caregauge.operators import storage

from .oracle import oracle_sql
from .registry import queries

TABLES = "region nation customer supplier part orders lineitem events"


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


# The column types both sides are to show.
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    found = con.sql(oracle_sql()[name])
    if sorted(found.columns) != columns:
        return f"columns {columns} != {sorted(found.columns)}"
    types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    shown = {c: str(t) for c, t in zip(found.columns, found.types)}
    if types != shown:
        return f"types {[(c, types[c], shown[c]) for c in columns if types[c] != shown[c]]}"
    order = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    if not ours:
        return "empty"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, {columns}: {bad[0]}" if bad else None


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("LARGE"):
        storage.BROADCAST_LIMIT = schemas.BROADCAST_LIMIT = 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    con = connect(sf_dir)
    failed = 0
    for name in names or queries():
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(*sys.argv[1:])
