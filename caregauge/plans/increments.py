"""Loads into saved core tables: only touched years are written, and only after the gates."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.storage import advise
from ..schemas import CORE, HOSPITAL_FILE, QUALITY_FILE, READMISSION_FILE, SURVEY_FILE, Star
from ..sinks.tables import append_rows, read_table, replace_years, with_year, write_table
from ..sources.files import CORRUPT, no_rows, read_staging
from ..sources.generated import date_dimension
from . import dimensions, facts, gates
from .audits import corrupt_lines
from .core import FOLDERS, open_core

FACTS = {
    "readmissions": ("readmissions", READMISSION_FILE, facts.load_readmissions, "readmission_key"),
    "satisfaction": ("survey", SURVEY_FILE, facts.load_satisfaction, "satisfaction_key"),
    "quality": ("quality", QUALITY_FILE, facts.load_quality, "quality_key"),
}
LOG = "load_log"
_LOG = "load_id STRING, step STRING, table_name STRING, row_count BIGINT, logged_at TIMESTAMP"


@dataclass
class Loaded:
    """The tables after a load, its id, and the years that it wrote of each fact."""

    star: Star
    load_id: str
    years: dict[str, list[int | None]] = field(default_factory=dict)


def _log(spark: SparkSession, folder: str, load_id: str, step: str, counts: Mapping[str, int | None]) -> None:
    rows = [(load_id, step, table, n) for table, n in counts.items()]
    named = spark.createDataFrame(rows, "load_id STRING, step STRING, table_name STRING, row_count BIGINT")
    append_rows(named.withColumn("logged_at", F.current_timestamp()).coalesce(1), f"{folder}/{LOG}")


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        return not read_table(spark, f"{folder}/{LOG}", _LOG).where("step = 'published'").isEmpty()
    except Exception as missing:  # Spark names the class only after the error
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def _publish(spark: SparkSession, folder: str, load_id: str, tables: Mapping[str, int | None]) -> None:
    """Accepted tables of a load take their places: dimensions first, whole; facts by year.

    Doing it again has the same result, so that a load which was cut short here is finished by
    the next one.
    """
    for table in sorted(tables, key=lambda t: t in FACTS):
        staged = read_table(spark, f"{folder}/_staged/{load_id}/{FOLDERS[table]}", CORE[table])
        place = f"{folder}/{FOLDERS[table]}"
        if table in FACTS:
            replace_years(staged, place, FACTS[table][3])
        else:
            write_table(staged, place)
    _log(spark, folder, load_id, "published", tables)


def finish_earlier(spark: SparkSession, folder: str) -> None:
    """Publishes what an earlier load accepted but did not get to publish."""
    log = read_table(spark, f"{folder}/{LOG}", _LOG)
    done = log.where("step = 'published'").select("load_id").distinct()
    open_ = log.where("step = 'accepted'").join(done, "load_id", "left_anti").orderBy("logged_at")
    waiting: dict[str, dict[str, int | None]] = {}
    for row in open_.collect():  # a few rows for each load that was cut short
        waiting.setdefault(row["load_id"], {})[row["table_name"]] = row["row_count"]
    for load_id, tables in waiting.items():
        _publish(spark, folder, load_id, tables)


def load_into(
    spark: SparkSession,
    files: Mapping[str, str],
    folder: str,
    start: str | None = None,
    end: str | None = None,
    by_name: bool = False,
    most_corrupt: float = 1.0,
) -> Loaded:
    """Loads deliveries (as ``core.build_core``) into the tables of one folder, which the first load makes.

    Of each fact, natural keys whose delivered rows differ from the held ones are found first;
    only the years in which such keys end are read, merged and written (a row without an end
    date is in a year of its own). Years that the table lacks are compared with nothing. Files of
    other years stay as they are, and a delivery that is already held writes nothing.

    Everything is staged under ``_staged/<load id>`` first. Before it takes its place, ids and
    surrogate keys must be unique, every key of the staged facts must be in its dimension, the
    calendar must cover them (with ``start`` or ``end``, their days are the limit; else it grows)
    and at most ``most_corrupt`` of a delivery's lines may have another width than the header.
    Otherwise ``gates.LoadRefused`` is raised and the tables are as before. ``load_log`` tells
    what was accepted and published; a load that ended in between is finished by the next one.
    """
    advise(spark)
    known = _exists(spark, folder)
    before = None
    if known:
        finish_earlier(spark, folder)
        before = open_core(spark, folder)
    load_id = uuid.uuid4().hex
    place = f"{folder}/_staged/{load_id}"
    broken: dict[str, int] = {}

    def delivered(name: str, schema) -> DataFrame:
        if name not in files:
            return no_rows(spark, schema)
        staged = read_staging(spark, files[name], schema, keep_corrupt=True, by_name=by_name)
        if most_corrupt < 1:
            counts = corrupt_lines(staged, name).first()
            if counts["corrupt_count"] > most_corrupt * counts["line_count"]:
                broken[f"lines of {name} of another width"] = counts["corrupt_count"]
        return staged.where(F.col(CORRUPT).isNull()).drop(CORRUPT)

    tables: dict[str, int | None] = {}

    def stage(table: str, df: DataFrame) -> None:
        write_table(df, f"{place}/{FOLDERS[table]}")
        tables[table] = None

    def staged(table: str) -> DataFrame:
        """A dimension as it will be: staged, or as it is if the load does not change it."""
        if before is not None and table not in tables:
            return getattr(before, table)
        return read_table(spark, f"{place}/{FOLDERS[table]}", CORE[table])

    if before is None:
        stage("hospitals", dimensions.clean_hospitals(delivered("hospitals", HOSPITAL_FILE)))
        stage("measures", dimensions.load_measures(spark))
    else:
        if "hospitals" in files:
            stage("hospitals", dimensions.upsert_hospitals(delivered("hospitals", HOSPITAL_FILE), before.hospitals))
        measures = dimensions.load_measures(spark, before.measures)
        if measures.count() != before.measures.count():
            stage("measures", measures)
    gates.refuse(broken | gates.collisions(staged("hospitals"), staged("measures")))

    years: dict[str, list[int | None]] = {}
    days: list[int] = []
    for table, (name, schema, load, row_key) in FACTS.items():
        if name not in files and before is not None:
            continue
        rows = with_year(load(delivered(name, schema), staged("hospitals"), staged("measures")))
        gates.refuse(broken)
        if before is None:
            merged, years[table] = rows, []
        else:
            # cleaned once, and kept apart from what is made of it
            write_table(rows, f"{place}/cleaned_{table}")
            fact, held = read_table(spark, f"{place}/cleaned_{table}", CORE[table]), getattr(before, table)
            found = _years_of(fact)
            both = _years_of(in_years(held, found))
            # a year that the table lacks is taken as it is: all its keys are new
            new = [y for y in found if y not in both]
            changed = facts.changed_keys(in_years(held, both), in_years(fact, both), row_key)
            write_table(changed, f"{place}/changed_{table}")
            changed = spark.read.parquet(f"{place}/changed_{table}")
            ended = changed.selectExpr("CAST(floor(_end_date_key / 10000) AS INT) AS end_year")
            touched = _years_of(ended)
            years[table] = _in_order(new + touched)
            if not years[table]:
                continue
            merged = in_years(fact, new)
            if touched:
                merged = facts.with_changes(in_years(held, touched), in_years(fact, touched), changed).unionByName(merged)
        watched, seen = gates.observed(merged, f"{table} {load_id}")
        stage(table, watched)
        tables[table] = seen.get["rows"]
        days += [seen.get[d] for d in ("first_day", "last_day") if seen.get[d] is not None]
        if seen.get["no_hospital"]:
            broken[f"{FOLDERS[table]}.hospital_key missing"] = seen.get["no_hospital"]
        if before is None:
            years[table] = _in_order(_years_of(staged(table)))

    held_days = [] if before is None else [d for d in before.dates.agg(F.min("date_key"), F.max("date_key")).first() if d]
    first = min([int(K.CALENDAR_START.replace("-", "")), *days, *held_days])
    last = max([int(K.CALENDAR_END.replace("-", "")), *days, *held_days])
    if start or end or not held_days or min(held_days) > first or max(held_days) < last:
        stage("dates", date_dimension(spark, start or f"{first // 10000:04}-01-01", end or f"{last // 10000:04}-12-31"))
    touched = {t: staged(t) if t in tables else spark.createDataFrame([], CORE[t]) for t in FACTS}
    gates.refuse(broken | gates.dangling(Star(**{t: staged(t) for t in ("hospitals", "measures", "dates")}, **touched)))
    _log(spark, folder, load_id, "accepted", tables)
    _publish(spark, folder, load_id, tables)
    return Loaded(open_core(spark, folder), load_id, years)


def _years_of(fact: DataFrame) -> list[int | None]:
    return [r[0] for r in fact.select("end_year").distinct().collect()]


def _in_order(years: list[int | None]) -> list[int | None]:
    return sorted(years, key=lambda y: (y is not None, y))


def in_years(fact: DataFrame, years: list[int | None]) -> DataFrame:
    """The rows of some years; partitions of other years are not read."""
    some = F.col("end_year").isin([y for y in years if y is not None])
    return fact.where(some | F.col("end_year").isNull() if None in years else some)
