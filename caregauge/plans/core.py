"""From delivered files to saved core tables and report tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.storage import advise
from ..schemas import CORE, HOSPITAL_FILE, QUALITY_FILE, READMISSION_FILE, SURVEY_FILE, Star
from ..sinks.tables import export_reports, read_table, write_fact, write_table
from ..sources.files import CORRUPT, no_rows, read_staging
from ..sources.generated import date_dimension
from . import dimensions, facts, gates, views
from .audits import corrupt_lines

# Star table -> folder of the saved core tables.
FOLDERS = {
    "hospitals": "dim_hospital",
    "dates": "dim_date",
    "measures": "dim_measure",
    "readmissions": "fact_readmissions",
    "satisfaction": "fact_patient_satisfaction",
    "quality": "fact_quality_metrics",
}


def open_core(spark: SparkSession, folder: str) -> Star:
    """The saved core tables as a star."""
    advise(spark)
    return Star(
        **{t: read_table(spark, f"{folder}/{name}", CORE[t]) for t, name in FOLDERS.items()}
    )


def _last_days(facts_: list[DataFrame]) -> tuple[str, str]:
    """Days around the calendar's usual range and all dates of the facts, whole years."""
    first, last = K.CALENDAR_START, K.CALENDAR_END
    for fact in facts_:
        low, high = fact.agg(
            F.expr("min(least(start_date_key, end_date_key))"), F.expr("max(greatest(start_date_key, end_date_key))")
        ).first()
        if low is not None:
            first, last = min(first, f"{low // 10000:04}-01-01"), max(last, f"{high // 10000:04}-12-31")
    return first, last


def _inside(fact: DataFrame, name: str, start: str, end: str) -> None:
    """Raises if a row ends on a day that the calendar is not to have."""
    first, last = (int(d.replace("-", "")) for d in (start, end))
    outside = fact.where(~F.col("end_date_key").between(first, last))
    rows, low, high = outside.agg(F.count("*"), F.min("end_date_key"), F.max("end_date_key")).first()
    if rows:
        raise ValueError(f"{rows} rows of {name} end outside of {start} to {end}: {low} to {high}")


def build_core(
    spark: SparkSession,
    files: Mapping[str, str],
    target: str,
    previous: str | None = None,
    start: str | None = None,
    end: str | None = None,
    rebuild: bool = False,
    by_name: bool = False,
) -> Star:
    """Loads the deliveries ``hospitals``, ``readmissions``, ``survey`` and ``quality``.

    Hospitals, measures and facts carry on from the tables of an earlier load in
    ``previous``, which must be another folder than ``target``: rows that a delivery has
    anew are replaced (``facts.carried_on``), all others stay. ``rebuild`` takes the facts
    from the deliveries alone. A delivery that is not given adds nothing.

    The calendar covers its usual range and all dates of the facts; with ``start`` and
    ``end`` it covers just those days, and a fact that ends outside stops the load.
    Columns are taken by position or, with ``by_name``, by each file's header. Lines of
    another width than the header are not loaded; the table ``load_audit`` counts them.
    Keys that collide or that a dimension lacks raise ``gates.LoadRefused``; the tables of
    ``previous`` are then still the ones to use. ``increments.load_into`` loads into the
    tables of one folder and writes touched years only.
    """
    if previous is not None and previous.rstrip("/") == target.rstrip("/"):
        raise ValueError("the tables of the earlier load cannot be replaced while they are read")
    advise(spark)
    before = None if previous is None else open_core(spark, previous)
    audit: list[DataFrame] = []

    def delivered(name: str, schema):
        if name not in files:
            return no_rows(spark, schema)
        staged = read_staging(spark, files[name], schema, keep_corrupt=True, by_name=by_name)
        audit.append(corrupt_lines(staged, name))
        return staged.where(F.col(CORRUPT).isNull()).drop(CORRUPT)

    staged = delivered("hospitals", HOSPITAL_FILE)
    if before is None:
        hospitals, measures = dimensions.clean_hospitals(staged), dimensions.load_measures(spark)
    else:
        hospitals = dimensions.upsert_hospitals(staged, before.hospitals)
        measures = dimensions.load_measures(spark, before.measures)

    def place(table: str) -> str:
        return f"{target}/{FOLDERS[table]}"

    write_table(hospitals, place("hospitals"))
    write_table(measures, place("measures"))
    # facts meet the saved dimensions, not their lineage
    known = [read_table(spark, place(t), CORE[t]) for t in ("hospitals", "measures")]
    loaded = []
    for table, delivery, schema, load in (
        ("readmissions", "readmissions", READMISSION_FILE, facts.load_readmissions),
        ("satisfaction", "survey", SURVEY_FILE, facts.load_satisfaction),
        ("quality", "quality", QUALITY_FILE, facts.load_quality),
    ):
        fact = load(delivered(delivery, schema), *known)
        if before is not None and not rebuild:
            fact = facts.carried_on(getattr(before, table), fact)
        write_fact(fact, place(table))
        loaded.append(read_table(spark, place(table), CORE[table]))
    first, last = _last_days(loaded)
    for name, fact in zip(("readmissions", "survey", "quality"), loaded):
        if start or end:
            _inside(fact, name, start or first, end or last)
    write_table(date_dimension(spark, start or first, end or last), place("dates"))
    if audit:
        write_table(reduce(DataFrame.unionByName, audit), f"{target}/load_audit")
    star = open_core(spark, target)
    gates.refuse(gates.collisions(star.hospitals, star.measures) | gates.dangling(star))
    return star


def publish(star: Star, folder: str, fmt: str = "parquet") -> None:
    """Saves the five views as report tables."""
    export_reports(views.all_views(star), folder, fmt)
