"""Loads by header, loads into tables that are there, their gates, and the layout they leave."""

import csv
import glob
import os

import pytest
import sample
from conftest import rows
from pyspark.sql import functions as F

from caregauge import schemas
from caregauge.plans import audits, core, facts, gates, increments, reports
from caregauge.sinks import tables
from caregauge.sources import files as sources

HEADERS = {
    "facility_id": "Facility ID", "facility_name": "Facility Name", "state": "State", "measure_name": "Measure Name",
    "number_of_discharges": "Number of Discharges", "footnote": "Footnote",
    "excess_readmission_ratio": "Excess Readmission Ratio", "predicted_readmission_rate": "Predicted Readmission Rate",
    "expected_readmission_rate": "Expected Readmission Rate", "number_of_readmissions": "Number of Readmissions",
    "start_date": "Start Date", "end_date": "End Date",
}


def write_csv(df, path, columns=None, **other):
    columns = columns or df.columns[:-1]
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow([HEADERS.get(c, c) for c in columns])
        for r in df.collect():
            out.writerow([other.get(c, r[c]) for c in columns])
    return str(path)


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("deliveries")
    return {
        "hospitals": write_csv(sample.staged_hospitals(spark), folder / "h.csv"),
        "readmissions": write_csv(sample.staged_readmissions(spark), folder / "r.csv"),
        "quality": write_csv(sample.staged_quality(spark), folder / "q.csv"),
        "survey": write_csv(sample.staged_survey(spark), folder / "s.csv"),
    }


def shown(df, order=("facility_id", "measure_name")):
    return sorted((tuple(r) for r in df.drop("raw_load_ts").collect()), key=str)


def test_each_file_by_its_own_header(spark, tmp_path):
    staged = sample.staged_readmissions(spark)
    columns = staged.columns[:-1]
    folder = tmp_path / "in box"
    folder.mkdir()
    half = staged.where("facility_id < '060001'"), staged.where("facility_id >= '060001'")
    write_csv(half[0], folder / "a.csv")
    write_csv(half[1], folder / "b 2.csv", columns[::-1])
    plain = sources.read_staging(spark, str(folder / "a.csv"), schemas.READMISSION_FILE).drop("raw_load_ts")
    whole = write_csv(staged, tmp_path / "whole.csv")
    expected = shown(sources.read_staging(spark, whole, schemas.READMISSION_FILE))
    read = sources.read_staging(spark, str(folder), schemas.READMISSION_FILE, keep_corrupt=True, by_name=True)
    assert read.columns == [*schemas.READMISSION_FILE.fieldNames(), sources.CORRUPT, "raw_load_ts"]
    assert shown(read.drop(sources.CORRUPT)) == expected and plain.count() < len(expected)
    assert audits.corrupt_lines(read, "readmissions").first()["corrupt_count"] == 0

    # short and long lines are counted against their own file's header
    with open(folder / "c.csv", "w") as f:
        f.write("\n﻿End Date,Facility ID,Number of Discharges\n06/30/2024,9,12\n06/30/2024,9\n06/30/2024,9,1,2\n")
    with open(folder / "empty.csv", "w"):
        pass
    read = sources.read_staging(spark, str(folder), schemas.READMISSION_FILE, keep_corrupt=True, by_name=True)
    counts = audits.corrupt_lines(read, "readmissions").first()
    assert (counts["line_count"], counts["corrupt_count"]) == (len(expected) + 3, 2)
    good = [r for r in read.collect() if r.facility_id == "9" and r[sources.CORRUPT] is None]
    assert [(r.end_date, r.number_of_discharges, r.state) for r in good] == [("06/30/2024", "12", None)]


@pytest.mark.parametrize("header", ["State,Measure Name", "Facility ID,State,state", "1,2,3"])
def test_headers_that_cannot_be_read(spark, tmp_path, header):
    (tmp_path / "r.csv").write_text(f"{header}\n1,2,3\n")
    with pytest.raises(ValueError, match="header"):
        sources.read_staging(spark, str(tmp_path), schemas.READMISSION_FILE, by_name=True)


def test_first_lines_stop_early(spark, tmp_path):
    """A large file costs no more than its first lines: the plan has one task a file."""
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.csv").write_text(f"head {name}\n" + "x,y,z\n" * 400_000)
    lines = sources.first_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 3
    assert sorted(r.line for r in lines.collect()) == ["head a", "head b", "head c"]


def test_unknown_measures_are_told_apart(spark):
    star = sample.loaded_star(spark)
    staged = sample.staged_readmissions(spark).where("facility_id = '010001'").limit(1)

    def load(name, discharges):
        named = staged.withColumns({"measure_name": F.lit(name), "number_of_discharges": F.lit(discharges)})
        return facts.load_readmissions(named, star.hospitals, star.measures)

    first = load("Never heard of", "10").unionByName(load("Unheard of too", "20"))
    assert first.where("measure_key IS NULL").count() == 2 and first.select("unknown_measure").distinct().count() == 2
    both = facts.carried_on(first, load(" never HEARD of ", "30").unionByName(load("A third", "40")))
    assert sorted(r.number_of_discharges for r in both.collect()) == [20, 30, 40]


def fact_files(folder, table="fact_readmissions"):
    found = glob.glob(f"{folder}/{table}/end_year=*/*.parquet")
    return {f[len(folder) :]: os.stat(f).st_mtime_ns for f in found}


def by_year(star):
    return dict(rows(star.readmissions.groupBy("end_year").agg(F.count("*"))))


def test_only_touched_years_are_written(spark, given, tmp_path):
    folder = str(tmp_path / "core")
    staged = sample.staged_readmissions(spark)
    old, new, none = (
        write_csv(staged, tmp_path / f"{day[-4:]}{k}.csv", end_date=day) for k, day in enumerate(("06/30/2023", "06/30/2024", "no date"))
    )
    first = increments.load_into(spark, {**given, "readmissions": old}, folder)
    count = first.star.readmissions.count()
    assert by_year(first.star) == {2023: count} and first.years["readmissions"] == [2023]
    kept, quality = fact_files(folder), fact_files(folder, "fact_quality_metrics")
    second = increments.load_into(spark, {"hospitals": given["hospitals"], "readmissions": new}, folder)
    assert by_year(second.star) == {2023: count, 2024: count} and second.years == {"readmissions": [2024]}
    now = fact_files(folder)
    assert kept.items() <= now.items() and quality == fact_files(folder, "fact_quality_metrics")
    third = increments.load_into(spark, {"readmissions": none}, folder)
    assert by_year(third.star) == {2023: count, 2024: count, None: count} and third.years["readmissions"] == [None]

    # again the same: not a file is written
    before, held = fact_files(folder), sorted(map(str, third.star.readmissions.collect()))
    again = increments.load_into(spark, {**given, "readmissions": new}, folder)
    assert again.years == {"readmissions": [], "satisfaction": [], "quality": []}
    assert fact_files(folder) == before and sorted(map(str, again.star.readmissions.collect())) == held
    assert again.star.hospitals.count() == 10 and again.star.measures.count() == 25

    # a correction of one year
    fixed = write_csv(staged, tmp_path / "fixed.csv", end_date="06/30/2024", number_of_discharges="77")
    last = increments.load_into(spark, {"readmissions": fixed}, folder)
    assert last.years["readmissions"] == [2024]
    assert last.star.readmissions.where("end_year = 2024 AND number_of_discharges != 77").count() == 0
    assert {k: v for k, v in before.items() if "end_year=2024" not in k}.items() <= fact_files(folder).items()
    whole = core.build_core(spark, {**given, "readmissions": fixed}, str(tmp_path / "built"))
    columns = [c for c in whole.readmissions.columns if c != "created_at"]
    assert sorted(map(str, last.star.readmissions.where("end_year = 2024").select(columns).collect())) == sorted(
        map(str, whole.readmissions.select(columns).collect())
    )


def test_refused_loads_leave_the_tables(spark, given, tmp_path):
    folder = str(tmp_path / "core")
    increments.load_into(spark, given, folder, end="2026-12-31")
    held = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/[df]*/**", recursive=True)}

    def unchanged():
        return held == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/[df]*/**", recursive=True)}

    late = write_csv(sample.staged_readmissions(spark), tmp_path / "late.csv", end_date="06/30/2031")
    with pytest.raises(gates.LoadRefused, match="end_date_key") as told:
        increments.load_into(spark, {"readmissions": late}, folder, end="2026-12-31")
    assert told.value.broken == {"fact_readmissions.end_date_key unknown": 24} and unchanged()
    with pytest.raises(gates.LoadRefused, match="end_date_key"):
        increments.load_into(spark, {"readmissions": late}, folder, start="2019-01-01", end="2031-06-01")
    with pytest.raises(gates.LoadRefused, match="fact_readmissions.start_date_key unknown: 24"):
        few = {"hospitals": given["hospitals"], "readmissions": given["readmissions"]}
        core.build_core(spark, few, str(tmp_path / "built"), start="2024-01-01")

    text = open(given["readmissions"]).read()
    (tmp_path / "wide.csv").write_text(text + "1,2\n" * 30)
    with pytest.raises(gates.LoadRefused, match="another width"):
        increments.load_into(spark, {"readmissions": str(tmp_path / "wide.csv")}, folder, most_corrupt=0.5)
    assert unchanged()

    # a surrogate key that two hospitals share: one that is held takes the key of one to come
    known = core.open_core(spark, folder)
    new = sample.staged_hospitals(spark).limit(1).withColumn("facility_id", F.lit("999999"))
    shared = known.hospitals.withColumn("hospital_key", F.when(F.col("facility_id") == "010001", F.xxhash64(F.lit("999999"))).otherwise(F.col("hospital_key")))
    other = str(tmp_path / "other")
    increments.load_into(spark, given, other)
    tables.write_table(spark.createDataFrame(shared.collect(), schemas.CORE["hospitals"]), f"{other}/dim_hospital")
    before = fact_files(other)
    with pytest.raises(gates.LoadRefused, match="dim_hospital.hospital_key not unique: 1"):
        increments.load_into(spark, {"hospitals": write_csv(new, tmp_path / "new.csv")}, other)
    assert fact_files(other) == before and core.open_core(spark, other).hospitals.where("facility_id = '999999'").count() == 0


def test_an_accepted_load_is_finished_later(spark, given, tmp_path, monkeypatch):
    folder = str(tmp_path / "core")
    staged = sample.staged_readmissions(spark)
    increments.load_into(spark, given, folder)
    moved = write_csv(staged, tmp_path / "moved.csv", end_date="06/30/2022")

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(increments, "replace_years", lost)
        with pytest.raises(OSError, match="lost"):
            increments.load_into(spark, {"readmissions": moved}, folder)
    assert 2022 not in by_year(core.open_core(spark, folder))
    star = increments.load_into(spark, {}, folder).star
    assert by_year(star)[2022] == 24
    log = spark.read.parquet(f"{folder}/{increments.LOG}")
    assert {r[0] for r in log.groupBy("load_id", "step").agg(F.count("*")).groupBy("load_id").count().select("count").collect()} == {2}


def scanned_rows(df):
    """Rows that the scans of a plan put out, by its metrics after running."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    out = {}
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            name = node.toString()
            if "number_of_discharges" in name or "readmission_rate_pct" in name:
                out["fact"] = out.get("fact", 0) + node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return out["fact"]


def test_a_lookup_reads_few_pages(spark, tmp_path):
    """One of 3,000 hospitals out of 240,000 rows in two years."""
    hospitals = sample.loaded_star(spark).hospitals
    many = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("facility_id"))
    columns = [F.col(c) for c in hospitals.columns if c not in ("facility_id", "hospital_key")]
    one = hospitals.limit(1).select(*columns)
    tables.write_table(many.crossJoin(F.broadcast(one)).withColumn("hospital_key", F.xxhash64("facility_id")), str(tmp_path / "h"))
    stored = tables.read_table(spark, str(tmp_path / "h"), schemas.CORE["hospitals"])
    fact = stored.select("hospital_key").crossJoin(spark.range(80)).selectExpr(
        "xxhash64(hospital_key, id) AS readmission_key", "hospital_key", "CAST(NULL AS BIGINT) AS measure_key", "CAST(NULL AS BIGINT) AS unknown_measure",
        "20230101 AS start_date_key", "CAST(IF(id < 40, 20230630, 20240630) AS INT) AS end_date_key",
        "CAST(id AS INT) AS number_of_discharges", "CAST(1 AS DECIMAL(8,4)) AS excess_readmission_ratio", "CAST(2 AS DECIMAL(8,4)) AS readmission_rate_pct",
    )
    tables.replace_years(fact.repartition(8), str(tmp_path / "f"), "readmission_key")
    # with the plain writer too, in whose files hospitals are spread
    tables.write_fact(fact.repartition(8), str(tmp_path / "g"))
    base = sample.loaded_star(spark)
    for place in ("f", "g"):
        read = tables.read_table(spark, str(tmp_path / place), schemas.CORE["readmissions"])
        star = schemas.Star(hospitals=stored, dates=base.dates, measures=base.measures, readmissions=read)
        found = reports.rows_of(star.readmissions, star, "001234", "facility_name").select("hospital_key", "readmission_rate_pct")
        assert found.count() == 80
        assert scanned_rows(found) <= 40_000, place


def test_years_that_the_table_lacks_are_not_compared(spark, given, tmp_path):
    """Their rows are taken as they are; keys of the other years go through one aggregate, without a join."""
    folder = str(tmp_path / "core")
    first = increments.load_into(spark, given, folder).star
    held = sorted(map(str, first.readmissions.drop("created_at").collect()))
    later = sample.staged_readmissions(spark).withColumn("end_date", F.lit("06/30/2031"))
    loaded = increments.load_into(spark, {"readmissions": write_csv(later, tmp_path / "later.csv")}, folder)
    assert loaded.years == {"readmissions": [2031]}
    assert spark.read.parquet(f"{folder}/_staged/{loaded.load_id}/changed_readmissions").isEmpty()
    now = loaded.star.readmissions.drop("created_at")
    assert sorted(map(str, now.where("end_year < 2031 OR end_year IS NULL").collect())) == held
    assert now.where("end_year = 2031").count() == len(held)
    plan = facts.changed_keys(now, now, "readmission_key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_changed_keys_by_number_and_sum(spark):
    def fact(*found):
        return spark.createDataFrame([(*k, h) for k, h in found], "hospital_key LONG, measure_key LONG, unknown_measure LONG, "
                                     "start_date_key INT, end_date_key INT, row LONG")

    same, more, other, new, gone = ((k, None, 5, None, 20240101) for k in range(5))
    low = -(1 << 63)
    held = fact((same, 1), (same, low), (more, 7), (other, 1), (other, 4), (gone, 9))
    given_ = fact((same, low), (same, 1), (more, 7), (more, 7), (other, 2), (other, 4), (new, low))
    found = facts.changed_keys(held, given_, "row")
    assert found.columns == [f"_{c}" for c in facts.NATURAL_KEY]
    assert sorted(r[0] for r in found.collect()) == [1, 2, 3]
