import csv

import pytest
import sample
from conftest import rows
from pyspark.sql import functions as F

from caregauge.plans import audits, core, performance


def write_csv(df, path):
    """One file with a header line, as delivered."""
    columns = df.columns[:-1]
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows([r[c] for c in columns] for r in df.collect())
    return str(path)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("deliveries")
    return {
        "hospitals": write_csv(sample.staged_hospitals(spark), folder / "h.csv"),
        "readmissions": write_csv(sample.staged_readmissions(spark), folder / "r.csv"),
        "quality": write_csv(sample.staged_quality(spark), folder / "q.csv"),
        "survey": write_csv(sample.staged_survey(spark), folder / "s.csv"),
    }


def test_files_to_tables_and_reports(spark, files, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    counts = {"dim_hospital": 10, "fact_patient_satisfaction": 27, "fact_quality_metrics": 26, "fact_readmissions": 24}
    star = core.build_core(spark, files, first)
    assert dict(rows(audits.star_row_counts(star))) == counts
    found = performance.readmission_by_hospital(star)
    assert [r.facility_id for r in found.collect()][:2] == ["010007", "450639"]
    again = core.build_core(spark, files, second, previous=first)
    assert dict(rows(audits.star_row_counts(again))) == counts
    assert again.measures.count() == 25
    assert rows(performance.readmission_by_hospital(again)) == rows(found)
    core.publish(again, str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports" / "vw_hospital_scorecard")).count() == 10


def dated(spark, source, day, path, **other):
    """The delivery with other dates (and numbers)."""
    df = source(spark).withColumn("end_date", F.lit(day))
    return write_csv(df.withColumns({k: F.lit(v) for k, v in other.items()}).select(source(spark).columns), path)


def test_loads_carry_facts_on(spark, files, tmp_path):
    one, two, three, four = (str(tmp_path / n) for n in ("one", "two", "three", "four"))
    old = {"hospitals": files["hospitals"], "readmissions": dated(spark, sample.staged_readmissions, "06/30/2023", tmp_path / "old.csv")}
    new = {"hospitals": files["hospitals"], "readmissions": dated(spark, sample.staged_readmissions, "06/30/2024", tmp_path / "new.csv")}
    fixed = dated(spark, sample.staged_readmissions, "06/30/2024", tmp_path / "fixed.csv", number_of_discharges="77")
    first = core.build_core(spark, old, one)
    count = first.readmissions.count()
    both = core.build_core(spark, new, two, previous=one)
    assert sorted({r.end_year for r in both.readmissions.collect()}) == [2023, 2024]
    assert both.readmissions.count() == 2 * count
    again = core.build_core(spark, {**new, "readmissions": fixed}, three, previous=two)
    numbers = again.readmissions.groupBy("end_year").agg(F.count("*"), F.sum("number_of_discharges")).orderBy("end_year").collect()
    corrected = sample.staged_readmissions(spark).where("trim(facility_id) != ''").count()
    assert [r[0] for r in numbers] == [2023, 2024] and numbers[0][1] == count and numbers[1][2] == 77 * numbers[1][1]
    assert count <= numbers[1][1] <= corrected
    alone = core.build_core(spark, new, four, previous=two, rebuild=True)
    assert alone.readmissions.count() == count and {r.end_year for r in alone.readmissions.collect()} == {2024}


def test_calendar_covers_the_facts(spark, files, tmp_path):
    late = dated(spark, sample.staged_readmissions, "06/30/2031", tmp_path / "late.csv")
    given = {"hospitals": files["hospitals"], "readmissions": late}
    star = core.build_core(spark, given, str(tmp_path / "one"))
    assert star.dates.agg(F.max("date_key")).first()[0] == 20311231
    assert performance.readmission_by_hospital(star).count() > 0
    with pytest.raises(ValueError, match="20310630"):
        core.build_core(spark, given, str(tmp_path / "two"), end="2026-12-31")


def test_lines_of_another_width_are_counted(spark, files, tmp_path):
    text = open(files["readmissions"]).read() + "1,short,AL\n"
    (tmp_path / "r.csv").write_text(text)
    target = str(tmp_path / "one")
    star = core.build_core(spark, {**files, "readmissions": str(tmp_path / "r.csv")}, target)
    assert star.readmissions.count() == 24
    counts = {r.delivery: (r.line_count, r.corrupt_count) for r in spark.read.parquet(f"{target}/load_audit").collect()}
    assert counts["readmissions"][1] == 1 and counts["survey"][1] == 0 and len(counts) == 4


def test_loads_by_header(spark, files, tmp_path):
    with open(files["readmissions"], newline="") as f:
        lines = [row[::-1] for row in csv.reader(f)]
    with open(tmp_path / "turned.csv", "w", newline="") as f:
        csv.writer(f).writerows(lines)
    star = core.build_core(spark, {**files, "readmissions": str(tmp_path / "turned.csv")}, str(tmp_path / "one"), by_name=True)
    assert star.readmissions.count() == 24


def test_session_settings_stay(spark, files, tmp_path):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        with pytest.warns(UserWarning, match="skewJoin"):
            core.build_core(spark, {"hospitals": files["hospitals"]}, str(tmp_path / "one"))
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_missing_deliveries_and_wrong_target(spark, files, tmp_path):
    target = str(tmp_path / "one")
    star = core.build_core(spark, {"hospitals": files["hospitals"]}, target)
    assert star.readmissions.count() == star.quality.count() == 0 and star.hospitals.count() == 10
    with pytest.raises(ValueError):
        core.build_core(spark, files, target, previous=target + "/")
