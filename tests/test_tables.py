import os

import sample
from conftest import rows
from pyspark.sql import functions as F

from caregauge.operators import latest
from caregauge.plans import dimensions, views
from caregauge.schemas import HOSPITAL_FILE, QUALITY_FILE, READMISSION_FILE, SURVEY_FILE
from caregauge.sources import files
from caregauge.sources.generated import date_dimension
from caregauge.sinks import tables

HEADER = "Facility ID,Facility Name,State,Measure Name,Number of Discharges,Footnote,Excess Readmission Ratio," \
    "Predicted Readmission Rate,Expected Readmission Rate,Number of Readmissions,Start Date,End Date"


def test_reads_files_by_position(spark, tmp_path):
    lines = [HEADER, '1,"A, B",AL,X,10,,1.0,2,3,4,07/01/2021,06/30/2024', "2,short,AL"]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    df = files.read_staging(spark, str(tmp_path / "r.csv"), READMISSION_FILE, keep_corrupt=True)
    got = df.orderBy("facility_id").collect()
    assert [(r.facility_id, r.facility_name, r.number_of_discharges, r.footnote) for r in got] == [
        ("1", "A, B", "10", None), ("2", "short", None, None),
    ]
    assert got[0][files.CORRUPT] is None and got[1][files.CORRUPT] == "2,short,AL"
    assert got[0].raw_load_ts is not None
    assert len(files.read_staging(spark, str(tmp_path / "r.csv"), READMISSION_FILE).columns) == 13


def test_schemas_and_headers(spark):
    assert [len(s.fields) for s in (HOSPITAL_FILE, READMISSION_FILE, SURVEY_FILE, QUALITY_FILE)] == [18, 12, 21, 19]
    assert files.staging_name("Number of Discharges") == "number_of_discharges"
    assert files.staging_name("Safety of care national comparison") == "safety_group"
    assert files.staging_name("ZIP Code") == "zip_code"
    given = spark.createDataFrame([("4", "Yes", "7")], ["Hospital overall rating", "Emergency Services", "Facility ID"])
    named = files.rename_headers(given, HOSPITAL_FILE)
    assert named.columns == HOSPITAL_FILE.fieldNames()
    assert rows(named.select("facility_id", "hospital_overall_rating", "emergency_services", "city")) == [("7", 4, "Yes", None)]


def test_fact_partitions_are_pruned_by_the_latest_year(spark, tmp_path):
    fact = spark.createDataFrame([(1, 20230630), (2, 20240630), (3, None)], "i int, end_date_key int")
    path = str(tmp_path / "fact")
    tables.write_fact(fact, path)
    stored = tables.read_table(spark, path)
    assert {r.end_year for r in stored.collect()} == {2023, 2024, None}
    recent = latest.at_latest_year(stored, date_dimension(spark))
    assert [r.i for r in recent.collect()] == [2]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line and "subquery" in line]
    assert any("end_year" in line.split("PartitionFilters")[1].split("]")[0] for line in pruned)


def test_quotes_commas_and_backslashes(spark, tmp_path):
    lines = [HEADER, r'1,"St. ""X"" Hospital, Inc",AL,"a\b\",10,,1.0,2,3,4,07/01/2021,06/30/2024', '2,"",AL,X,11,,,,,,,']
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    got = files.read_staging(spark, str(tmp_path / "r.csv"), READMISSION_FILE).orderBy("facility_id").collect()
    assert [(r.facility_name, r.measure_name, r.number_of_discharges) for r in got] == [
        ('St. "X" Hospital, Inc', "a\\b\\", "10"), (None, "X", "11"),
    ]
    (tmp_path / "m.csv").write_text(HEADER + '\n1,"two\nlines",AL,X,10,,,,,,,\n')
    one = files.read_staging(spark, str(tmp_path / "m.csv"), READMISSION_FILE, multi_line=True).first()
    assert (one.facility_name, one.number_of_discharges) == ("two\nlines", "10")


def test_reads_columns_by_header(spark, tmp_path):
    (tmp_path / "r.csv").write_text("State,Number of Discharges,Unknown,Facility ID\nAL,12,x,7\n")
    got = files.read_staging(spark, str(tmp_path / "r.csv"), READMISSION_FILE, by_name=True, delivered_at="2024-05-06 00:00:00")
    assert got.columns == [*READMISSION_FILE.fieldNames(), "raw_load_ts"]
    row = got.first()
    assert (row.facility_id, row.state, row.number_of_discharges, row.end_date) == ("7", "AL", "12", None)
    assert str(row.raw_load_ts) == "2024-05-06 00:00:00"


def test_the_newer_file_of_a_folder_wins(spark, tmp_path):
    header = ",".join(HOSPITAL_FILE.fieldNames())
    rest = "," * (len(HOSPITAL_FILE.fields) - 2)
    for name, at in (("a old name", 2_000_000_000), ("z new name", 2_000_000_100), ("m older name", 1_900_000_000)):
        path = tmp_path / f"{at % 7}.csv"
        path.write_text(f"{header}\n1,{name}{rest}\n")
        os.utime(path, (at, at))
    staged = files.read_staging(spark, str(tmp_path), HOSPITAL_FILE)
    assert dimensions.clean_hospitals(staged).first().facility_name == "z new name"


def test_appended_facts_are_read_back(spark, tmp_path):
    path = str(tmp_path / "fact")
    schema = "i int, end_date_key int"
    tables.write_fact(spark.createDataFrame([(1, 20230630), (2, None)], schema), path)
    tables.append_fact(spark.createDataFrame([(3, 20240630), (4, 20230101), (5, None)], schema), path)
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]
    more = spark.createDataFrame([(3, 20240630, 2024), (6, 20240630, 2024)], schema + ", end_year int")
    tables.append_absent(more, path, ["i"], ["end_year"])
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 6]


def test_append_absent_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    tables.write_table(first, path)
    more = spark.createDataFrame([("b", None), ("c", 3), ("c", 3)], "k string, n int")
    for _ in range(2):
        tables.append_absent(more, path, ["k", "n"])
    assert sorted(rows(spark.read.parquet(path)), key=str) == [("a", 1), ("b", None), ("c", 3)]
    tables.append_rows(first, path)
    assert spark.read.parquet(path).count() == 5


def test_reload_is_idempotent(spark, tmp_path):
    star = sample.loaded_star(spark)
    for _ in range(2):
        tables.write_fact(star.readmissions, str(tmp_path / "fr"))
    stored = spark.read.parquet(str(tmp_path / "fr"))
    assert stored.count() == 24
    assert stored.select("readmission_key").distinct().count() == 24


def test_views_materialised_and_exported(spark, tmp_path):
    star = sample.loaded_star(spark)
    found = views.all_views(star)
    assert list(found) == ["vw_hospital_scorecard", "vw_readmission_trends", "vw_quality_summary",
                           "vw_satisfaction_detail", "vw_state_benchmark"]
    tables.create_views(found)
    assert spark.sql("SELECT count(*) FROM vw_hospital_scorecard WHERE avg_excess_ratio > 1.0").first()[0] == 3
    for _ in range(2):
        saved = tables.materialise(found["vw_hospital_scorecard"], "mv_hospital_scorecard")
    assert saved.count() == 10
    assert "state" in saved.where("state = 'AL'")._jdf.queryExecution().executedPlan().toString()
    tables.export_reports({n: found[n] for n in ("vw_state_benchmark", "vw_satisfaction_detail")}, str(tmp_path / "out"), "csv")
    exported = spark.read.option("header", True).csv(str(tmp_path / "out" / "vw_state_benchmark"))
    assert exported.count() == 6 and exported.columns[0] == "state"
    spark.sql("DROP TABLE mv_hospital_scorecard")
    for name in found:
        spark.catalog.dropTempView(name)


def test_load_times_are_set(spark):
    hospitals = sample.loaded_star(spark).hospitals
    assert hospitals.where(F.col("created_at").isNull() | F.col("updated_at").isNull()).count() == 0


def test_append_absent_writes_nothing_that_is_held(spark, tmp_path, monkeypatch):
    path, wanted = str(tmp_path / "t"), "array(named_struct('k', 1, 'v', 'a'), named_struct('k', CAST(NULL AS INT), 'v', 'b'))"
    held = spark.sql(f"SELECT inline({wanted})")
    tables.write_table(held, path)
    appended = []
    monkeypatch.setattr(tables, "append_rows", lambda df, *place: appended.append(sorted(rows(df), key=str)))
    tables.append_absent(held, path, ["k"])
    assert appended == []
    tables.append_absent(held.unionByName(spark.sql("SELECT 2 AS k, 'c' AS v UNION ALL SELECT 2, 'c'")), path, ["k"])
    assert appended == [[(2, "c")]]
