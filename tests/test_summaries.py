"""Scorecards from saved sums, distinct hospitals from bitmaps, and keys looked for where they can be."""

import sample
from conftest import rows
from pyspark.sql import functions as F
from test_increments import given, write_csv  # noqa: F401

from caregauge import constants as K
from caregauge.plans import bitmaps, increments, summaries, views
from caregauge.sinks import tables


def test_refresh_reads_touched_years(spark, given, tmp_path):  # noqa: F811
    folder, place = str(tmp_path / "core"), str(tmp_path / "sums")
    staged = sample.staged_readmissions(spark)
    old = write_csv(staged, tmp_path / "old.csv", end_date="06/30/2023")
    first = increments.load_into(spark, {**given, "readmissions": old}, folder)
    summaries.refresh(first.star, place)
    card = summaries.scorecard(first.star, summaries.saved(spark, place))
    assert sorted(map(str, card.collect())) == sorted(map(str, views.hospital_scorecard(first.star).collect()))

    new = write_csv(staged, tmp_path / "new.csv", end_date="06/30/2024", number_of_discharges="500")
    second = increments.load_into(spark, {"readmissions": new}, folder)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "sums").rglob("*.parquet")}
    summaries.refresh(second.star, place, second.years)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "sums").rglob("*.parquet")}
    assert before.items() <= after.items()
    assert {f.parent.name for f in after.keys() - before.keys()} == {"end_year=2024"}
    card = summaries.scorecard(second.star, summaries.saved(spark, place))
    expected = sorted(map(str, views.hospital_scorecard(second.star).collect()))
    assert sorted(map(str, card.collect())) == expected and card.columns == views.hospital_scorecard(second.star).columns
    # the scan of the fact is told the year
    read = increments.in_years(second.star.readmissions, [2024])
    plan = summaries.summarise(read, "readmissions")._jdf.queryExecution().executedPlan().toString()
    assert "end_year" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_bitmaps_add_up(spark):
    star = sample.loaded_star(spark)
    saved = bitmaps.hospital_bitmaps(star.quality, star).cache()
    joined = star.quality.join(star.hospitals, "hospital_key").join(star.measures, "measure_key")
    joined = joined.withColumn("year", F.expr("end_date_key div 10000"))
    for by in ((), ("state",), ("year", "measure_category"), ("hospital_type", "measure_id")):
        for choices in ({}, {"year": [2024]}, {"measure_category": [K.SAFETY], "year": [2023, 2024]}):
            kept = joined
            for column, values in choices.items():
                kept = kept.where(F.col(column).isin(values))
            plain = kept.groupBy(*by).agg(F.count_distinct("hospital_key").alias("hospital_count"))
            merged = bitmaps.distinct_hospitals(saved, *by, **choices)
            assert sorted(rows(merged.where("hospital_count IS NOT NULL")), key=str) == sorted(rows(plain.where("hospital_count > 0")), key=str)


def test_numbers_are_different_and_fit(spark, monkeypatch):
    hospitals = spark.range(50_000).selectExpr("xxhash64(id) AS hospital_key")
    found = bitmaps.numbered(hospitals).agg(F.count_distinct("number"), F.min("number"), F.max("number"), F.count("*")).first()
    assert found[0] == found[3] == 50_000 and found[1] >= 1 and found[2] <= 4 * bitmaps.BITS


def test_absent_rows_are_looked_for_in_their_partitions(spark, tmp_path):
    place = str(tmp_path / "t")
    first = spark.createDataFrame([(1, 2023), (2, 2023), (1, 2024), (None, 2024)], "k int, y int")
    tables.write_table(first, place, ["y"])
    more = spark.createDataFrame([(1, 2024), (None, 2024), (3, 2024), (3, 2024), (1, None)], "k int, y int")
    for _ in range(2):
        tables.append_absent(more, place, ["k", "y"], ["y"])
        assert sorted(rows(tables.read_table(spark, place).select("k", "y")), key=str) == sorted(
            [(1, 2023), (2, 2023), (1, 2024), (None, 2024), (3, 2024), (1, None)], key=str
        )
