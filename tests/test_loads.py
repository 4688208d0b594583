import sample
from conftest import rows, texts
from pyspark.sql import functions as F

from caregauge.operators.lookups import missing_from
from caregauge.plans import audits, dimensions, facts
from caregauge.schemas import HOSPITAL_FILE


def delivery(spark, records, loaded="2024-01-01"):
    blank = {f.name: None for f in HOSPITAL_FILE.fields}
    data = [tuple({**blank, **r}.values()) for r in records]
    return spark.createDataFrame(data, HOSPITAL_FILE).withColumn("raw_load_ts", F.lit(loaded).cast("timestamp"))


def test_deduplicates_cleans_and_rejects_blank_ids(spark):
    first = delivery(spark, [
        {"facility_id": "1 ", "facility_name": "old"}, {"facility_id": "  ", "facility_name": "blank"},
        {"facility_id": None, "facility_name": "none"}, {"facility_id": "2", "facility_name": "two"},
    ])
    second = delivery(spark, [{
        "facility_id": " 1", "facility_name": " new ", "city": "NEW YORK", "state": "ny ",
        "county_name": "kings COUNTY", "emergency_services": "yes",
    }], "2024-02-01")
    got = dimensions.clean_hospitals(first.unionByName(second)).orderBy("facility_id")
    assert rows(got.select("facility_id", "facility_name", "city", "state", "county_name", "emergency_services")) == [
        ("1", "new", "New york", "NY", "Kings county", True), ("2", "two", None, None, None, False),
    ]


def test_upsert_changes_only_the_refreshed_columns_and_repeats(spark):
    old = dimensions.clean_hospitals(delivery(spark, [
        {"facility_id": "1", "facility_name": "a", "hospital_overall_rating": 1, "readmission_group": "r1",
         "patient_exp_group": "p1", "mortality_group": "m1", "safety_group": "s1", "city": "x"},
        {"facility_id": "2", "facility_name": "keep", "hospital_overall_rating": 2},
    ])).cache()
    new = delivery(spark, [
        {"facility_id": "1", "facility_name": "b", "hospital_overall_rating": 5, "readmission_group": "r2",
         "patient_exp_group": None, "mortality_group": "m2", "safety_group": "s2", "city": "y"},
        {"facility_id": "3", "facility_name": "fresh", "hospital_overall_rating": 3},
    ])
    shown = ["facility_id", "facility_name", "overall_rating", "readmission_group", "patient_exp_group",
             "mortality_group", "safety_group", "city"]
    once = dimensions.upsert_hospitals(new, old)
    expected = [
        ("1", "b", 5, "r2", None, "m1", "s1", "X"), ("2", "keep", 2, None, None, None, None, None),
        ("3", "fresh", 3, None, None, None, None, None),
    ]
    assert rows(once.select(shown).orderBy("facility_id")) == expected
    assert rows(dimensions.upsert_hospitals(new, once).select(shown).orderBy("facility_id")) == expected
    assert [r.facility_id for r in dimensions.insert_hospitals(new, old).collect()] == ["3"]


def test_measures_are_inserted_once(spark):
    seeded = dimensions.load_measures(spark)
    own = seeded.where("measure_id != 'HAI-1'").unionByName(
        seeded.limit(1).withColumn("measure_id", F.lit("OWN")).withColumn("measure_key", F.lit(1).cast("bigint"))
    )
    merged = dimensions.load_measures(spark, own)
    assert merged.count() == 26 and merged.select("measure_id").distinct().count() == 26
    assert dimensions.load_measures(spark, merged).count() == 26


def test_sample_load_counts(spark):
    star = sample.loaded_star(spark)
    assert star.hospitals.count() == 10
    assert sample.staged_readmissions(spark).count() == 25
    assert star.readmissions.count() == 24
    assert star.readmissions.where("measure_key IS NULL").count() == 19
    assert dict(rows(star.readmissions.join(star.measures, "measure_key").groupBy("measure_id").count())) == {
        "READM-30-COPD-HRRP": 3, "READM-30-HIP-KNEE": 1, "READM-30-CABG": 1,
    }
    assert star.quality.count() == 26
    assert star.quality.where("score IS NULL").count() == 1
    assert star.quality.where("measure_key IS NULL").count() == 0
    assert star.satisfaction.count() == 0
    assert dict(rows(star.quality.groupBy(F.expr("end_date_key div 10000")).count())) == {2024: 14, 2023: 12}


def test_measure_ids_may_be_matched_first(spark):
    star = sample.loaded_star(spark, match_ids=True)
    assert star.readmissions.where("measure_key IS NULL").count() == 0


def test_survey_load_keeps_suppressed_rows_and_unknown_measures(spark):
    star = sample.loaded_star(spark, survey=sample.SURVEY)
    assert star.satisfaction.count() == len(sample.SURVEY) == 27
    assert star.satisfaction.where("measure_key IS NULL").count() == 3
    assert star.satisfaction.where("star_rating IS NULL AND answer_percent IS NULL").count() == 3
    assert texts(star.satisfaction.where("answer_percent = 74").select("star_rating", "answer_percent", "response_rate_pct")) == [
        ("3.0", "74.00", "23.00")
    ]


def test_audits(spark):
    star = sample.loaded_star(spark)
    assert rows(audits.star_row_counts(star)) == [
        ("dim_hospital", 10), ("fact_patient_satisfaction", 0), ("fact_quality_metrics", 26), ("fact_readmissions", 24),
    ]
    staged = sample.staged_readmissions(spark)
    assert dict(rows(audits.load_audit(staged, star.hospitals, star.readmissions))) == {
        "readmissions with no hospital match": 0, "readmissions with no measure match": 19,
    }
    fewer = star.hospitals.where("facility_id != '060001'")
    assert dict(rows(audits.load_audit(staged, fewer, star.readmissions)))["readmissions with no hospital match"] == 6
    assert facts.load_readmissions(staged, fewer, star.measures).count() == 18
    assert rows(audits.duplicate_keys(star.hospitals.unionByName(fewer.limit(1)), "facility_id")) != []
    assert rows(audits.duplicate_keys(star.hospitals, "facility_id")) == []


def test_broken_references(spark):
    star = sample.loaded_star(spark)
    found = {(r[0], r[1]): r[2] for r in audits.broken_references(star).collect()}
    assert len(found) == 12 and set(found.values()) == {0}
    broken = sample.Star(
        hospitals=missing_from(star.hospitals, star.hospitals.where("facility_id = '060001'"), "hospital_key"),
        measures=star.measures.where("measure_id != 'HAI-1'"),
        dates=star.dates.where("date_key != 20240630"),
        readmissions=star.readmissions, satisfaction=star.satisfaction, quality=star.quality,
    )
    found = {(r[0], r[1]): r[2] for r in audits.broken_references(broken).collect()}
    assert found[("fact_readmissions", "hospital_key")] == 6
    assert found[("fact_readmissions", "end_date_key")] == 24
    assert found[("fact_quality_metrics", "measure_key")] == 5
    assert found[("fact_quality_metrics", "end_date_key")] == 14
