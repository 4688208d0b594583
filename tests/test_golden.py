"""The queries on the sample deliveries, against known values."""

import pytest
import sample
from conftest import rows, texts

from caregauge import constants as K
from caregauge.plans import efficiency, outcomes, performance, reports, views


@pytest.fixture(scope="module")
def star(spark):
    return sample.loaded_star(spark)


@pytest.fixture(scope="module")
def surveyed(spark):
    return sample.loaded_star(spark, survey=sample.SURVEY)


def by_facility(df, *columns):
    return {r[0]: tuple(r[1:]) for r in texts(df.select("facility_id", *columns))}


def test_readmission_by_hospital(star):
    found = texts(performance.readmission_by_hospital(star).select(
        "facility_id", "avg_excess_readmission_ratio", "avg_readmission_rate_pct", "total_discharges",
        "total_readmissions", "measure_count",
    ))
    assert found == [
        ("010007", "1.1823", "19.87", "156", "31", "0"), ("450639", "1.0345", "18.22", "2221", "413", "0"),
        ("010001", "1.0065", "18.08", "1711", "309", "1"), ("330101", "0.9379", "16.67", "5801", "1005", "0"),
        ("010005", "0.9012", "16.43", "1108", "182", "1"), ("050625", "0.8923", "15.75", "3912", "627", "0"),
        ("140010", "0.8756", "15.15", "5319", "820", "0"), ("060001", "0.7958", "12.11", "11437", "1269", "3"),
    ]


@pytest.mark.parametrize("buckets", [2, 64])
def test_readmission_percentiles(star, buckets):
    found = {(r.measure_id, r.state, str(r.min_readmission_pct)): tuple(map(float, (r.p25, r.median_pct, r.p75)))
             for r in performance.readmission_percentiles(star, buckets).collect()}
    assert found == {
        ("READM-30-CABG", "MN", "10.21"): (10.21,) * 3, ("READM-30-COPD-HRRP", "MN", "15.81"): (15.81,) * 3,
        ("READM-30-HIP-KNEE", "MN", "4.80"): (4.8,) * 3,
        # p25 18.225 and p75 19.455 are ties
        ("READM-30-COPD-HRRP", "AL", "17.61"): (18.23, 18.84, 19.46),
        ("READM-30-COPD-HRRP", "AL", "20.07"): (18.23, 18.84, 19.46),
    }
    per_group = performance.readmission_percentiles_by_group(star, buckets)
    assert [tuple(r) for r in per_group.select("measure_id", "state", "hospital_count").collect()] == [
        ("READM-30-CABG", "MN", 1), ("READM-30-COPD-HRRP", "AL", 2), ("READM-30-COPD-HRRP", "MN", 1),
        ("READM-30-HIP-KNEE", "MN", 1),
    ]


def test_readmission_trend_and_risk(star):
    assert texts(performance.readmission_trend(star)) == [
        ("2024", "30-Day Readmission Rate - CABG Surgery", "1", "0.7645", "10.21"),
        ("2024", "30-Day Readmission Rate - COPD", "3", "0.9382", "17.83"),
        ("2024", "30-Day Readmission Rate - Hip/Knee Replacement", "1", "0.8012", "4.80"),
    ]
    assert texts(performance.excess_readmissions(star).select("facility_id", "excess_ratio", "readmission_rate_pct")) == [
        ("010001", "1.0678", "20.07")
    ]


def test_mortality_by_hospital(star):
    found = by_facility(
        outcomes.mortality_by_hospital(star), "mort_heart_failure", "mort_acute_mi", "mort_pneumonia",
        "composite_mortality_rate", "worse_than_national",
    )
    assert found == {
        "010001": ("12.4000", "13.2000", "14.8000", "13.4667", None),
        "450639": ("12.8000", None, None, "12.8000", None), "330101": ("11.8000", None, None, "11.8000", None),
        "050625": ("11.2000", None, None, "11.2000", None), "010005": ("10.2000", None, "12.1000", "11.1500", None),
        "140010": ("9.2000", "9.8000", None, "9.5000", None),
        "060001": ("8.4000", "9.1000", "10.2000", "9.2333", None), "010007": (None, None, None, None, "MORT-30-HF"),
    }


def test_latest_year_is_that_of_the_whole_fact(star):
    assert outcomes.infections_by_hospital(star).count() == 0
    of_category = by_facility(outcomes.infections_by_hospital(star, "category"), "composite_hai_sir", "hai_worse_than_national_count")
    assert of_category["010007"] == ("1.8340", "1") and of_category["060001"] == ("0.4230", "0")


def test_quality_trend(star):
    found = texts(outcomes.quality_trend(star).select(
        "year", "measure_id", "hospital_count", "national_avg_score", "score_std_dev", "min_score", "max_score",
        "better_than_national", "worse_than_national",
    ))
    assert sorted(found) == [
        ("2023", "HAI-1", "5", "0.7936", "0.4162", "0.4230", "1.4560", "3", "1"),
        ("2023", "HAI-2", "4", "1.0760", "0.5471", "0.5340", "1.8340", "1", "1"),
        ("2023", "HAI-3", "1", "0.8560", None, "0.8560", "0.8560", "0", "0"),
        ("2023", "HAI-5", "2", "0.4230", "0.1570", "0.3120", "0.5340", "2", "0"),
        ("2024", "MORT-30-AMI", "3", "10.7000", "2.1932", "9.1000", "13.2000", "2", "0"),
        ("2024", "MORT-30-HF", "8", "10.8571", "1.6521", "8.4000", "12.8000", "3", "1"),
        ("2024", "MORT-30-PN", "3", "12.3667", "2.3116", "10.2000", "14.8000", "2", "0"),
    ]


def test_scorecards(star):
    tiers = {
        **dict.fromkeys(["010005", "050625", "060001", "140010", "330101"], (K.ABOVE,)),
        **dict.fromkeys(["010001", "010006", "010007", "010008", "450639"], (K.AVERAGE,)),
    }
    assert by_facility(outcomes.overall_scorecard(star), "performance_tier") == tiers
    card = views.hospital_scorecard(star)
    assert by_facility(card, "performance_tier") == tiers
    counts = ["quality_better", "quality_worse", "quality_total"]
    none = (None, None, None)
    assert by_facility(outcomes.overall_scorecard(star), *counts) == {
        "010001": ("0", "0", "5"), "010005": ("4", "0", "4"), "010006": none, "010007": ("0", "2", "2"),
        "010008": none, "050625": ("0", "0", "2"), "060001": ("6", "0", "6"), "140010": ("3", "0", "3"),
        "330101": ("0", "0", "2"), "450639": ("0", "1", "2"),
    }
    latest = ["quality_above_national", "quality_below_national", "quality_measures_total", "avg_hai_sir"]
    assert by_facility(card, *latest) == {
        "010001": ("0", "0", "3", None), "010005": ("2", "0", "2", None), "010006": (*none, None),
        "010007": ("0", "1", "1", None), "010008": (*none, None), "050625": ("0", "0", "1", None),
        "060001": ("3", "0", "3", None), "140010": ("2", "0", "2", None), "330101": ("0", "0", "1", None),
        "450639": ("0", "0", "1", None),
    }
    assert len(card.columns) == 29


def test_state_benchmarks_multiply_rows(star):
    found = {r.state: r for r in views.state_summary(star).collect()}
    shown = {
        s: (r.hospital_count, str(r.avg_readmission_pct), int(r.total_discharges), str(r.avg_mortality_rate), str(r.avg_hai_sir),
            int(r.hospitals_5star), int(r.hospitals_3star), int(r.hospitals_1_2star), str(r.avg_overall_rating))
        for s, r in found.items()
    }
    assert shown == {
        "AL": (5, "17.48", 13299, "12.5400", "0.8404", 0, 22, 2, "3.35"),
        "CA": (1, "15.75", 7824, "11.2000", "0.8560", 0, 0, 0, "4.00"),
        "IL": (1, "15.15", 15957, "9.5000", "0.5340", 9, 0, 0, "5.00"),
        "MN": (1, "12.11", 68622, "9.2333", "0.4230", 36, 0, 0, "5.00"),
        "NY": (1, "16.67", 11602, "11.8000", "0.9120", 0, 0, 0, "4.00"),
        "TX": (1, "18.22", 4442, "12.8000", "1.4560", 0, 4, 0, "3.00"),
    }
    own = {r.state: r for r in outcomes.state_benchmark_corrected(star).collect()}
    assert [own[s].five_star_hospitals for s in ("AL", "IL", "MN")] == [0, 1, 1]
    types = {r[0]: r[1:] for r in texts(outcomes.hospital_type_comparison(star))}
    assert types[sample.ACUTE] == ("9", "0.8937", "15.15", None, "10.9120", "0.6807")
    assert types[sample.CRITICAL] == ("1", None, None, None, None, None)


def test_volume(star):
    found = {r.state: tuple(r)[3:] for r in efficiency.discharge_volume(star).collect()}
    assert {s: (v[0], v[1], int(v[2]), v[3]) for s, v in found.items()} == {
        "AL": (3, 2975, 331, 522), "CA": (1, 3912, 1956, 627), "IL": (1, 5319, 1773, 820),
        "MN": (1, 11437, 1906, 1269), "NY": (1, 5801, 2901, 1005), "TX": (1, 2221, 1111, 413),
    }
    growth = efficiency.volume_growth(star)
    assert growth.count() == 8 and growth.where("yoy_growth_pct IS NOT NULL").count() == 0


@pytest.mark.parametrize("buckets", [2, 64])
def test_utilization(star, buckets):
    found = by_facility(
        efficiency.utilization_intensity(star, buckets), "total_discharges", "conditions_tracked", "total_readmissions",
        "discharge_density", "overall_readmit_pct", "volume_tier", "efficiency_percentile",
    )
    assert found == {
        "060001": ("5677", "3", "448", "1892", "7.89", "Mid Volume", "0.0"),
        "010001": ("289", "1", "58", "289", "20.07", "Low Volume", "100.0"),
        "010005": ("176", "1", "31", "176", "17.61", "Low Volume", "50.0"),
    }
    burden = efficiency.readmission_burden(star, buckets=buckets)
    assert burden.count() == 24
    assert texts(burden.where("facility_id = '010007'").select("est_readmission_bed_days", "efficiency_percentile")) == [
        # four of the 24 rates are higher: 19 / 23
        ("143", "82.6")
    ]


def test_satisfaction(surveyed):
    assert texts(performance.satisfaction_by_hospital(surveyed).select(
        "facility_id", "overall_star_rating", "pct_recommend", "avg_communication_score", "avg_environment_score",
        "completed_surveys", "response_rate_pct",
    )) == [
        ("060001", "5.0", "93.00", "89.0", "80.5", "600", "23.00"),
        ("010001", "3.0", "75.00", "71.0", "62.5", "600", "23.00"),
    ]
    assert texts(performance.satisfaction_trend(surveyed)) == [
        ("2023", "MN", "5.00", "84.0", "1"), ("2024", "AL", "3.00", "74.0", "1"), ("2024", "MN", "5.00", "92.0", "1"),
    ]
    # one row per distinct answer, the suppressed one included
    assert performance.satisfaction_by_state(surveyed).count() == 16
    assert performance.readmission_and_satisfaction(surveyed).count() == 2
    assert views.satisfaction_detail(surveyed).count() == 24
    assert by_facility(views.hospital_scorecard(surveyed), "performance_tier")["060001"] == (K.TOP,)


def test_reports(surveyed):
    card, trends = views.hospital_scorecard(surveyed), views.readmission_trends(surveyed)
    quality = views.quality_summary(surveyed)
    assert [r.facility_id for r in reports.highest_readmission_rates(card, 2).collect()] == ["010007", "450639"]
    tiers = reports.tier_distribution(card)
    assert sum(r.hospital_count for r in tiers.collect()) == 10
    assert rows(reports.top_performer_count(card)) == [(1,)]
    assert texts(reports.average_stars(card)) == [("4.0000", "1", "5", "4")]
    assert float(reports.excess_bed_days(card).first()[0]) == pytest.approx(4656 * 4.6)
    assert rows(reports.annual_volume(trends)) == [(2024, 6142)]
    # seven hospitals have quality rows of 2024 with a score, and one has none
    assert rows(reports.share_above_national(card)) == [(0.3,)]
    assert rows(reports.share_above_national(card.where("false"))) == [(0.0,)]
    for r in reports.comparison_shares(quality).collect():
        assert float(r.pct_better + r.pct_same + r.pct_worse) == pytest.approx(100, abs=0.001)
    matrix = {r.state: r for r in reports.state_category_matrix(trends).collect()}
    assert float(matrix["MN"]["Orthopaedics"]) == 4.8 and matrix["AL"]["Orthopaedics"] is None
    assert reports.facility_readmissions(surveyed, "060001").count() == 3
    assert texts(reports.hospital_history(surveyed, "060001")) == [("060001", "2024", "11437", "1269", "12.11", "0.7958")]
    survey = {r.state: r for r in reports.state_survey_matrix(surveyed).collect()}
    assert float(survey["MN"]["H-COMP-1-A-P"]) == 84.0
    gap = {r.facility_id: float(r.difference_from_national) for r in reports.against_national(card, card).collect()
           if r.difference_from_national is not None}
    assert sum(gap.values()) == pytest.approx(0, abs=0.001)
