from conftest import rows, texts
from pyspark.sql import functions as F

from caregauge import constants as K
from caregauge.functions import calendar, clean, labels
from caregauge.sources.generated import date_dimension, measure_seed


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def applied(spark, values, column, kind="string"):
    df = one_column(spark, values, kind).select("i", column.alias("x")).orderBy("i")
    return [r.x if r.x is None else str(r.x) for r in df.collect()]


def test_suppressed_texts_become_null(spark):
    noted = [*K.SUPPRESSED, "not AVAILABLE", "  n/a ", None, "   "]
    for kind in ("int", "decimal(8,4)", "decimal(10,4)", "decimal(3,1)", "decimal(5,2)"):
        assert applied(spark, noted, clean.number("c", kind)) == [None] * len(noted)


def test_numbers(spark):
    assert applied(spark, ["1,234", "12.0", " 12 ", "99999999999"], clean.number("c", "int")) == [
        None, None, "12", None,
    ]
    assert applied(spark, ["12.34567", "123456", "0.5"], clean.number("c", "decimal(8,4)")) == [
        "12.3457", None, "0.5000",
    ]
    assert applied(spark, ["5", "999"], clean.number("c", "int", ["999"])) == ["5", None]


def test_us_dates(spark):
    given = ["06/30/2024", "6/30/2024", "2024-06-30", "junk", None, "13/45/2020", "2024", "06/2024", "6/30/24", ""]
    expected = ["2024-06-30"] * 3 + [None] * 7
    assert applied(spark, given, clean.us_date("c")) == expected


def test_text_cleaning(spark):
    assert applied(spark, [" NEW YORK ", "", None, "o"], clean.sentence_case("c")) == ["New york", "", None, "O"]
    assert applied(spark, [" al "], clean.code("c")) == ["AL"]
    assert applied(spark, ["yes ", "YES", "no", None, ""], clean.yes_flag("c")) == [
        "True", "True", "False", "False", "False",
    ]


def test_derived_rate(spark):
    df = spark.createDataFrame(
        [(103, 487), (1, 0), (None, 5), (5, None), (0, 7), (1, 800), (-1, 800), (2**31 - 1, 1)], "n int, d int"
    )
    assert [r[0] for r in texts(df.select(clean.derived_rate("n", "d")))] == [
        "21.1500", None, None, None, "0.0000", "0.1300", "-0.1300", None,
    ]


def test_ratio_is_null_for_zero(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 1)], "a int, b int")
    assert [r[0] for r in texts(df.select(clean.percent("a", "b", 1)))] == ["25.0", None, None]


def test_calendar(spark):
    dates = date_dimension(spark)
    assert dates.count() == 2922
    by_key = {r.date_key: r for r in dates.collect()}
    weeks = {20221231: 53, 20230101: 1, 20230108: 2, 20241231: 53}
    assert {k: by_key[k].week_of_year for k in weeks} == weeks
    october, september = by_key[20231001], by_key[20230930]
    assert (october.fiscal_year, october.fiscal_quarter) == (2024, 1)
    assert (september.fiscal_year, september.fiscal_quarter) == (2023, 4)
    assert (october.day_name, october.day_of_week, october.is_weekend) == ("Sunday", 1, True)
    assert (october.quarter, october.month_name) == (4, "October")
    assert applied(spark, ["2024-02-29"], calendar.date_key("CAST(c AS DATE)")) == ["20240229"]


def test_measure_seed(spark):
    seed = measure_seed(spark)
    assert seed.count() == 25
    per_category = dict(rows(seed.groupBy("measure_category").count()))
    assert per_category == {K.READMISSION: 6, K.MORTALITY: 5, K.SAFETY: 6, K.EXPERIENCE: 8}


def test_categories_of_the_seed(spark):
    seeded = measure_seed(spark).where(f"measure_category = '{K.READMISSION}'")

    def found(rules):
        label = labels.keyword_label("measure_name", rules)
        return {r[0]: r[1] for r in rows(seeded.select("measure_id", label))}

    usual = found(K.CATEGORY_RULES)
    assert usual == {
        "READM-30-HF-HRRP": "Heart Failure", "READM-30-AMI-HRRP": "Other",
        "READM-30-PN-HRRP": "Pneumonia", "READM-30-HIP-KNEE": "Orthopaedics",
        "READM-30-CABG": "Cardiac Surgery", "READM-30-COPD-HRRP": "Pulmonary",
    }
    assert found(K.CATEGORY_RULES_SHORT) == usual
    assert found(K.CATEGORY_RULES_CORRECTED) == {**usual, "READM-30-AMI-HRRP": "Acute MI"}


def test_keyword_order_and_case(spark):
    names = ["heart FAILURE with pneumonia", "gastric BYPASS", "pulmonary embolism", "nothing", None]
    long = labels.keyword_label("c", K.CATEGORY_RULES)
    short = labels.keyword_label("c", K.CATEGORY_RULES_SHORT)
    ids = labels.keyword_label("c", K.MEASURE_ID_RULES, None)
    assert applied(spark, names, long) == ["Heart Failure", "Cardiac Surgery", "Pulmonary", "Other", "Other"]
    assert applied(spark, names, short) == ["Heart Failure", "Other", "Other", "Other", "Other"]
    assert applied(spark, names, ids) == ["READM-30-HF-HRRP", "READM-30-CABG", "READM-30-COPD-HRRP", None, None]


def test_performance_tiers(spark):
    cases = [
        (5, "14.99", "4", K.TOP), (4, "14.99", "3.9", K.ABOVE), (4, "14.99", None, K.ABOVE),
        (5, None, "5", K.NO_DATA), (3, "17.99", None, K.ABOVE), (3, "18", None, K.AVERAGE),
        (3, None, None, K.AVERAGE), (5, "18.5", "5", K.AVERAGE), (2, "19.87", None, K.AVERAGE),
        (2, "14", "5", K.BELOW), (1, None, None, K.BELOW), (None, "20.01", None, K.BELOW),
        (None, "10", "5", K.NO_DATA), (None, None, None, K.NO_DATA), (5, "20.5", "5", K.BELOW),
    ]
    df = spark.createDataFrame(cases, "r int, x string, s string, wanted string").selectExpr(
        "r", "CAST(x AS DECIMAL(18,2)) AS x", "CAST(s AS DECIMAL(3,1)) AS s", "wanted"
    )
    wrong = df.where(labels.performance_tier("r", "x", "s") != F.col("wanted"))
    assert rows(wrong) == []


def test_volume_tiers_flags_and_bands(spark):
    volumes = [10000, 9999, 5000, 4999, 1000, 999, 0]
    assert applied(spark, volumes, labels.volume_tier("c"), "int") == [
        "High Volume", "Mid Volume", "Mid Volume", "Low-Mid Volume", "Low-Mid Volume", "Low Volume", "Low Volume",
    ]
    assert applied(spark, [1.1, 0.9, 1.0, None], labels.ratio_flag("c"), "double") == [
        "Above Expected", "Below Expected", "At Expected", None,
    ]
    assert applied(spark, [5, 4, 3, 2, 1, None], labels.rating_band("c"), "int") == [
        "green", "green", "yellow", "red", "red", None,
    ]


def test_texts_with_a_letter_are_no_numbers(spark):
    """None of them reaches the cast, whose exceptions cost more than all other cleaning."""
    given = ["PORT", "1e3", "1E3", "12a", "É1", " +7 ", "-7", "٣", "- 7", "--", "1.5"]
    assert applied(spark, given, clean.number("c", "int")) == [None] * 5 + ["7", "-7"] + [None] * 4
    assert applied(spark, given, clean.number("c", "decimal(3,1)"))[-1] == "1.5"
    assert "upper(c)" in str(clean.number("c", "int"))


def test_us_dates_of_other_parts(spark):
    given = ["//2024", "1//2024", "1/1/1/2024", "1/2/2024/", " 1/2/2024 ", "2024-1-1", "2024-01-1/", "1/2 x/2024", "2024-13-01"]
    assert applied(spark, given, clean.us_date("c")) == [None] * 4 + ["2024-01-02", None, None, "2024-01-02", None]
