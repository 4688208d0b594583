"""Staging frames and a star derived from the given tables.

Customers (and, as a second delivery, suppliers) stand for hospitals, order lines for
readmission rows, orders for survey rows and events for quality rows. Every row of those
tables is used. Numbers are formed with whole-number arithmetic so that any engine gets
the same values; ``oracle.py`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caregauge import constants as K
from caregauge.functions.clean import derived_rate
from caregauge.operators.storage import configure
from caregauge.schemas import Star
from caregauge.sources.generated import date_dimension, measure_seed

FIRST_DAY, LAST_DAY = "1994-01-01", "2024-12-31"

MEASURE_IDS = [seed[0] for seed in K.MEASURE_SEED]
# Survey measure by order status and priority; an id outside the seed is left unknown.
SURVEY_MEASURES = {
    "F": [K.OVERALL_RATING, K.RECOMMEND, K.OVERALL_RATING, "H-COMP-2-A-P", K.OVERALL_RATING],
    "O": ["H-COMP-3-A-P", "H-COMP-5-A-P", K.RECOMMEND, "H-CLEAN-HSP-A-P", K.OVERALL_RATING],
    "P": [K.OVERALL_RATING, "H-CLEAN-HSP-A-P", "H-QUIET-HSP-A-P", "H-OTHER", "H-COMP-1-A-P"],
}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Quality measure by event type, below and from a value of 50.
LOW_MEASURES = {
    "view": "MORT-30-HF", "click": "MORT-30-AMI", "purchase": "MORT-30-PN",
    "signup": "MORT-30-COPD", "error": "MORT-30-CABG",
}
HIGH_MEASURES = {
    "view": "HAI-1", "click": "HAI-2", "purchase": "HAI-3", "signup": "HAI-4", "error": "HAI-5",
}
# Delivered measure names, by line number.
READMISSION_NAMES = [
    "30-day readmission, heart failure", "Acute Myocardial Infarction", "PNEUMONIA patients",
    "hip/knee replacement", "Coronary bypass (CABG)", "COPD, a pulmonary disease", "All causes",
]
SUPPRESSED_TEXTS = [
    "N/A", "not available", " Not Applicable", "Too Few to Report", "Footnote Applies ", "--", "",
]


# Column types of the given tables; stated, so that no job has to look into the files.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE,"
    " props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(c: str) -> str:
    """Nearest whole number of hundredths of a value that is not negative."""
    return f"CAST({c} * 100 + 0.5D AS BIGINT)"


def _ymd(d: str) -> str:
    return f"(year({d}) * 10000 + month({d}) * 100 + day({d}))"


def _cases(value: str, choices: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in choices.items()) + " END"


def _quoted(text: str) -> str:
    return f"'{text}'"


def _key_of(measure_id: str) -> str:
    known = measure_id in MEASURE_IDS
    return str(MEASURE_IDS.index(measure_id) + 1) if known else "NULL"


def _places(whole: str, places: int, dtype: str) -> str:
    """A whole number moved behind the decimal point."""
    step = "0." + "0" * (places - 1) + "1"
    return f"CAST(CAST({whole} AS DECIMAL(18,0)) * {step} AS {dtype})"


# -- places ------------------------------------------------------------------------------


def _placed(spark: SparkSession, sf_dir: str, name: str, nation: str) -> DataFrame:
    """With nation and region, two fixed lists of 25 and 5 rows."""
    nations, regions = (F.broadcast(table(spark, sf_dir, t)) for t in ("nation", "region"))
    placed = table(spark, sf_dir, name).join(nations, F.expr(f"{nation} = n_nationkey"))
    return placed.join(regions, F.expr("n_regionkey = r_regionkey"))


def _rating(balance: str) -> str:
    return f"CASE WHEN {balance} >= 0 THEN CAST(least(5, 1 + floor({balance} / 2000)) AS INT) END"


def _group(balance: str, low: int, high: int) -> str:
    return (
        f"CASE WHEN {balance} < {low} THEN 'Below the national average'"
        f" WHEN {balance} < {high} THEN 'Same as the national average'"
        " ELSE 'Above the national average' END"
    )


def _groups(balance: str) -> list[str]:
    return [
        f"{_group(balance, 0, 3000)} AS mortality_group",
        f"{_group(balance, 1000, 4000)} AS safety_group",
        f"{_group(balance, 2000, 5000)} AS readmission_group",
        f"{_group(balance, 3000, 6000)} AS patient_exp_group",
    ]


def hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, "customer", "c_nationkey").selectExpr(
        "c_custkey AS hospital_key",
        "substr(c_name, 10) AS facility_id",
        "upper(c_name) AS facility_name",
        "concat('Port ', lower(n_name)) AS city",
        "n_name AS state",
        "lpad(CAST(c_nationkey AS STRING), 5, '0') AS zip_code",
        "r_name AS county_name",
        "c_mktsegment AS hospital_type",
        "concat('Owner ', r_name) AS hospital_ownership",
        "c_acctbal >= 0 AS emergency_services",
        f"{_rating('c_acctbal')} AS overall_rating",
        *_groups("c_acctbal"),
    )


# -- facts -------------------------------------------------------------------------------

# Whole numbers behind a readmission row.
_OFF, _TAX = _hundredths("l_discount"), _hundredths("l_tax")
# providers differ in volume, so that every volume tier occurs
_DISCHARGES = "(CAST(l_quantity AS BIGINT) * CASE l_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END + l_linenumber)"
_READMISSIONS = f"({_DISCHARGES} * ({_TAX} + {_OFF} + 1 + l_suppkey % 10) div 100)"
_PREDICTED = f"({_hundredths('l_extendedprice')} div CAST(l_quantity AS BIGINT))"
_EXPECTED = "((l_linenumber * 2 + 8) * 10000)"
_EXCESS = f"({_PREDICTED} * 10000 div {_EXPECTED})"
_RATE = "DECIMAL(8,4)"


def readmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS hospital_key",
        "CASE WHEN l_linenumber <= 6 THEN l_linenumber END AS measure_key",
        f"{_ymd('l_shipdate')} - 10000 AS start_date_key",
        f"{_ymd('l_shipdate')} AS end_date_key",
        f"CAST(CASE WHEN {_OFF} <> 0 THEN {_DISCHARGES} END AS INT) AS number_of_discharges",
        f"CAST(CASE WHEN {_TAX} <> 0 THEN {_READMISSIONS} END AS INT) AS number_of_readmissions",
        f"{_places(_PREDICTED, 4, _RATE)} AS predicted_readmission_rate",
        f"{_places(_EXPECTED, 4, _RATE)} AS expected_readmission_rate",
        f"{_places(_EXCESS, 4, _RATE)} AS excess_readmission_ratio",
    )
    return rows.withColumn(
        "readmission_rate_pct", derived_rate("number_of_readmissions", "number_of_discharges")
    )


_CENTS = _hundredths("o_totalprice")
_STARS = "1 + floor(o_totalprice / 100000)"
_ANSWER = f"(4000 + {_CENTS} % 6000)"


def _survey_measure(shown) -> str:
    return _cases(
        "o_orderstatus",
        {
            status: _cases("o_orderpriority", dict(zip(PRIORITIES, map(shown, ids))))
            for status, ids in SURVEY_MEASURES.items()
        },
    )


def satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS hospital_key",
        f"{_survey_measure(_key_of)} AS measure_key",
        f"{_ymd('o_orderdate')} - 10000 AS start_date_key",
        f"{_ymd('o_orderdate')} AS end_date_key",
        f"CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST({_STARS} AS DECIMAL(3,1)) END"
        " AS star_rating",
        f"{_places(_ANSWER, 2, 'DECIMAL(5,2)')} AS answer_percent",
        f"CAST(100 + {_CENTS} div 10000 AS INT) AS completed_surveys",
        f"{_places(f'(1000 + {_CENTS} div 100 % 4000)', 2, 'DECIMAL(5,2)')} AS response_rate_pct",
    )


_VALUE = _hundredths("value")
_SUPPRESSED = f"event_type = 'error' AND {_VALUE} < 500"
# mortality rates at 30 and infection ratios at 1 ten-thousandth per cent
_SCORE = f"CASE WHEN {_VALUE} < 5000 THEN {_VALUE} * 30 ELSE {_VALUE} END"
_LABEL = (
    f"CASE WHEN {_VALUE} < 5000 THEN CASE WHEN {_VALUE} < 1700 THEN '{K.BETTER}'"
    f" WHEN {_VALUE} < 3400 THEN '{K.SAME}' ELSE '{K.WORSE}' END"
    f" WHEN {_VALUE} < 7000 THEN '{K.BETTER}' WHEN {_VALUE} < 10000 THEN '{K.SAME}'"
    f" WHEN {_VALUE} < 20000 THEN '{K.WORSE}' ELSE 'Not Available' END"
)
_EVENT_KEY = (
    f"({_ymd('ts')} - CASE WHEN day(ts) <= 10 THEN 20000 WHEN day(ts) <= 20 THEN 10000 ELSE 0 END)"
)


def _quality_measure(shown) -> str:
    low = _cases("event_type", {k: shown(m) for k, m in LOW_MEASURES.items()})
    high = _cases("event_type", {k: shown(m) for k, m in HIGH_MEASURES.items()})
    return (
        f"CASE WHEN {_VALUE} < 5000 THEN {low}"
        f" WHEN event_type = 'error' AND {_VALUE} >= 30000 THEN {shown('PSI-90')}"
        f" WHEN event_type = 'error' AND {_VALUE} >= 15000 THEN {shown('HAI-6')} ELSE {high} END"
    )


def quality(spark: SparkSession, sf_dir: str, early: str | None = None) -> DataFrame:
    """``early`` puts the rows of Mortality, or those of Safety, a year back."""
    key = _EVENT_KEY
    if early is not None:
        key = f"({key} - CASE WHEN {_VALUE} {'<' if early == K.MORTALITY else '>='} 5000 THEN 10000 ELSE 0 END)"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS hospital_key",
        f"{_quality_measure(_key_of)} AS measure_key",
        f"{key} - 10000 AS start_date_key",
        f"{key} AS end_date_key",
        f"CASE WHEN NOT ({_SUPPRESSED}) THEN {_places(_SCORE, 4, 'DECIMAL(10,4)')} END AS score",
        f"{_LABEL} AS compared_to_national",
    )


def measures(spark: SparkSession) -> DataFrame:
    key = _cases("measure_id", {m: _key_of(m) for m in MEASURE_IDS})
    return measure_seed(spark).selectExpr("*", f"{key} AS measure_key")


def star(spark: SparkSession, sf_dir: str, early: str | None = None) -> Star:
    configure(spark)
    return Star(
        hospitals=lambda: hospitals(spark, sf_dir),
        dates=lambda: date_dimension(spark, FIRST_DAY, LAST_DAY),
        measures=lambda: measures(spark),
        readmissions=lambda: readmissions(spark, sf_dir),
        satisfaction=lambda: satisfaction(spark, sf_dir),
        quality=lambda: quality(spark, sf_dir, early),
    )


# -- staging text ------------------------------------------------------------------------


def _delivery(rows: DataFrame, p: str, segment: str, loaded: str) -> DataFrame:
    balance = f"{p}_acctbal"
    return rows.selectExpr(
        # very low balances come without an id
        f"CASE WHEN {balance} < -900 THEN '   ' ELSE concat(' ', substr({p}_name, 10), ' ') END"
        " AS facility_id",
        f"concat('  ', {p}_name) AS facility_name",
        "concat('PORT ', n_name, '  ') AS city",
        "lower(n_name) AS state",
        "concat(' 0', CAST(n_nationkey AS STRING)) AS zip_code",
        "r_name AS county_name",
        f"{segment} AS hospital_type",
        "concat('Owner ', r_name) AS hospital_ownership",
        f"CASE WHEN {balance} >= 5000 THEN ' yes' WHEN {balance} >= 0 THEN 'No' END"
        " AS emergency_services",
        f"{_rating(balance)} AS hospital_overall_rating",
        *_groups(balance),
        f"TIMESTAMP '{loaded}' AS raw_load_ts",
    )


def first_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir, "customer", "c_nationkey")
    return _delivery(rows, "c", "c_mktsegment", "2001-09-01")


def second_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir, "supplier", "s_nationkey")
    return _delivery(rows, "s", "'SUPPLIER'", "2001-10-01")


def _us_text(d: str) -> str:
    return f"concat_ws('/', month({d}), day({d}), year({d}))"


def _facility(key: str) -> str:
    # ids of delivered facilities have nine digits, and more when they need them
    return f"concat('  ', lpad({key}, greatest(9, length({key})), '0')) AS facility_id"


def _text(c: str) -> str:
    return f"CAST({c} AS STRING)"


def mixed_case(delivered: DataFrame) -> DataFrame:
    """Some ids in another case, some dates with a part too many."""
    return delivered.withColumns(
        {
            "facility_id": F.expr("replace(facility_id, '1', 'b')"),
            "end_date": F.expr("CASE WHEN end_date LIKE '1/%' THEN concat('1/', end_date) ELSE end_date END"),
        }
    )


def delivered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a readmission file: quoted quotes and commas, some lines too short."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 50 = 0 THEN concat(o_custkey, ',short,', o_orderstatus) ELSE"
        " concat(o_custkey, ',\"St. \"\"', o_orderstatus, '\"\" Hospital, Inc\",', o_orderstatus, ',\"', o_orderpriority,"
        " ', all \\\\ causes\",', CAST(o_totalprice AS BIGINT), ',,1.5,', '\" padded \"', ',,,01/02/2020,12/31/2020') END AS line",
    )


def existing_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure dimension of an earlier load: those of the events, in lower case."""
    used = table(spark, sf_dir, "events").selectExpr(f"lower({_quality_measure(_quoted)}) AS measure_id").distinct()
    return used.where("measure_id IS NOT NULL").selectExpr(
        "measure_id", "concat('Earlier ', measure_id) AS measure_name", "'Earlier' AS measure_category",
        "true AS higher_is_better", "'%' AS unit_of_measure", "xxhash64(measure_id) AS measure_key",
    )


def staged_readmissions(spark: SparkSession, sf_dir: str, rows: str = "true") -> DataFrame:
    def nth(texts: list[str]) -> str:
        return f"element_at(array({', '.join(map(_quoted, texts))}), l_linenumber)"

    end = _us_text("l_shipdate")
    return table(spark, sf_dir, "lineitem").where(rows).selectExpr(
        _facility("l_suppkey"),
        f"{nth(READMISSION_NAMES)} AS measure_name",
        f"CASE WHEN {_OFF} = 0 THEN {nth(SUPPRESSED_TEXTS)} ELSE concat(' ', {_DISCHARGES}) END"
        " AS number_of_discharges",
        f"CASE WHEN {_TAX} = 0 THEN 'not available' ELSE {_text(_READMISSIONS)} END"
        " AS number_of_readmissions",
        # digits beyond the fourth place round away
        f"concat({_places(_PREDICTED, 4, _RATE)}, '49') AS predicted_readmission_rate",
        f"CASE WHEN l_returnflag = 'A' THEN 'N/A' ELSE {_text(_places(_EXPECTED, 4, _RATE))} END"
        " AS expected_readmission_rate",
        f"{_text(_places(_EXCESS, 4, _RATE))} AS excess_readmission_ratio",
        f"CASE WHEN {_TAX} = 1 THEN '13/45/2020' ELSE {end} END AS start_date",
        f"CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_shipdate AS DATE) AS STRING) ELSE {end} END"
        " AS end_date",
    )


def file_of(staged: DataFrame, schema: StructType) -> DataFrame:
    """Staged text with all columns of a delivered file, in its order; those it has no text for are NULL."""
    return staged.select(*[F.col(c) if c in staged.columns else F.lit(None).cast("string").alias(c) for c in schema.names])


def delivered_twice(staged: DataFrame) -> DataFrame:
    """Two unknown measures rather than one, by the parity of the row's number of discharges."""
    odd = F.expr("try_cast(trim(number_of_discharges) AS INT) % 2 = 1 AND measure_name = 'All causes'")
    return staged.withColumn("measure_name", F.when(odd, "Any other cause").otherwise(F.col("measure_name")))


def staged_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        _facility("o_custkey"),
        f"concat({_survey_measure(_quoted)}, ' ') AS hcahps_measure_id",
        f"CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Not Available' ELSE {_text(_STARS)} END"
        " AS patient_survey_star_rating",
        f"{_text(_places(_ANSWER, 2, 'DECIMAL(5,2)'))} AS hcahps_answer_percent",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'FOOTNOTE APPLIES'"
        f" ELSE {_text(f'100 + {_CENTS} div 10000')} END AS number_of_completed_surveys",
        f"{_text(f'10 + {_CENTS} div 100 % 40')} AS survey_response_rate_percent",
        f"{_us_text('o_orderdate')} AS start_date",
        f"{_us_text('o_orderdate')} AS end_date",
    )


def staged_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shown(whole: str) -> str:
        text = _text(_places(whole, 4, "DECIMAL(18,4)"))
        return f"CASE WHEN {_SUPPRESSED} THEN 'Not Available' ELSE {text} END"

    key = _EVENT_KEY
    day = f"concat_ws('/', {key} div 100 % 100, {key} % 100, {key} div 10000)"
    return table(spark, sf_dir, "events").selectExpr(
        _facility("user_id"),
        "concat(' ', event_type, ' ') AS condition",
        f"{_quality_measure(_quoted)} AS measure_id",
        f"{_LABEL} AS compared_to_national",
        f"CASE WHEN {_SUPPRESSED} THEN 'Too Few to Report' ELSE {_text(_VALUE)} END AS denominator",
        f"{shown(_SCORE)} AS score",
        f"{shown(f'({_SCORE}) - 1')} AS lower_estimate",
        f"{shown(f'({_SCORE}) + 1')} AS higher_estimate",
        f"{day} AS start_date",
        f"{day} AS end_date",
    )
