"""One hospital with a third of all rows, on plans that broadcast nothing."""

import pytest
import sample
from pyspark.sql import functions as F

from caregauge import schemas
from caregauge.operators import ranks, storage
from caregauge.plans import dimensions, facts, performance, views
from caregauge.schemas import QUALITY_FILE, Star
from caregauge.sources.generated import date_dimension

ROWS, HOSPITALS = 60000, 400
CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def large(spark, monkeypatch):
    for module in (storage, schemas):
        monkeypatch.setattr(module, "BROADCAST_LIMIT", 0)
    storage.configure(spark)
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


# every third row belongs to hospital 0
WHO = f"CASE WHEN id % 3 = 0 THEN 0 ELSE 1 + id % {HOSPITALS - 1} END"


def staged(spark):
    given = {
        "facility_id": f"CAST({WHO} AS STRING)",
        "measure_id": "concat('HAI-', CAST(1 + id % 6 AS STRING))",
        "score": "CASE WHEN id % 11 = 0 THEN 'Not Available' ELSE CAST(id % 97 AS STRING) END",
        "denominator": "CAST(id AS STRING)",
        "compared_to_national": f"'{sample.K.WORSE}'",
        "end_date": "'12/31/2023'",
        "start_date": "'01/01/2023'",
    }
    columns = [f"{given.get(f.name, 'CAST(NULL AS STRING)')} AS {f.name}" for f in QUALITY_FILE.fields]
    return spark.range(0, ROWS, 1, 8).selectExpr(*columns)


def hospitals(spark):
    return spark.range(HOSPITALS).selectExpr(
        "xxhash64(CAST(id AS STRING)) AS hospital_key", "CAST(id AS STRING) AS facility_id",
        "concat('Hospital ', id) AS facility_name", "'X' AS city", "concat('S', id % 7) AS state", "'T' AS hospital_type",
        "'g' AS safety_group", "'g' AS mortality_group", "CAST(1 + id % 5 AS INT) AS overall_rating",
    )


def test_load_splits_the_hot_hospital(large):
    loaded = facts.load_quality(staged(large), hospitals(large), dimensions.load_measures(large))
    per = {r[0]: r[1] for r in loaded.groupBy("hospital_key").count().collect()}
    assert sum(per.values()) == ROWS and max(per.values()) == ROWS // 3
    result = loaded.select("hospital_key", "score", "denominator")
    assert result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_queries_on_a_hot_hospital(large):
    measures = dimensions.load_measures(large)
    quality = facts.load_quality(staged(large), hospitals(large), measures)
    star = Star(hospitals=hospitals(large), dates=date_dimension(large), measures=measures, quality=quality)
    summary = views.quality_summary(star)
    totals = summary.agg(F.sum("hospitals_worse")).first()[0]
    assert totals == ROWS - len(range(0, ROWS, 11))
    assert summary.where("state = 'S0' AND measure_id = 'HAI-1'").count() == 1


def test_percentiles_of_a_hot_state(large):
    """A third of the hospitals in one state, half of their rates one value."""
    rows = large.range(0, 30000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('S', id % 50) END AS state",
        "CAST(CASE WHEN id % 2 = 0 THEN 5 ELSE id % 1000 / 10 END AS DECIMAL(8,4)) AS rate",
    )
    points = performance.QUARTILES

    df = ranks.group_percentiles(rows, ["state"], "rate", points)
    plain = rows.groupBy("state").agg(*[F.expr(f"percentile(rate, {p}D)") for p in points.values()])
    want = {r[0]: tuple(r)[1:] for r in plain.collect()}
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    window = "round(CAST(percent_rank() OVER (PARTITION BY state ORDER BY rate) * 100 AS DECIMAL(24,12)), 1)"
    ranked = ranks.percent_rank(rows, ["state"], "rate", "p").distinct().collect()
    assert sorted(map(str, ranked)) == sorted(map(str, rows.withColumn("p", F.expr(window)).distinct().collect()))
