"""Sums in buckets of the hospital: no shuffle by hospital, and refreshes of touched years."""

import uuid

import sample
from conftest import rows, texts
from pyspark.sql import functions as F

from caregauge.plans import colocated, outcomes, reports, summaries, views
from caregauge.schemas import Star
from caregauge.sinks import tables


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def by_hospital(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(hospital_key" in line]


def saved(spark, star, buckets=4):
    name = f"sums_{uuid.uuid4().hex}"
    colocated.save(star, name, buckets)
    return name


def test_views_from_buckets_equal_those_from_facts(spark):
    star = sample.loaded_star(spark)
    held, sums = colocated.opened(spark, saved(spark, star), star)
    by_state = summaries.fanned_out(held, sums, "state", "overall_rating")
    pairs = [
        (summaries.scorecard(held, sums), views.hospital_scorecard(star)),
        (views.states_of(by_state), views.state_summary(star)),
        (outcomes.benchmark_of(by_state), outcomes.state_benchmark(star)),
        (outcomes.types_of(summaries.fanned_out(held, sums, "hospital_type")), outcomes.hospital_type_comparison(star)),
    ]
    for ours, plain in pairs:
        assert ours.columns == plain.columns
        assert sorted(map(str, texts(ours))) == sorted(map(str, texts(plain)))


def test_no_shuffle_by_hospital(spark):
    """Also where no side is small enough to be sent to every task."""
    star = sample.loaded_star(spark)
    held, sums = colocated.opened(spark, saved(spark, star), star)
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        states = final_plan(views.states_of(summaries.fanned_out(held, sums, "state", "overall_rating")))
        card = final_plan(summaries.scorecard(held, sums))
        plain = final_plan(views.state_summary(star))
    finally:
        for limit in limits:
            spark.conf.unset(limit)
    assert by_hospital(plain)
    assert not by_hospital(states) and not by_hospital(card)
    assert "SortMergeJoin" in states and "SortMergeJoin" in card


def test_refresh_replaces_touched_years(spark):
    given = sample.loaded_star(spark)
    # every fact in two years, and again without an end date
    ends = F.explode(F.array(F.col("end_date_key"), F.col("end_date_key") - 10000, F.lit(None).cast("int")))
    dated = {t: tables.with_year(getattr(given, t).withColumn("end_date_key", ends)).cache() for t in summaries.VALUES}
    star = Star(hospitals=given.hospitals, dates=given.dates, measures=given.measures, **dated)
    last = {t: [2024, None] for t in dated}
    earlier = Star(hospitals=star.hospitals, **{t: f.where("end_year < 2024") for t, f in dated.items()})
    name = saved(spark, earlier)
    before = set(spark.table(f"{name}_readmissions").inputFiles())
    for _ in range(2):
        colocated.refresh(star, name, last, 4)
        spark.catalog.refreshTable(f"{name}_readmissions")
        assert before < set(spark.table(f"{name}_readmissions").inputFiles())
    held, sums = colocated.opened(spark, name, star)
    states = views.states_of(summaries.fanned_out(held, sums, "state", "overall_rating"))
    assert sorted(map(str, texts(states))) == sorted(map(str, texts(views.state_summary(star))))
    assert "Bucketed: true" in final_plan(states)


def test_totals_in_one_pass(spark):
    star = sample.loaded_star(spark)
    card = views.hospital_scorecard(star)
    found = reports.with_totals(card, "state", "hospital_type")
    by_level = {(r.level, r.state, r.hospital_type): (r.hospital_count, str(r.avg_rate)) for r in found.collect()}
    whole = rows(reports.national_average(card))[0][0]
    assert by_level[3, None, None] == (card.count(), str(whole))
    for level in (0, 1, 2):
        assert sum(n for (at, *_), (n, _) in by_level.items() if at == level) == card.count()
    assert rows(reports.with_totals(card).select("level", "hospital_count")) == [(0, card.count())]


def test_dropped_tables_are_gone(spark):
    star = sample.loaded_star(spark)
    name = saved(spark, star)
    for _ in range(2):
        colocated.drop(spark, name)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(name)]
    colocated.save(star, name, 4)  # nothing is left that would be in the way
    assert spark.table(f"{name}_hospitals").count() == star.hospitals.count()


def scans(plan):
    """The file scans of a plan as it ran, with its sub-queries; a reused exchange scans nothing."""
    name = plan.nodeName()
    if name == "ReusedExchange":
        return []
    if name.startswith("Scan"):
        return [plan.simpleString(1000)]
    inner = [plan.subqueries(), plan.children()]
    found = [seq.apply(k) for seq in inner for k in range(seq.size())]
    if name == "AdaptiveSparkPlan":
        found.append(plan.executedPlan())
    elif name.endswith("QueryStage"):
        found.append(plan.plan())
    return [s for child in found for s in scans(child)]


def test_national_comparison_scans_a_fact_once(spark, tmp_path):
    given = sample.loaded_star(spark)
    facts = {}
    for table in summaries.VALUES:
        getattr(given, table).write.parquet(str(tmp_path / table))
        facts[table] = spark.read.schema(getattr(given, table).schema).parquet(str(tmp_path / table))
    star = Star(hospitals=given.hospitals, dates=given.dates, measures=given.measures, **facts)
    card = views.hospital_scorecard(star)
    some = reports.against_national(card.where("state = 'MN'"), card)
    assert some.count() < card.count()
    some.collect()
    read = scans(some._jdf.queryExecution().executedPlan())
    assert sum("readmission_rate_pct" in s for s in read) == 1
    assert not any("answer_percent" in s or "score" in s for s in read)  # facts that the rate does not need
