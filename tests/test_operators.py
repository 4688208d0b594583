import random
from decimal import Decimal

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from caregauge.operators import aggregates, fanout, growth, latest, lookups, ranks, storage


def ranked_values(spark, seed=1):
    """Groups of all kinds: one hot, one constant, one single, one all NULL, a NULL key."""
    rnd = random.Random(seed)
    data = [("hot", float(rnd.randint(0, 40))) for _ in range(400)]
    data += [("hot", 7.0)] * 300 + [("hot", None)] * 20
    data += [("same", 3.0)] * 5 + [("one", 9.5)] + [("none", None)] * 3
    data += [(None, float(rnd.randint(0, 9))) for _ in range(15)]
    return data, spark.createDataFrame(data, "g string, v double").repartition(5)


def brute_percent_ranks(data):
    out = []
    for g, v in data:
        group = [x for h, x in data if h == g]
        below = sum(1 for x in group if (x is None and v is not None) or (None not in (x, v) and x < v))
        out.append((g, v, round(below / (len(group) - 1) * 100, 1) if len(group) > 1 else 0.0))
    return out


@pytest.mark.parametrize("buckets", [1, 2, 64, 1 << 20])
def test_percent_rank(spark, buckets):
    data, df = ranked_values(spark)
    got = rows(ranks.percent_rank(df, ["g"], "v", "p", buckets=buckets).select("g", "v", F.expr("CAST(p AS DOUBLE)")))
    assert sorted(map(str, got)) == sorted(map(str, brute_percent_ranks(data)))


@pytest.mark.parametrize("buckets", [1, 2, 64, 1 << 20])
def test_group_percentiles(spark, buckets):
    data, df = ranked_values(spark)
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r[1:] for r in ranks.group_percentiles(df, ["g"], "v", points, buckets=buckets).collect()}
    assert set(got) == {"hot", "same", "one", None}
    for g, found in got.items():
        known = [v for h, v in data if h == g and v is not None]
        assert found == pytest.approx([np.quantile(known, p) for p in points.values()], abs=1e-9)


@pytest.mark.parametrize("buckets", [1, 2, 64, 1 << 20])
def test_weighted_and_attached_percentiles(spark, buckets):
    df = spark.createDataFrame([("x", 1, 3), ("x", 10, 1), ("y", 5, 2)], "g string, v int, n int")
    weighted = ranks.group_percentiles(df, ["g"], "v", {"p": 0.75}, count="n", buckets=buckets)
    assert dict(rows(weighted)) == pytest.approx({"x": 3.25, "y": 5.0})
    attached = ranks.with_percentiles(df, ["g"], "v", {"p": 0.5}, buckets=buckets)
    assert sorted(rows(attached)) == [("x", 1, 3, 5.5), ("x", 10, 1, 5.5), ("y", 5, 2, 5.0)]


def test_running_counts_of_one_large_group(spark):
    df = spark.range(20000).selectExpr("'all' AS g", "id % 5000 AS v").groupBy("g", "v").agg(F.expr("count(1) AS n"))
    got = {r.v: (r.before, r.total) for r in ranks.running_counts(df, ["g"], "v", "n").collect()}
    assert got == {v: (v * 4, 20000) for v in range(5000)}


@pytest.mark.parametrize("buckets", [1, 3, 64, 1000])
def test_buckets_rise_with_the_value(spark, buckets):
    rnd = random.Random(buckets)
    numbers = [round(rnd.choice([-1, 1]) * 10 ** rnd.uniform(-5, 9), 4) for _ in range(2000)]
    numbers += [s * 2.0**k + d for k in range(-10, 40) for s in (-1, 1) for d in (-0.0001, 0, 0.0001)] + [0.0]
    df = spark.createDataFrame([(Decimal(str(round(x, 4))),) for x in numbers], "v decimal(24,4)").distinct()
    found = [r.b for r in df.select("v", F.expr(ranks.bucket_of("v", buckets)).alias("b")).orderBy("v").collect()]
    assert found == sorted(found) and len(set(found)) > 10


def test_small_sources_are_recognised(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < storage.source_bytes(df) < storage.BROADCAST_LIMIT
    joined = spark.range(10).join(storage.sent_if_small(df), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key(spark):
    data = [(" a ", 1, "old"), ("a", 2, "new"), ("b", 5, "tie1"), ("b", 5, "tie2"), ("c", None, "undated")]
    df = spark.createDataFrame(data, "k string, t int, v string")
    got = {r.key: r.v for r in latest.latest_per_key(df, "trim(k)", "t", ["v"]).collect()}
    assert got["a"] == "new" and got["b"] in ("tie1", "tie2") and got["c"] == "undated" and len(got) == 3
    again = {r.key: r.v for r in latest.latest_per_key(df.repartition(3), "trim(k)", "t", ["v"]).collect()}
    assert again == got


def test_latest_year_counts_known_days_only(spark):
    dates = spark.createDataFrame([(20230630, 2023), (20240630, 2024), (20250101, 2025)], "date_key int, year int")
    fact = spark.createDataFrame([(1, 20230630), (2, 20240630), (3, 20990101), (4, None)], "i int, end_date_key int")
    assert rows(latest.latest_year(fact, dates)) == [(2024,)]
    assert [r.i for r in latest.at_latest_year(fact, dates).collect()] == [2]


def test_year_over_year(spark):
    data = [("a", 2020, 100), ("a", 2021, 150), ("a", 2023, 90), ("b", 2020, 0), ("b", 2021, 5)]
    df = spark.createDataFrame(data, "h string, y int, v bigint")
    got = {(r.h, r.y): (r.prior_year_discharges, r.volume_change, r.yoy_growth_pct and float(r.yoy_growth_pct))
           for r in growth.year_over_year(df, ["h"], "y", "v").collect()}
    assert got == {
        ("a", 2020): (None, None, None), ("a", 2021): (100, 50, 50.0), ("a", 2023): (None, None, None),
        ("b", 2020): (None, None, None), ("b", 2021): (0, 5, None),
    }


def test_ordered_list(spark):
    data = [("a", "z", 2), ("a", "b", 1), ("a", "c", 0), ("b", "x", 0), ("c", "k", 1)]
    df = spark.createDataFrame(data, "g string, id string, n bigint")
    got = dict(rows(df.groupBy("g").agg(aggregates.ordered_list("id", "n"))))
    assert got == {"a": "b, z, z", "b": None, "c": "k"}


def test_deviation(spark):
    values = [0.934, 0.621, 0.423, 0.534, 1.456]
    df = spark.createDataFrame([("g", i % 2, str(v)) for i, v in enumerate(values)] + [("one", 0, "2")],
                               "g string, h int, t string").selectExpr("g", "h", "CAST(t AS DECIMAL(10,4)) AS v")
    per = df.groupBy("g", "h").agg(*aggregates.partials({"v": "v"}, squares=["v"]))
    got = dict(rows(per.groupBy("g").agg(aggregates.deviation("v", 4))))
    assert float(got["g"]) == round(float(np.std(values, ddof=1)), 4) and got["one"] is None


def fan_data(spark, seed):
    rnd = random.Random(seed)

    def fact(n, *columns):
        out = []
        for _ in range(n):
            out.append((rnd.randint(0, 7), *[None if rnd.random() < 0.2 else rnd.randint(1, 50) for _ in columns]))
        return spark.createDataFrame(out, "h int, " + ", ".join(f"{c} int" for c in columns))

    hospitals = spark.createDataFrame(
        [(h, f"S{h % 3}", None if h == 4 else 1 + h % 5) for h in range(9)], "h int, state string, rating int"
    )
    return hospitals, fact(30, "x", "y"), fact(12, "z"), fact(18, "w")


@pytest.mark.parametrize("seed", [1, 2])
def test_fanout_equals_the_join(spark, seed):
    hospitals, a, b, c = fan_data(spark, seed)
    naive = (
        hospitals.join(a, "h", "left").join(b, "h", "left").join(c, "h", "left").groupBy("state").agg(
            F.expr("count(DISTINCT h)"), F.expr("sum(x)"),
            *[F.expr(f"round(avg({v}), 4)") for v in "xyzw"],
            F.expr("count_if(rating = 1)"), F.expr("round(avg(rating), 4)"),
        )
    )
    spread = fanout.fanout_partials(
        hospitals, "h", {"a": (a, {"x": "x", "y": "y"}), "b": (b, {"z": "z"}), "c": (c, {"w": "w"})}
    ).selectExpr("*", "rating AS rating_sum", "IF(rating IS NULL, 0, 1) AS rating_cnt")
    ours = spread.groupBy("state").agg(
        aggregates.rows(), fanout.repeated_sum("x", "a_others"),
        *[fanout.repeated_mean(v, f"{f}_others", 4) for v, f in zip("xyzw", "aabc")],
        fanout.repeated_count("rating = 1"), fanout.repeated_mean("rating", "all_rows", 4),
    )

    def plain(df):
        return sorted([r[0], *[None if v is None else float(v) for v in r[1:]]] for r in df.collect())

    for left, right in zip(plain(naive), plain(ours)):
        assert left[0] == right[0] and left[1:] == pytest.approx(right[1:], abs=1.01e-4)


def test_fanout_of_large_products_is_exact(spark):
    """Row products far past 10^14 lose no unit."""
    df = spark.createDataFrame(
        [("s", 18314398509, 5, Decimal(10**15 + 7)), ("s", 3, 5, Decimal(2 * 10**20 + 1)), ("s", None, None, Decimal(9))],
        "state string, v_sum bigint, v_cnt bigint, others decimal(38,0)"
    )
    total, count = 18314398509 * (10**15 + 7) + 3 * (2 * 10**20 + 1), 5 * (10**15 + 7) + 5 * (2 * 10**20 + 1)
    got = df.groupBy("state").agg(
        fanout.repeated_mean("v", "others", 2).alias("m"), fanout.repeated_sum("v", "others").alias("t")
    ).first()
    assert int(got.t) == total and float(got.m) == round(total / count, 2)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_fanout_beyond_the_type_raises(spark, ansi):
    df = spark.createDataFrame([("s", 10**18, Decimal(10**30))], "state string, v_sum bigint, others decimal(38,0)")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="too large"):
            df.groupBy("state").agg(fanout.repeated_sum("v", "others")).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_deviation_of_large_moments(spark):
    """Many values far from zero and close together, where differences of doubles cancel."""
    df = spark.createDataFrame([(Decimal(10**5), 10**11 // 2), (Decimal("100000.0002"), 10**11 // 2)], "v decimal(10,4), n bigint")
    per = df.selectExpr("n AS v_cnt", "CAST(v * n AS DECIMAL(28,4)) AS v_sum", "CAST(v * v * n AS DECIMAL(38,8)) AS v_sq")
    assert float(per.agg(aggregates.deviation("v", 4)).first()[0]) == 0.0001


def test_lists_of_large_counts(spark):
    df = spark.createDataFrame([("a", "z", 3_000_000_000), ("a", "b", 1), ("b", "x", 0)], "g string, id string, n bigint")
    assert dict(rows(df.groupBy("g").agg(aggregates.counted_list("id", "n")))) == {"a": "b, z x3000000000", "b": None}
    with pytest.raises(Exception, match="cannot hold"):
        df.groupBy("g").agg(aggregates.ordered_list("id", "n")).collect()


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    other = spark.createDataFrame([(1, "x", 10)], "k int, t string, n int")
    assert sorted(rows(lookups.lookup(df, other, "k", {"t": "Not Found", "n": None}))) == [
        (1, "a", "x", 10), (2, "b", "Not Found", None), (3, "c", "Not Found", None),
    ]
    assert rows(lookups.present_in(df, other, "k")) == [(1, "a")]
    assert sorted(rows(lookups.missing_from(df, other, "k"))) == [(2, "b"), (3, "c")]
    ties = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 0)], "k string, v int")
    assert rows(lookups.top_n(ties, 2, "v", "k")) == [("a", 1), ("b", 1)]
    assert rows(lookups.pick(df, v=["a", "b"], k=None).where("k > 1")) == [(2, "b")]


def test_pivots(spark):
    df = spark.createDataFrame([("s", "A", 1.0), ("s", "A", 2.0), ("t", "B", 3.0)], "s string, c string, v double")
    wide = aggregates.spread_pivot(df, "s", "c", ["A", "B", "C"], "v", 1)
    assert wide.columns == ["s", "A", "B", "C"]
    assert sorted(rows(wide.selectExpr("s", "CAST(A AS DOUBLE)", "CAST(B AS DOUBLE)", "C"))) == [
        ("s", 1.5, None, None), ("t", None, 3.0, None),
    ]


def test_no_stage_is_left_to_the_interpreter(spark):
    """The JVM compiles no method beyond 8,000 bytes; a stage that needs one runs by operator."""
    session = storage.configure(spark.newSession())
    assert int(session.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
