"""The registered queries: library functions over the derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, ShortType, TimestampType

from caregauge import constants as K
from caregauge.operators.lookups import pick
from caregauge.operators.storage import BROADCAST_LIMIT, configure, sent_if_small, source_bytes
from caregauge.plans import (
    audits,
    bitmaps,
    colocated,
    dimensions,
    efficiency,
    facts,
    increments,
    outcomes,
    performance,
    reports,
    summaries,
    views,
)
from caregauge.schemas import HOSPITAL_FILE, READMISSION_FILE, Star
from caregauge.sinks import tables
from caregauge.sources import files

from . import scratch
from . import star as source

Query = Callable[[SparkSession, str], DataFrame]
FACILITY = "000000007"
STATES = ["NATION_3", "NATION_7"]
# The ranked queries again with few wide buckets, which must not change a row.
COARSE = 2
# Of the small tables that the registered queries save.
BUCKETS = 8


def comparable(df: DataFrame) -> DataFrame:
    """Column types any engine shows alike: bigint, double, text, boolean."""

    def plain(field) -> str:
        for kinds, shown in (
            (DecimalType, "DOUBLE"),
            ((IntegerType, ShortType), "BIGINT"),
            ((DateType, TimestampType), "STRING"),
        ):
            if isinstance(field.dataType, kinds):
                return f"CAST(`{field.name}` AS {shown}) AS `{field.name}`"
        return f"`{field.name}`"

    return df.selectExpr(*[plain(f) for f in df.schema.fields])


def _on_star(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(build(source.star(spark, sf_dir)))


def _on_files(build: Query) -> Query:
    return lambda spark, sf_dir: comparable(build(configure(spark), sf_dir))


# -- loads ---------------------------------------------------------------------------------


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.first_delivery(spark, sf_dir).unionByName(source.second_delivery(spark, sf_dir))


def _without_keys(df: DataFrame) -> DataFrame:
    return df.drop("hospital_key", "created_at", "updated_at")


def _loaded_hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.clean_hospitals(_deliveries(spark, sf_dir))


def _insert_hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = dimensions.clean_hospitals(source.second_delivery(spark, sf_dir))
    return _without_keys(
        dimensions.insert_hospitals(source.first_delivery(spark, sf_dir), existing)
    )


def _upsert_hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = dimensions.clean_hospitals(source.second_delivery(spark, sf_dir))
    return _without_keys(
        dimensions.upsert_hospitals(source.first_delivery(spark, sf_dir), existing)
    )


def _with_ids(fact: DataFrame, hospitals: DataFrame, measures: DataFrame, key: str) -> DataFrame:
    """A loaded fact with business keys in place of the surrogate ones."""
    named = F.broadcast(measures.select("measure_key", "measure_id"))
    return (
        fact.join(sent_if_small(hospitals), "hospital_key")
        .join(named, "measure_key", "left")
        .drop("hospital_key", "measure_key", "unknown_measure", key, "created_at")
    )


def _spread(staged: DataFrame) -> DataFrame:
    """Small tables have a row group or two, and so as many tasks: an exchange uses all cores. Larger
    ones have a task for each part of their files, and their text stays where it is formed."""
    return staged.hint("rebalance") if source_bytes(staged) <= BROADCAST_LIMIT else staged


def _load(staged: Query, load, key: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        hospitals = _loaded_hospitals(spark, sf_dir).select("hospital_key", "facility_id")
        measures = dimensions.load_measures(spark)
        return _with_ids(load(_spread(staged(spark, sf_dir)), hospitals, measures), hospitals, measures, key)

    return build


def _load_mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose ids differ in case from those of the hospitals, and some unusable dates."""
    lettered = F.expr("replace(facility_id, '1', 'B')")
    delivered = _deliveries(spark, sf_dir).withColumn("facility_id", lettered)
    hospitals = dimensions.clean_hospitals(delivered).select("hospital_key", "facility_id")
    measures = dimensions.load_measures(spark)
    staged = source.mixed_case(source.staged_readmissions(spark, sf_dir))
    return _with_ids(facts.load_readmissions(staged, hospitals, measures), hospitals, measures, "readmission_key")


# A delivery up to a year, and one of that year's larger rows and of all later years.
TWO_DELIVERIES = ("year(l_shipdate) <= 1996", "year(l_shipdate) > 1996 OR (year(l_shipdate) = 1996 AND l_quantity > 10)")


def _two_staged(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [source.delivered_twice(source.staged_readmissions(spark, sf_dir, rows)) for rows in TWO_DELIVERIES]


def _two_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, and a second one with later years and some of the first one's periods again."""
    hospitals = _loaded_hospitals(spark, sf_dir).select("hospital_key", "facility_id")
    measures = dimensions.load_measures(spark)
    first, second = (facts.load_readmissions(staged, hospitals, measures) for staged in _two_staged(spark, sf_dir))
    # the second one is saved, since its keys and its rows are both used
    place = f"{scratch.folder(spark)}/second"
    tables.write_table(second, place)
    second = tables.read_table(spark, place, second.schema)
    return _with_ids(facts.carried_on(first, second), hospitals, measures, "readmission_key")


def _hospital_files(spark: SparkSession, sf_dir: str, place: str) -> str:
    return scratch.delivered(source.file_of(_deliveries(spark, sf_dir).drop("raw_load_ts"), HOSPITAL_FILE), f"{place}/hospitals")


def _increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two deliveries as files, loaded into the same tables one after the other, and the second one
    again, which changes nothing; read back from the tables."""
    place = scratch.folder(spark)
    hospitals = _hospital_files(spark, sf_dir, place)
    for n, staged in enumerate([*_two_staged(spark, sf_dir), None]):
        rows = f"{place}/readmissions{min(n, 1)}"
        if staged is not None:
            scratch.delivered(source.file_of(staged, READMISSION_FILE), rows)
        files_ = {"readmissions": rows} | ({"hospitals": hospitals} if n == 0 else {})
        star = increments.load_into(spark, files_, f"{place}/core").star
    hospitals = star.hospitals.select("hospital_key", "facility_id")
    return _with_ids(star.readmissions.drop("end_year"), hospitals, star.measures, "readmission_key")


def _load_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readmission files of two column orders, one with a column less, in one folder."""
    place = f"{scratch.folder(spark)}/readmissions"
    staged = source.staged_readmissions(spark, sf_dir)
    odd = F.expr("pmod(xxhash64(facility_id, end_date), 2) = 1")
    whole = source.file_of(staged, READMISSION_FILE)
    headers = {c: c.replace("_", " ").title().replace("Id", "ID") for c in whole.columns}
    scratch.delivered(whole.where(odd), place, headers)
    scratch.delivered(staged.where(~odd).select(*staged.columns[::-1]), place, headers)
    read = files.read_staging(spark, place, READMISSION_FILE, by_name=True)
    hospitals = _loaded_hospitals(spark, sf_dir).select("hospital_key", "facility_id")
    measures = dimensions.load_measures(spark)
    return _with_ids(facts.load_readmissions(read, hospitals, measures), hospitals, measures, "readmission_key")


def _load_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readmission files in the order of the staging columns, whatever their header says."""
    whole = source.file_of(source.staged_readmissions(spark, sf_dir), READMISSION_FILE)
    place = scratch.delivered(whole, f"{scratch.folder(spark)}/readmissions", {"measure_name": "Measure", "state": "ST"})
    read = files.read_staging(spark, place, READMISSION_FILE, keep_corrupt=True)
    hospitals = _loaded_hospitals(spark, sf_dir).select("hospital_key", "facility_id")
    measures = dimensions.load_measures(spark)
    return _with_ids(facts.load_readmissions(read, hospitals, measures), hospitals, measures, "readmission_key")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact written for some years, appended to by others, and then offered all rows again by
    their keys, which adds nothing."""
    place = f"{scratch.folder(spark)}/fact"
    load = _load(source.staged_readmissions, facts.load_readmissions, "readmission_key")
    rows = load(spark, sf_dir).withColumn("hospital_key", F.xxhash64("facility_id"))
    tables.write_fact(rows.where("end_date_key < 19960000"), place)
    tables.append_fact(rows.where("end_date_key >= 19960000 OR end_date_key IS NULL"), place)
    held = spark.read.parquet(place)
    tables.append_absent(
        held.select("hospital_key", "end_date_key", "end_year", *[c for c in held.columns if c not in ("hospital_key", "end_date_key", "end_year")]),
        place, ["hospital_key", "end_date_key"], ["end_year"],
    )
    return tables.read_table(spark, place).select(rows.columns).drop("hospital_key")


def _by_view(name: str) -> Callable[[Star], DataFrame]:
    """A view by its name in SQL."""

    def build(star: Star) -> DataFrame:
        tables.create_views({name: views.all_views(star)[name]})
        return star.dates.sparkSession.sql(f"SELECT * FROM {name}")

    return build


def _materialised(star: Star) -> DataFrame:
    """The scorecard as a saved table by state, saved twice, as a refresh does."""
    card, name = views.hospital_scorecard(star), f"mv_scorecard_{uuid.uuid4().hex}"
    tables.materialise(card, name)
    return tables.materialise(card, name).select(card.columns)


def _exported(star: Star) -> DataFrame:
    """The trend view as report files, read back."""
    place, trends = scratch.folder(star.dates.sparkSession), views.readmission_trends(star)
    tables.export_reports({"vw_readmission_trends": trends}, place, "csv")
    # names with commas and quotes come back as they went
    return star.dates.sparkSession.read.schema(trends.schema).csv(f"{place}/vw_readmission_trends", header=True)


def _delivered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = files.parse_lines(source.delivered_lines(spark, sf_dir), "line", READMISSION_FILE)
    return parsed.select(
        "facility_id", "facility_name", "state", "measure_name", "number_of_discharges",
        "excess_readmission_ratio", "predicted_readmission_rate", "end_date",
        F.col(files.CORRUPT).isNotNull().alias("is_corrupt"),
    )


def _measures_after_earlier_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = source.existing_measures(spark, sf_dir)
    return dimensions.load_measures(spark, earlier).drop("measure_key")


def _load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hospitals = _loaded_hospitals(spark, sf_dir)
    staged = source.staged_readmissions(spark, sf_dir)
    fact = facts.load_readmissions(staged, hospitals, dimensions.load_measures(spark))
    return audits.load_audit(staged, hospitals, fact)


def _duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _deliveries(spark, sf_dir).select(F.trim("facility_id").alias("facility_id"))
    return audits.duplicate_keys(ids.where("facility_id != ''"), "facility_id")


def _date_dimension(star: Star) -> DataFrame:
    """Every day of the calendar with the number of readmission rows that end on it."""
    per_day = star.readmissions.groupBy("end_date_key").agg(F.count(F.lit(1)).alias("row_count"))
    return (
        star.dates.join(per_day, F.col("date_key") == F.col("end_date_key"), "left")
        .drop("end_date_key")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    )


def _measure_dimension(star: Star) -> DataFrame:
    """The seeded measures with the number of rows that use them."""
    facts_ = [star.readmissions, star.satisfaction, star.quality]
    used = None
    for fact in facts_:
        per = fact.groupBy("measure_key").agg(F.count(F.lit(1)).alias("n"))
        used = per if used is None else used.unionByName(per)
    used = used.groupBy("measure_key").agg(F.sum("n").alias("n"))
    return star.measures.join(used, "measure_key", "left").select(
        "measure_id",
        "measure_name",
        "measure_category",
        "higher_is_better",
        "unit_of_measure",
        F.coalesce(F.col("n"), F.lit(0)).alias("fact_rows"),
    )


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard from saved sums: those of every other year first, then of the years between."""
    star, place = source.star(spark, sf_dir), scratch.folder(spark)
    years = {
        t: sorted(r[0] for r in tables.with_year(getattr(star, t)).select("end_year").distinct().collect()) for t in summaries.VALUES
    }
    for half in (0, 1):
        summaries.refresh(star, place, {t: found[half::2] for t, found in years.items()})
    return summaries.scorecard(star, summaries.saved(spark, place))


def _colocated(build: Callable[[Star, dict[str, DataFrame]], DataFrame]) -> Query:
    """A view from sums in buckets of the hospital: saved for all years but each fact's last, which a
    refresh then adds."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        star, name = source.star(spark, sf_dir), f"sums_{uuid.uuid4().hex}"
        dated = {t: tables.with_year(getattr(star, t)) for t in summaries.VALUES}
        last = {t: fact.agg(F.max("end_year")).first()[0] for t, fact in dated.items()}
        earlier = {t: fact.where(F.col("end_year").isNull() | (F.col("end_year") < last[t])) for t, fact in dated.items()}
        colocated.save(Star(hospitals=star.hospitals, **earlier), name, BUCKETS)
        colocated.refresh(star, name, {t: [year] for t, year in last.items()}, BUCKETS)
        return build(*colocated.opened(spark, name, star))

    return query


def _distinct_hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hospitals by state with quality rows of two years and two categories, from saved bitmaps."""
    star, place = source.star(spark, sf_dir), scratch.folder(spark)
    tables.write_table(bitmaps.hospital_bitmaps(star.quality, star), place)
    chosen = {"year": [2023, 2024], "measure_category": [K.MORTALITY, K.SAFETY]}
    return bitmaps.distinct_hospitals(tables.read_table(spark, place), "state", **chosen)


def queries() -> dict[str, Query]:
    card, trends = views.hospital_scorecard, views.readmission_trends
    quality, detail, states = views.quality_summary, views.satisfaction_detail, views.state_summary
    on_star: dict[str, Callable[[Star], DataFrame]] = {
        # performance
        "readmit_by_hospital_latest": performance.readmission_by_hospital,
        "readmit_percentiles": performance.readmission_percentiles,
        "readmit_percentiles_range": lambda s: performance.readmission_percentiles(s, COARSE),
        "readmit_percentiles_by_group": performance.readmission_percentiles_by_group,
        "readmit_percentiles_by_group_range": lambda s: performance.readmission_percentiles_by_group(s, COARSE),
        "readmit_trend_annual": performance.readmission_trend,
        "readmit_excess_at_risk": performance.excess_readmissions,
        "satisfaction_by_hospital": performance.satisfaction_by_hospital,
        "satisfaction_state_domain": performance.satisfaction_by_state,
        "satisfaction_state_domain_range": lambda s: performance.satisfaction_by_state(s, COARSE),
        "satisfaction_trend": performance.satisfaction_trend,
        "readmit_vs_satisfaction": performance.readmission_and_satisfaction,
        # efficiency
        "discharge_volume_annual": efficiency.discharge_volume,
        "volume_yoy_growth": efficiency.volume_growth,
        "volume_by_category": efficiency.volume_by_category,
        "volume_by_category_corrected": lambda s: efficiency.volume_by_category(s, K.CATEGORY_RULES_CORRECTED),
        "utilization_intensity": efficiency.utilization_intensity,
        "utilization_intensity_range": lambda s: efficiency.utilization_intensity(s, COARSE),
        "readmission_burden": efficiency.readmission_burden,
        "readmission_burden_range": lambda s: efficiency.readmission_burden(s, buckets=COARSE),
        # outcomes
        "mortality_by_hospital": outcomes.mortality_by_hospital,
        "mortality_by_hospital_counted": lambda s: outcomes.mortality_by_hospital(s, counted=True),
        "hai_by_hospital": outcomes.infections_by_hospital,
        "quality_trend": outcomes.quality_trend,
        "scorecard_all_periods": outcomes.overall_scorecard,
        "state_peer_benchmark": outcomes.state_benchmark,
        "state_peer_benchmark_corrected": outcomes.state_benchmark_corrected,
        "hospital_type_comparison": outcomes.hospital_type_comparison,
        # views
        "vw_hospital_scorecard": card,
        "vw_readmission_trends": trends,
        "vw_quality_summary": quality,
        "vw_satisfaction_detail": detail,
        "vw_state_benchmark": states,
        "view_satisfaction_by_name": _by_view("vw_satisfaction_detail"),
        "materialised_scorecard": _materialised,
        "exported_trends": _exported,
        # documented look-ups
        "facility_readmissions": lambda s: reports.facility_readmissions(s, FACILITY),
        "hospitals_above_expected": lambda s: reports.worse_than_expected(card(s)),
        "states_by_rate": lambda s: reports.states_by_rate(states(s)),
        "top_performers": lambda s: reports.top_performers(card(s)),
        # data quality
        "core_row_counts": audits.star_row_counts,
        "referential_integrity": audits.broken_references,
        # report data sets
        "report_scorecard_survey": lambda s: reports.scorecard_with_survey(card(s), detail(s)),
        "report_scorecard_state": lambda s: reports.scorecard_with_state(card(s), states(s)),
        "report_scorecard_trends": lambda s: reports.scorecard_with_trends(card(s), trends(s)),
        "report_top20_readmission": lambda s: reports.highest_readmission_rates(card(s)),
        "report_state_map": lambda s: reports.state_map(states(s)),
        "report_average_stars": lambda s: reports.average_stars(card(s)),
        "report_survey_domains": lambda s: reports.survey_domains(detail(s)),
        "report_volume_and_rate": lambda s: reports.volume_and_rate(card(s)),
        "report_tier_distribution": lambda s: reports.tier_distribution(card(s)),
        "report_hospital_detail": lambda s: card(s, F.col("facility_id") == FACILITY),
        "report_survey_history": lambda s: reports.survey_history(s, FACILITY),
        "report_quality_history": lambda s: reports.quality_history(s, FACILITY),
        "report_hospital_history": lambda s: reports.hospital_history(s, FACILITY),
        "report_annual_volume": lambda s: reports.annual_volume(trends(s)),
        "report_annual_volume_by_state": lambda s: reports.annual_volume(trends(s), "state"),
        "report_category_volume": lambda s: reports.category_volume(trends(s)),
        "report_state_growth": lambda s: reports.state_growth(trends(s)),
        "report_state_category_matrix": lambda s: reports.state_category_matrix(trends(s)),
        "report_efficiency_ranking": lambda s: reports.efficiency_ranking(efficiency.utilization_intensity(s)),
        "report_excess_bed_days": lambda s: reports.excess_bed_days(card(s)),
        "report_volume_tiers": lambda s: reports.volume_tiers(efficiency.utilization_intensity(s)),
        "report_mortality_trend": lambda s: reports.mortality_trend(quality(s)),
        "report_infection_rates": lambda s: reports.infection_rates(quality(s)),
        "report_comparison_shares": lambda s: reports.comparison_shares(quality(s)),
        "report_hospital_types": outcomes.hospital_type_comparison,
        "report_peer_table": lambda s: reports.peer_table(card(s)),
        "report_outcome_quadrants": lambda s: reports.outcome_quadrants(card(s), 7.5, 1.0),
        "report_sliced_scorecard": lambda s: pick(
            card(s, F.col("state").isin(STATES) & F.col("hospital_type").isin("BUILDING")), performance_tier=None
        ).select("facility_id", "state", "hospital_type", "performance_tier"),
        "report_sliced_by_owner_and_tier": lambda s: pick(
            card(s, F.col("hospital_ownership") == "Owner ASIA"), performance_tier=[K.BELOW, K.AVERAGE]
        ).select("facility_id", "hospital_ownership", "performance_tier", "avg_readmission_rate_pct"),
        "report_sliced_trends": lambda s: pick(
            trends(s), year=[1996, 1997], clinical_category=["Pneumonia", "Orthopaedics"], state=STATES
        ),
        "report_sliced_utilization": lambda s: pick(
            efficiency.utilization_intensity(s), volume_tier=["Mid Volume", "Low Volume"], year=[1996]
        ).select("facility_id", "year", "volume_tier", "total_discharges"),
        "report_sliced_quality": lambda s: pick(quality(s), measure_category=[K.SAFETY], state=STATES),
        "report_sliced_comparison": lambda s: reports.comparison_counts(
            s, compared_to_national=[K.WORSE, K.SAME], measure_category=[K.MORTALITY], year=[2023, 2024]
        ),
        "report_state_survey_matrix_year": lambda s: reports.state_survey_matrix(s, years=[1996]),
        "report_national_average": lambda s: reports.national_average(card(s)),
        "report_against_national": lambda s: reports.against_national(pick(card(s), state=STATES), card(s)),
        "report_totals": lambda s: reports.with_totals(card(s), "state", "hospital_type"),
        "report_share_above_national": lambda s: reports.share_above_national(card(s)),
        "report_top_performer_count": lambda s: reports.top_performer_count(card(s)),
        "report_state_survey_matrix": reports.state_survey_matrix,
        "report_readmission_sheet": reports.readmission_sheet,
        # dimensions
        "load_date_dimension": _date_dimension,
        "load_measure_dimension": _measure_dimension,
    }
    on_files: dict[str, Query] = {
        # data whose categories end in different years
        "mortality_by_hospital_category_year": lambda spark, d: outcomes.mortality_by_hospital(
            source.star(spark, d, early=K.MORTALITY), "category"
        ),
        "hai_by_hospital_category_year": lambda spark, d: outcomes.infections_by_hospital(
            source.star(spark, d, early=K.SAFETY), "category"
        ),
        "load_readmissions_mixed_case": _load_mixed_case,
        "load_two_deliveries": _two_deliveries,
        "load_increments": _increments,
        "refreshed_scorecard": _refreshed,
        "colocated_scorecard": _colocated(summaries.scorecard),
        "colocated_states": _colocated(lambda s, sums: views.states_of(summaries.fanned_out(s, sums, "state", "overall_rating"))),
        "colocated_hospital_types": _colocated(lambda s, sums: outcomes.types_of(summaries.fanned_out(s, sums, "hospital_type"))),
        "distinct_hospitals_sliced": _distinct_hospitals,
        "load_by_header": _load_by_header,
        "load_by_position": _load_by_position,
        "load_appended": _appended,
        "parse_delivered_lines": _delivered_lines,
        "load_measures_after_earlier_load": _measures_after_earlier_load,
        "load_hospitals": lambda spark, d: _without_keys(_loaded_hospitals(spark, d)),
        "insert_new_hospitals": _insert_hospitals,
        "upsert_hospitals": _upsert_hospitals,
        "load_readmissions": _load(source.staged_readmissions, facts.load_readmissions, "readmission_key"),
        "load_satisfaction": _load(source.staged_survey, facts.load_satisfaction, "satisfaction_key"),
        "load_quality": _load(source.staged_quality, facts.load_quality, "quality_key"),
        "load_audit": _load_audit,
        "duplicate_facility_ids": _duplicate_ids,
    }
    return {n: _on_star(b) for n, b in on_star.items()} | {n: _on_files(b) for n, b in on_files.items()}
