"""SQL with the same meaning as the registered queries, for DuckDB.

The common part derives hospitals, measures, calendar and facts from the given tables;
``R``, ``S`` and ``Q`` are the facts with hospital, calendar and (left) measure columns.
Fan-out queries are written as the plain joins they stand for.
"""

from __future__ import annotations

from caregauge import constants as K

from .star import FIRST_DAY, HIGH_MEASURES, LOW_MEASURES, MEASURE_IDS, PRIORITIES, SURVEY_MEASURES


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24,12)), {n}) AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def listed(ids) -> str:
    return ", ".join(text(i) for i in ids)


def _cases(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in pairs.items()) + " END"


def _key(measure_id: str) -> str:
    return str(MEASURE_IDS.index(measure_id) + 1) if measure_id in MEASURE_IDS else "NULL"


def _group(balance: str, low: int, high: int) -> str:
    return (
        f"CASE WHEN {balance} < {low} THEN 'Below the national average'"
        f" WHEN {balance} < {high} THEN 'Same as the national average'"
        " ELSE 'Above the national average' END"
    )


def _rating(balance: str) -> str:
    return f"CASE WHEN {balance} >= 0 THEN CAST(least(5, 1 + floor({balance} / 2000)) AS INTEGER) END"


def _survey(value) -> str:
    return _cases(
        "o_orderstatus",
        {
            s: _cases("o_orderpriority", {p: value(m) for p, m in zip(PRIORITIES, ids)})
            for s, ids in SURVEY_MEASURES.items()
        },
    )


def _quality_measure(value) -> str:
    low = _cases("event_type", {k: value(m) for k, m in LOW_MEASURES.items()})
    high = _cases("event_type", {k: value(m) for k, m in HIGH_MEASURES.items()})
    return (
        f"CASE WHEN cents < 5000 THEN {low}"
        f" WHEN event_type = 'error' AND cents >= 30000 THEN {value('PSI-90')}"
        f" WHEN event_type = 'error' AND cents >= 15000 THEN {value('HAI-6')} ELSE {high} END"
    )


def _category(column: str, rules) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"{column} ILIKE '%{w}%'" for w in words) + f" THEN {text(label)}"
        for words, label in rules
    )
    return f"CASE {whens} ELSE 'Other' END"


def _ymd(d: str) -> str:
    return f"(year({d}) * 10000 + month({d}) * 100 + day({d}))"


_seed = ", ".join(
    f"({i}, {text(m)}, {text(n)}, {text(c)}, {str(h).lower()}, {text(u)})"
    for i, (m, n, c, h, u) in enumerate(K.MEASURE_SEED, 1)
)

COMMON = f"""
hosp AS (
  SELECT c_custkey AS hospital_key, substr(c_name, 10) AS facility_id,
         upper(c_name) AS facility_name, 'Port ' || lower(n_name) AS city, n_name AS state,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip_code, r_name AS county_name,
         c_mktsegment AS hospital_type, 'Owner ' || r_name AS hospital_ownership,
         c_acctbal >= 0 AS emergency_services, {_rating('c_acctbal')} AS overall_rating,
         {_group('c_acctbal', 0, 3000)} AS mortality_group,
         {_group('c_acctbal', 1000, 4000)} AS safety_group,
         {_group('c_acctbal', 2000, 5000)} AS readmission_group,
         {_group('c_acctbal', 3000, 6000)} AS patient_exp_group
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
meas AS (
  SELECT * FROM (VALUES {_seed})
    AS t(measure_key, measure_id, measure_name, measure_category, higher_is_better, unit_of_measure)
),
cal AS (
  SELECT {_ymd('d')} AS date_key, CAST(d AS DATE) AS full_date, year(d) AS year, quarter(d) AS quarter
  FROM range(TIMESTAMP '{FIRST_DAY}', TIMESTAMP '2025-01-01', INTERVAL 1 DAY) t(d)
),
line0 AS (
  SELECT *, CAST(round(l_discount * 100) AS BIGINT) AS off_, CAST(round(l_tax * 100) AS BIGINT) AS tax_,
         CAST(l_quantity AS BIGINT) * CASE l_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END
           + l_linenumber AS d_,
         CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS p_,
         (l_linenumber * 2 + 8) * 10000 AS e_
  FROM lineitem
),
fr AS (
  SELECT l_suppkey AS hospital_key,
         CASE WHEN l_linenumber <= 6 THEN l_linenumber END AS measure_key,
         {_ymd('l_shipdate')} AS end_date_key,
         CASE WHEN off_ <> 0 THEN d_ END AS discharges,
         CASE WHEN tax_ <> 0 THEN d_ * (tax_ + off_ + 1 + l_suppkey % 10) // 100 END AS readmissions,
         CAST(p_ AS DECIMAL(14,0)) * 0.0001 AS predicted,
         CAST(e_ AS DECIMAL(14,0)) * 0.0001 AS expected,
         CAST(p_ * 10000 // e_ AS DECIMAL(14,0)) * 0.0001 AS excess,
         CASE WHEN off_ <> 0 AND tax_ <> 0
              THEN CAST((20000 * (d_ * (tax_ + off_ + 1 + l_suppkey % 10) // 100) + d_) // (2 * d_) AS DECIMAL(14,0)) * 0.01
         END AS rate
  FROM line0
),
fs AS (
  SELECT o_custkey AS hospital_key, {_survey(_key)} AS measure_key,
         {_ymd('o_orderdate')} AS end_date_key,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
              THEN CAST(1 + floor(o_totalprice / 100000) AS DECIMAL(3,1)) END AS stars,
         CAST(4000 + CAST(round(o_totalprice * 100) AS BIGINT) % 6000 AS DECIMAL(14,0)) * 0.01 AS answer,
         100 + CAST(round(o_totalprice * 100) AS BIGINT) // 10000 AS surveys,
         CAST(1000 + CAST(round(o_totalprice * 100) AS BIGINT) // 100 % 4000 AS DECIMAL(14,0)) * 0.01 AS response
  FROM orders
),
event0 AS (
  SELECT *, CAST(round(value * 100) AS BIGINT) AS cents,
         {_ymd('ts')} - CASE WHEN day(ts) <= 10 THEN 20000 WHEN day(ts) <= 20 THEN 10000 ELSE 0 END AS key_
  FROM events
),
qm AS (
  SELECT user_id AS hospital_key, {_quality_measure(_key)} AS measure_key, key_ AS end_date_key,
         CASE WHEN NOT (event_type = 'error' AND cents < 500)
              THEN CAST(CASE WHEN cents < 5000 THEN cents * 30 ELSE cents END AS DECIMAL(14,0)) * 0.0001
         END AS score,
         CASE WHEN cents < 5000
              THEN CASE WHEN cents < 1700 THEN '{K.BETTER}' WHEN cents < 3400 THEN '{K.SAME}' ELSE '{K.WORSE}' END
              WHEN cents < 7000 THEN '{K.BETTER}' WHEN cents < 10000 THEN '{K.SAME}'
              WHEN cents < 20000 THEN '{K.WORSE}' ELSE 'Not Available' END AS label
  FROM event0
),
R AS (SELECT * FROM fr JOIN hosp USING (hospital_key) JOIN cal ON end_date_key = date_key LEFT JOIN meas USING (measure_key)),
S AS (SELECT * FROM fs JOIN hosp USING (hospital_key) JOIN cal ON end_date_key = date_key LEFT JOIN meas USING (measure_key)),
Q AS (SELECT * FROM qm JOIN hosp USING (hospital_key) JOIN cal ON end_date_key = date_key LEFT JOIN meas USING (measure_key))
"""


def q(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([COMMON.strip(), *ctes]) + "\n" + body


def latest(fact: str) -> str:
    return f"year = (SELECT max(year) FROM cal WHERE date_key IN (SELECT end_date_key FROM {fact}))"


BETTER, SAME, WORSE = (f"label = '{x}'" for x in (K.BETTER, K.SAME, K.WORSE))


def tier(rating: str, rate: str, stars: str) -> str:
    return (
        f"CASE WHEN {rating} >= 4 AND coalesce({rate}, 99) < 15 AND coalesce({stars}, 0) >= 4 THEN '{K.TOP}'"
        f" WHEN {rating} >= 3 AND coalesce({rate}, 99) < 18 THEN '{K.ABOVE}'"
        f" WHEN {rating} = 3 OR {rate} BETWEEN 15 AND 20 THEN '{K.AVERAGE}'"
        f" WHEN {rating} <= 2 OR coalesce({rate}, 0) > 20 THEN '{K.BELOW}' ELSE '{K.NO_DATA}' END"
    )


def pick(id_: str, value: str) -> str:
    return f"max(CASE WHEN measure_id = '{id_}' THEN {value} END)"


def over(ids, value: str) -> str:
    return f"avg(CASE WHEN measure_id IN ({listed(ids)}) THEN {value} END)"


# -- building blocks shared by several queries ---------------------------------------------

_scorecard = f"""scorecard AS (
  SELECT facility_id, facility_name, city, state, zip_code, county_name, hospital_type,
         hospital_ownership, emergency_services, {big('overall_rating')} AS overall_rating,
         readmission_group, safety_group, mortality_group, patient_exp_group,
         rate AS avg_readmission_rate_pct, excess AS avg_excess_ratio, total_discharges,
         total_readmissions, overall_star_rating, pct_would_recommend, avg_communication_pct,
         avg_environment_pct, avg_mortality_rate, avg_hai_sir, quality_above_national,
         quality_below_national, quality_measures_total,
         {r('quality_above_national * 100.0 / quality_measures_total', 1)} AS pct_above_national,
         {tier('overall_rating', 'rate', 'overall_star_rating')} AS performance_tier
  FROM hosp
  LEFT JOIN (SELECT hospital_key, {r('avg(rate)', 2)} AS rate, {r('avg(excess)', 4)} AS excess,
                    {big('sum(discharges)')} AS total_discharges,
                    {big('sum(readmissions)')} AS total_readmissions
             FROM R WHERE {latest('fr')} GROUP BY 1) USING (hospital_key)
  LEFT JOIN (SELECT hospital_key, {dbl(pick(K.OVERALL_RATING, 'stars'))} AS overall_star_rating,
                    {dbl(pick(K.RECOMMEND, 'answer'))} AS pct_would_recommend,
                    {r(over(K.COMMUNICATION, 'answer'), 1)} AS avg_communication_pct,
                    {r(over(K.ENVIRONMENT, 'answer'), 1)} AS avg_environment_pct
             FROM S WHERE measure_id IS NOT NULL AND {latest('fs')} GROUP BY 1) USING (hospital_key)
  LEFT JOIN (SELECT hospital_key,
                    {r("avg(CASE WHEN measure_category = 'Mortality' THEN score END)", 4)} AS avg_mortality_rate,
                    {r("avg(CASE WHEN measure_category = 'Safety' THEN score END)", 4)} AS avg_hai_sir,
                    count(*) FILTER ({BETTER}) AS quality_above_national,
                    count(*) FILTER ({WORSE}) AS quality_below_national,
                    count(*) AS quality_measures_total
             FROM Q WHERE measure_id IS NOT NULL AND {latest('qm')} GROUP BY 1) USING (hospital_key)
)"""

_trends = f"""trends AS (
  SELECT year, quarter, state, hospital_type, measure_id, measure_name,
         {_category('measure_name', K.CATEGORY_RULES_SHORT)} AS clinical_category,
         count(DISTINCT hospital_key) AS hospital_count, {big('sum(discharges)')} AS total_discharges,
         {big('sum(readmissions)')} AS total_readmissions, {r('avg(rate)', 2)} AS avg_readmission_pct,
         {r('avg(excess)', 4)} AS avg_excess_ratio
  FROM R WHERE measure_id IS NOT NULL AND discharges IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7
)"""

_quality = f"""quality_summary AS (
  SELECT year, state, hospital_type, measure_category, measure_id, measure_name,
         count(DISTINCT hospital_key) AS hospital_count, {r('avg(score)', 4)} AS national_avg_score,
         {r('stddev_samp(score)', 4)} AS score_std_dev, {dbl('min(score)')} AS min_score,
         {dbl('max(score)')} AS max_score, count(*) FILTER ({BETTER}) AS hospitals_better,
         count(*) FILTER ({SAME}) AS hospitals_same, count(*) FILTER ({WORSE}) AS hospitals_worse,
         {r(f'count(*) FILTER ({BETTER}) * 100.0 / count(*)', 1)} AS pct_better_than_national
  FROM Q WHERE measure_id IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6
)"""

_detail = f"""detail AS (
  SELECT year, facility_id, facility_name, city, state, hospital_type, patient_exp_group, measure_id,
         measure_name, {r('avg(stars)', 2)} AS avg_star_rating, {r('avg(answer)', 1)} AS avg_answer_pct,
         max(surveys) AS completed_surveys, {dbl('max(response)')} AS response_rate_pct
  FROM S WHERE measure_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9
)"""

_product = """product AS (
  SELECT h.*, rate, excess, discharges, stars, answer, score, ms.measure_id AS survey_id, mq.measure_category AS kind
  FROM hosp h LEFT JOIN fr USING (hospital_key) LEFT JOIN fs USING (hospital_key)
  LEFT JOIN qm USING (hospital_key)
  LEFT JOIN meas ms ON fs.measure_key = ms.measure_key LEFT JOIN meas mq ON qm.measure_key = mq.measure_key
)"""

_mort = r("avg(CASE WHEN kind = 'Mortality' THEN score END)", 4)
_hai = r("avg(CASE WHEN kind = 'Safety' THEN score END)", 4)

_states = f"""states AS (
  SELECT state, count(DISTINCT hospital_key) AS hospital_count,
         {r('avg(overall_rating)', 2)} AS avg_overall_rating, {r('avg(rate)', 2)} AS avg_readmission_pct,
         {r('avg(excess)', 4)} AS avg_excess_ratio, {dbl('sum(discharges)')} AS total_discharges,
         {r('avg(stars)', 2)} AS avg_star_rating,
         {r(f"avg(CASE WHEN survey_id = '{K.RECOMMEND}' THEN answer END)", 1)} AS avg_pct_recommend,
         {_mort} AS avg_mortality_rate, {_hai} AS avg_hai_sir,
         {dbl('count(*) FILTER (overall_rating = 5)')} AS hospitals_5star,
         {dbl('count(*) FILTER (overall_rating = 4)')} AS hospitals_4star,
         {dbl('count(*) FILTER (overall_rating = 3)')} AS hospitals_3star,
         {dbl('count(*) FILTER (overall_rating <= 2)')} AS hospitals_1_2star
  FROM product GROUP BY state
)"""

_use = f"""use0 AS (
  SELECT facility_id, facility_name, city, state, hospital_type, year,
         {big('sum(discharges)')} AS total_discharges, count(DISTINCT measure_key) AS conditions_tracked,
         {big('sum(readmissions)')} AS total_readmissions
  FROM R WHERE measure_id IS NOT NULL AND discharges IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6
),
utilization AS (
  SELECT *, {r('total_discharges / conditions_tracked', 0)} AS discharge_density,
         {r('total_readmissions * 100 / total_discharges', 2)} AS overall_readmit_pct,
         CASE WHEN total_discharges >= 10000 THEN 'High Volume' WHEN total_discharges >= 5000 THEN 'Mid Volume'
              WHEN total_discharges >= 1000 THEN 'Low-Mid Volume' ELSE 'Low Volume' END AS volume_tier,
         {r('percent_rank() OVER (PARTITION BY year ORDER BY total_readmissions / total_discharges NULLS FIRST) * 100', 1)}
           AS efficiency_percentile
  FROM use0
)"""

_rates = f"""rates AS (
  SELECT measure_name, measure_id, state, rate, count(DISTINCT hospital_key) AS hospital_count,
         {r('avg(excess)', 4)} AS excess_
  FROM R WHERE measure_category = 'Readmission' AND {latest('fr')} GROUP BY 1, 2, 3, 4
)"""


def _quantiles(value: str, part: str) -> str:
    return ", ".join(
        f"{r(f'quantile_cont({value}, {p}) OVER (PARTITION BY {part})', 2)} AS {n}"
        for n, p in (("p25", 0.25), ("median_pct", 0.5), ("p75", 0.75))
    )


_percentiles = q(
    f"""SELECT measure_name, measure_id, state, hospital_count, excess_ AS national_avg_excess_ratio,
    {dbl('rate')} AS national_avg_readmission_pct, {dbl('rate')} AS min_readmission_pct,
    {dbl('rate')} AS max_readmission_pct, {_quantiles('CAST(rate AS DOUBLE)', 'measure_id, state')} FROM rates""",
    _rates,
)
_by_state = q(
    f"""SELECT state, measure_id, measure_name, count(DISTINCT hospital_key) AS hospital_count,
    {r('avg(answer)', 1)} AS avg_pct_always, {r('avg(stars)', 2)} AS avg_star_rating,
    {r('quantile_cont(CAST(answer AS DOUBLE), 0.5) OVER (PARTITION BY state, measure_id)', 1)} AS median_pct_always
    FROM S WHERE measure_category = 'Patient Experience' AND {latest('fs')}
    GROUP BY state, measure_id, measure_name, answer"""
)
_utilization = q("SELECT * FROM utilization", _use)
_burden = q(
    f"""SELECT facility_id, facility_name, state, year, {big('sum(discharges)')} AS total_discharges,
    {big('sum(readmissions)')} AS total_readmissions, {dbl('rate')} AS avg_readmission_pct,
    {r('sum(readmissions) * 4.6', 0)} AS est_readmission_bed_days,
    {r('percent_rank() OVER (PARTITION BY year ORDER BY avg(rate) NULLS FIRST) * 100', 1)} AS efficiency_percentile
    FROM R WHERE discharges IS NOT NULL GROUP BY facility_id, facility_name, state, year, rate"""
)


def _yoy(source: str, keys: str, current: str = "current_year") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {cols}, a.year AS {current}, a.v AS current_discharges, b.v AS prior_year_discharges,
    a.v - b.v AS volume_change, {r('(a.v - b.v) * 100 / nullif(b.v, 0)', 2)} AS yoy_growth_pct
    FROM {source} a LEFT JOIN {source} b ON {on} AND a.year = b.year + 1"""


def _volume_by_category(rules) -> str:
    return q(
        f"""SELECT year, {_category('measure_name', rules)} AS clinical_category, state,
        count(DISTINCT hospital_key) AS hospital_count, {big('sum(discharges)')} AS total_discharges,
        {big('sum(readmissions)')} AS total_readmissions, {r('avg(rate)', 2)} AS avg_readmission_pct
        FROM R WHERE measure_id IS NOT NULL AND discharges IS NOT NULL GROUP BY 1, 2, 3"""
    )


def _outcome(category: str, columns: dict[str, str], group: str, composite: str, last: str, scope: str = "qm") -> str:
    cells = ", ".join(f"{dbl(pick(m, 'score'))} AS {c}" for c, m in columns.items())
    return q(
        f"""SELECT facility_id, facility_name, city, state, hospital_type, {group}, {cells},
        {r('avg(score)', 4)} AS {composite}, {last}
        FROM Q WHERE measure_category = '{category}' AND {latest(scope)} GROUP BY 1, 2, 3, 4, 5, 6""",
    )


def _worse_list() -> str:
    return f"string_agg(CASE WHEN {WORSE} THEN measure_id END, ', ' ORDER BY measure_id) AS worse_than_national"


def _worse_count() -> str:
    return f"count(*) FILTER ({WORSE}) AS hai_worse_than_national_count"


def _of_category(category: str) -> str:
    return f"(SELECT qm.* FROM qm JOIN meas USING (measure_key) WHERE measure_category = '{category}') AS c"


# -- loads ---------------------------------------------------------------------------------


def _delivery(table: str, p: str, segment: str, no: int) -> str:
    return f"""SELECT substr({p}_name, 10) AS facility_id, {p}_name AS facility_name,
    'Port ' || lower(n_name) AS city, n_name AS state, '0' || CAST(n_nationkey AS VARCHAR) AS zip_code,
    upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AS county_name, {segment} AS hospital_type,
    'Owner ' || r_name AS hospital_ownership, {p}_acctbal >= 5000 AS emergency_services,
    {big(_rating(f'{p}_acctbal'))} AS overall_rating,
    {_group(f'{p}_acctbal', 0, 3000)} AS mortality_group, {_group(f'{p}_acctbal', 1000, 4000)} AS safety_group,
    {_group(f'{p}_acctbal', 2000, 5000)} AS readmission_group,
    {_group(f'{p}_acctbal', 3000, 6000)} AS patient_exp_group, {no} AS load_no
    FROM {table} JOIN nation ON {p}_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE {p}_acctbal >= -900"""


_loads = f"""first_ AS ({_delivery('customer', 'c', 'c_mktsegment', 1)}),
second_ AS ({_delivery('supplier', 's', "'SUPPLIER'", 2)}),
known AS (SELECT facility_id FROM first_ UNION SELECT facility_id FROM second_),
keyed AS (SELECT facility_id, CAST(facility_id AS BIGINT) AS hospital_key FROM known)"""

_hospital_load = q(
    """SELECT * EXCLUDE (load_no, n) FROM (
      SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY load_no DESC) AS n
      FROM (SELECT * FROM first_ UNION ALL SELECT * FROM second_)) WHERE n = 1""",
    _loads,
)
_hospital_insert = q(
    """SELECT * EXCLUDE (load_no) FROM first_
    WHERE NOT EXISTS (SELECT 1 FROM second_ WHERE second_.facility_id = first_.facility_id)""",
    _loads,
)
_pick_old = ", ".join(
    f"CASE WHEN o.facility_id IS NULL THEN n.{c} ELSE o.{c} END AS {c}"
    for c in (
        "city state zip_code county_name hospital_type hospital_ownership emergency_services"
        " mortality_group safety_group"
    ).split()
)
_pick_new = ", ".join(
    f"CASE WHEN n.facility_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}"
    for c in "facility_name overall_rating readmission_group patient_exp_group".split()
)
_hospital_upsert = q(
    f"""SELECT coalesce(o.facility_id, n.facility_id) AS facility_id, {_pick_old}, {_pick_new}
    FROM second_ o FULL JOIN first_ n ON o.facility_id = n.facility_id""",
    _loads,
)
_readmission_load = q(
    f"""SELECT facility_id, measure_id,
    {big(f"CASE WHEN tax_ <> 1 THEN {_ymd('l_shipdate')} END")} AS start_date_key,
    {big(_ymd('l_shipdate'))} AS end_date_key, d_ AS number_of_discharges,
    CASE WHEN tax_ <> 0 THEN d_ * (tax_ + off_ + 1 + l_suppkey % 10) // 100 END AS number_of_readmissions,
    {dbl('CAST(p_ AS DECIMAL(14,0)) * 0.0001')} AS predicted_readmission_rate,
    CASE WHEN l_returnflag <> 'A' THEN {dbl('CAST(e_ AS DECIMAL(14,0)) * 0.0001')} END AS expected_readmission_rate,
    {dbl('CAST(p_ * 10000 // e_ AS DECIMAL(14,0)) * 0.0001')} AS excess_readmission_ratio,
    CASE WHEN tax_ <> 0
         THEN {dbl('CAST((20000 * (d_ * (tax_ + off_ + 1 + l_suppkey % 10) // 100) + d_) // (2 * d_) AS DECIMAL(14,0)) * 0.01')}
    END AS readmission_rate_pct
    FROM line0 JOIN keyed ON l_suppkey = hospital_key
    LEFT JOIN meas ON measure_key = l_linenumber AND l_linenumber <= 6 WHERE off_ <> 0""",
    _loads,
)
_survey_load = q(
    f"""SELECT facility_id, measure_id, {big(_ymd('o_orderdate'))} AS start_date_key,
    {big(_ymd('o_orderdate'))} AS end_date_key, {dbl('stars')} AS star_rating, {dbl('answer')} AS answer_percent,
    surveys AS completed_surveys, response AS response_rate_pct
    FROM (SELECT o_orderdate, o_custkey AS hospital_key, {_survey(_key)} AS measure_key,
      CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 1 + floor(o_totalprice / 100000) END AS stars,
      CAST(4000 + CAST(round(o_totalprice * 100) AS BIGINT) % 6000 AS DECIMAL(14,0)) * 0.01 AS answer,
      CASE WHEN o_orderpriority <> '5-LOW' THEN 100 + CAST(round(o_totalprice * 100) AS BIGINT) // 10000 END AS surveys,
      CAST(10 + CAST(round(o_totalprice * 100) AS BIGINT) // 100 % 40 AS DOUBLE) AS response FROM orders) s
    JOIN keyed USING (hospital_key) LEFT JOIN meas USING (measure_key)""",
    _loads,
)


def _scored(delta: int) -> str:
    return dbl(
        "CASE WHEN NOT (event_type = 'error' AND cents < 500) THEN"
        f" CAST((CASE WHEN cents < 5000 THEN cents * 30 ELSE cents END) + ({delta}) AS DECIMAL(14,0)) * 0.0001 END"
    )


_quality_load = q(
    f"""SELECT facility_id, measure_id, {big('key_')} AS start_date_key, {big('key_')} AS end_date_key,
    condition, score, lower_estimate, higher_estimate, denominator, compared_to_national
    FROM (SELECT user_id AS hospital_key, {_quality_measure(_key)} AS measure_key, key_, event_type AS condition,
      {_scored(0)} AS score, {_scored(-1)} AS lower_estimate, {_scored(1)} AS higher_estimate,
      CASE WHEN NOT (event_type = 'error' AND cents < 500) THEN cents END AS denominator,
      CASE WHEN cents < 5000
           THEN CASE WHEN cents < 1700 THEN '{K.BETTER}' WHEN cents < 3400 THEN '{K.SAME}' ELSE '{K.WORSE}' END
           WHEN cents < 7000 THEN '{K.BETTER}' WHEN cents < 10000 THEN '{K.SAME}'
           WHEN cents < 20000 THEN '{K.WORSE}' ELSE 'Not Available' END AS compared_to_national
      FROM event0) e JOIN keyed USING (hospital_key) LEFT JOIN meas USING (measure_key)""",
    _loads,
)


# -- all -----------------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    # performance
    out["readmit_by_hospital_latest"] = q(
        f"""SELECT facility_id, facility_name, city, state, hospital_type, readmission_group,
        {r('avg(excess)', 4)} AS avg_excess_readmission_ratio, {r('avg(rate)', 2)} AS avg_readmission_rate_pct,
        {r('avg(predicted)', 4)} AS avg_predicted_rate, {r('avg(expected)', 4)} AS avg_expected_rate,
        {big('sum(discharges)')} AS total_discharges, {big('sum(readmissions)')} AS total_readmissions,
        count(DISTINCT measure_key) AS measure_count
        FROM R WHERE {latest('fr')} GROUP BY 1, 2, 3, 4, 5, 6"""
    )
    out["readmit_percentiles"] = _percentiles
    out["readmit_percentiles_range"] = _percentiles
    by_group = q(
        f"""SELECT measure_name, measure_id, state, count(DISTINCT hospital_key) AS hospital_count,
        {r('avg(rate)', 2)} AS avg_readmission_pct, {dbl('min(rate)')} AS min_readmission_pct,
        {dbl('max(rate)')} AS max_readmission_pct,
        {r('quantile_cont(CAST(rate AS DOUBLE), 0.25)', 2)} AS p25, {r('quantile_cont(CAST(rate AS DOUBLE), 0.5)', 2)} AS median_pct,
        {r('quantile_cont(CAST(rate AS DOUBLE), 0.75)', 2)} AS p75
        FROM R WHERE measure_category = 'Readmission' AND {latest('fr')} GROUP BY 1, 2, 3"""
    )
    out["readmit_percentiles_by_group"] = by_group
    out["readmit_percentiles_by_group_range"] = by_group
    out["readmit_trend_annual"] = q(
        f"""SELECT year, measure_name, count(DISTINCT hospital_key) AS hospital_count,
        {r('avg(excess)', 4)} AS avg_excess_ratio, {r('avg(rate)', 2)} AS avg_readmission_pct
        FROM R WHERE measure_category = 'Readmission' GROUP BY 1, 2"""
    )
    out["readmit_excess_at_risk"] = q(
        f"""SELECT facility_id, facility_name, city, state, hospital_type, measure_name,
        {dbl('excess')} AS excess_ratio, {dbl('rate')} AS readmission_rate_pct,
        discharges AS number_of_discharges, readmissions AS number_of_readmissions
        FROM R WHERE measure_id IS NOT NULL AND excess > 1.0 AND {latest('fr')}"""
    )
    out["satisfaction_by_hospital"] = q(
        f"""SELECT facility_id, facility_name, city, state, hospital_type, patient_exp_group,
        {dbl(pick(K.OVERALL_RATING, 'stars'))} AS overall_star_rating,
        {dbl(pick(K.RECOMMEND, 'answer'))} AS pct_recommend,
        {r(over(K.COMMUNICATION, 'answer'), 1)} AS avg_communication_score,
        {r(over(K.ENVIRONMENT, 'answer'), 1)} AS avg_environment_score,
        max(surveys) AS completed_surveys, {dbl('max(response)')} AS response_rate_pct
        FROM S WHERE measure_id IS NOT NULL AND {latest('fs')} GROUP BY 1, 2, 3, 4, 5, 6"""
    )
    out["satisfaction_state_domain"] = _by_state
    out["satisfaction_state_domain_range"] = _by_state
    out["satisfaction_trend"] = q(
        f"""SELECT year, state, {r('avg(stars)', 2)} AS avg_star_rating, {r('avg(answer)', 1)} AS avg_answer_pct,
        count(DISTINCT hospital_key) AS hospital_count
        FROM S WHERE measure_id = '{K.OVERALL_RATING}' GROUP BY 1, 2"""
    )
    out["readmit_vs_satisfaction"] = q(
        "SELECT facility_id, facility_name, state, hospital_type, avg_readmission_rate_pct AS avg_readmission_pct,"
        " avg_excess_ratio, overall_star_rating, pct_would_recommend FROM scorecard"
        " WHERE avg_readmission_rate_pct IS NOT NULL AND overall_star_rating IS NOT NULL",
        _scorecard,
    )

    # efficiency
    out["discharge_volume_annual"] = q(
        f"""SELECT year, state, hospital_type, count(DISTINCT hospital_key) AS hospital_count,
        {big('sum(discharges)')} AS total_discharges, {r('avg(discharges)', 0)} AS avg_discharges_per_hospital,
        {big('sum(readmissions)')} AS total_readmissions
        FROM R WHERE discharges IS NOT NULL GROUP BY 1, 2, 3"""
    )
    out["volume_yoy_growth"] = q(
        _yoy("v", "facility_id, facility_name, state"),
        f"""v AS (SELECT facility_id, facility_name, state, year, {big('sum(discharges)')} AS v
        FROM R WHERE discharges IS NOT NULL GROUP BY 1, 2, 3, 4)""",
    )
    out["volume_by_category"] = _volume_by_category(K.CATEGORY_RULES)
    out["volume_by_category_corrected"] = _volume_by_category(K.CATEGORY_RULES_CORRECTED)
    out["utilization_intensity"] = _utilization
    out["utilization_intensity_range"] = _utilization
    out["readmission_burden"] = _burden
    out["readmission_burden_range"] = _burden

    # outcomes
    mort = ("Mortality", K.MORTALITY_COLUMNS, "mortality_group", "composite_mortality_rate", _worse_list())
    hai = ("Safety", K.INFECTION_COLUMNS, "safety_group", "composite_hai_sir", _worse_count())
    out["mortality_by_hospital"] = _outcome(*mort)
    counts = (
        "(SELECT hospital_key, string_agg(measure_id || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ', ' ORDER BY measure_id)"
        f" AS counted FROM (SELECT hospital_key, measure_id, count(*) AS n FROM Q WHERE {WORSE}"
        f" AND measure_category = 'Mortality' AND {latest('qm')} GROUP BY 1, 2) GROUP BY 1)"
    )
    out["mortality_by_hospital_counted"] = (
        f"WITH plain AS ({_outcome(*mort)}), {COMMON.strip()}"
        " SELECT plain.* REPLACE (counted AS worse_than_national) FROM plain JOIN hosp USING (facility_id)"
        f" LEFT JOIN {counts} USING (hospital_key)"
    )
    early = "ELSE 0 END - CASE WHEN CAST(round(value * 100) AS BIGINT) {} 5000 THEN 10000 ELSE 0 END AS key_"
    out["mortality_by_hospital_category_year"] = _outcome(*mort, _of_category("Mortality")).replace(
        "ELSE 0 END AS key_", early.format("<")
    )
    out["hai_by_hospital"] = _outcome(*hai)
    out["hai_by_hospital_category_year"] = _outcome(*hai, _of_category("Safety")).replace(
        "ELSE 0 END AS key_", early.format(">=")
    )
    out["quality_trend"] = q(
        f"""SELECT year, measure_category, measure_id, measure_name, count(DISTINCT hospital_key) AS hospital_count,
        {r('avg(score)', 4)} AS national_avg_score, {r('stddev_samp(score)', 4)} AS score_std_dev,
        {dbl('min(score)')} AS min_score, {dbl('max(score)')} AS max_score,
        count(*) FILTER ({BETTER}) AS better_than_national, count(*) FILTER ({SAME}) AS same_as_national,
        count(*) FILTER ({WORSE}) AS worse_than_national
        FROM Q WHERE measure_id IS NOT NULL GROUP BY 1, 2, 3, 4"""
    )
    out["scorecard_all_periods"] = q(
        f"""SELECT facility_id, facility_name, city, state, hospital_type, hospital_ownership,
        {big('overall_rating')} AS overall_rating, rate AS avg_readmission_pct, stars AS overall_stars,
        quality_better, quality_worse, quality_total,
        {r('quality_better * 100.0 / quality_total', 1)} AS pct_quality_above_national,
        {tier('overall_rating', 'rate', 'stars')} AS performance_tier
        FROM hosp
        LEFT JOIN (SELECT hospital_key, {r('avg(rate)', 2)} AS rate FROM fr GROUP BY 1) USING (hospital_key)
        LEFT JOIN (SELECT hospital_key, {dbl(pick(K.OVERALL_RATING, 'stars'))} AS stars
                   FROM fs JOIN meas USING (measure_key) GROUP BY 1) USING (hospital_key)
        LEFT JOIN (SELECT hospital_key, count(*) FILTER ({BETTER}) AS quality_better,
                   count(*) FILTER ({WORSE}) AS quality_worse, count(*) AS quality_total
                   FROM qm GROUP BY 1) USING (hospital_key)"""
    )
    out["state_peer_benchmark"] = q(
        f"""SELECT state, count(DISTINCT hospital_key) AS hospital_count,
        {r('avg(rate)', 2)} AS state_avg_readmission_pct, {r('avg(excess)', 4)} AS state_avg_excess_ratio,
        {r('avg(stars)', 2)} AS state_avg_star_rating, {_mort} AS state_avg_mortality, {_hai} AS state_avg_hai_sir,
        {dbl('count(*) FILTER (overall_rating = 5)')} AS five_star_hospitals,
        {dbl('count(*) FILTER (overall_rating = 4)')} AS four_star_hospitals,
        {dbl('count(*) FILTER (overall_rating <= 2)')} AS low_rated_hospitals
        FROM product GROUP BY state""",
        _product,
    )
    own = lambda fact, cols: f"(SELECT state, {cols} FROM {fact} JOIN hosp USING (hospital_key) LEFT JOIN meas USING (measure_key) GROUP BY 1)"
    out["state_peer_benchmark_corrected"] = q(
        f"""SELECT * FROM (SELECT state, count(*) AS hospital_count, count(*) FILTER (overall_rating = 5) AS five_star_hospitals,
          count(*) FILTER (overall_rating = 4) AS four_star_hospitals,
          count(*) FILTER (overall_rating <= 2) AS low_rated_hospitals FROM hosp GROUP BY 1)
        LEFT JOIN {own('fr', f"{r('avg(rate)', 2)} AS state_avg_readmission_pct, {r('avg(excess)', 4)} AS state_avg_excess_ratio")} USING (state)
        LEFT JOIN {own('fs', f"{r('avg(stars)', 2)} AS state_avg_star_rating")} USING (state)
        LEFT JOIN {own('qm', f"{_mort.replace('kind', 'measure_category')} AS state_avg_mortality, {_hai.replace('kind', 'measure_category')} AS state_avg_hai_sir")} USING (state)"""
    )
    out["hospital_type_comparison"] = q(
        f"""SELECT hospital_type, count(DISTINCT hospital_key) AS hospital_count,
        {r('avg(excess)', 4)} AS avg_excess_readmission_ratio, {r('avg(rate)', 2)} AS avg_readmission_pct,
        {r('avg(stars)', 2)} AS avg_satisfaction_stars, {_mort} AS avg_mortality_rate, {_hai} AS avg_hai_sir
        FROM product GROUP BY 1""",
        _product,
    )

    # views
    out["vw_hospital_scorecard"] = q("SELECT * FROM scorecard", _scorecard)
    out["vw_readmission_trends"] = q("SELECT * FROM trends", _trends)
    out["vw_quality_summary"] = q("SELECT * FROM quality_summary", _quality)
    out["vw_satisfaction_detail"] = q("SELECT * FROM detail", _detail)
    out["vw_state_benchmark"] = q("SELECT * FROM states", _product, _states)

    # documented look-ups
    out["facility_readmissions"] = q(
        f"""SELECT facility_name, state, measure_name, {dbl('rate')} AS readmission_rate_pct,
        {dbl('excess')} AS excess_readmission_ratio
        FROM R WHERE facility_id = '000000007' AND measure_id IS NOT NULL"""
    )
    out["hospitals_above_expected"] = q(
        "SELECT facility_name, state, avg_readmission_rate_pct, avg_excess_ratio FROM scorecard WHERE avg_excess_ratio > 1.0",
        _scorecard,
    )
    out["states_by_rate"] = out["vw_state_benchmark"]
    out["top_performers"] = q(
        "SELECT facility_name, state, hospital_type, overall_star_rating, avg_readmission_rate_pct, avg_mortality_rate,"
        f" performance_tier FROM scorecard WHERE performance_tier = '{K.TOP}'",
        _scorecard,
    )

    # data quality
    out["core_row_counts"] = q(
        """SELECT 'dim_hospital' AS table_name, count(*) AS row_count FROM hosp
        UNION ALL SELECT 'fact_readmissions', count(*) FROM fr
        UNION ALL SELECT 'fact_patient_satisfaction', count(*) FROM fs
        UNION ALL SELECT 'fact_quality_metrics', count(*) FROM qm"""
    )
    out["load_audit"] = q(
        """SELECT 'readmissions with no hospital match' AS issue, count(*) AS cnt
        FROM line0 WHERE l_suppkey NOT IN (SELECT hospital_key FROM keyed)
        UNION ALL SELECT 'readmissions with no measure match', count(*)
        FROM line0 JOIN keyed ON l_suppkey = hospital_key WHERE off_ <> 0 AND l_linenumber > 6""",
        _loads,
    )
    out["duplicate_facility_ids"] = """SELECT facility_id, count(*) AS row_count
        FROM (SELECT substr(c_name, 10) AS facility_id FROM customer WHERE c_acctbal >= -900
              UNION ALL SELECT substr(s_name, 10) FROM supplier WHERE s_acctbal >= -900)
        GROUP BY 1 HAVING count(*) > 1"""

    def broken(fact: str, name: str) -> str:
        shown = {
            "hospital_key": "hospital_key NOT IN (SELECT hospital_key FROM hosp)",
            "measure_key": "measure_key NOT IN (SELECT measure_key FROM meas)",
            "start_date_key": "end_date_key - 10000 NOT IN (SELECT date_key FROM cal)",
            "end_date_key": "end_date_key NOT IN (SELECT date_key FROM cal)",
        }
        return " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{k}' AS key_name, count(*) AS row_count FROM {fact} WHERE {c}"
            for k, c in shown.items()
        )

    out["referential_integrity"] = q(
        " UNION ALL ".join(
            [
                broken("fr", "fact_readmissions"),
                broken("fs", "fact_patient_satisfaction"),
                broken("qm", "fact_quality_metrics"),
            ]
        )
    )

    # report data sets
    card = lambda body: q(body, _scorecard)
    trend = lambda body, *more: q(body, _trends, *more)
    out["report_scorecard_survey"] = q(
        "SELECT c.facility_id, c.facility_name, c.state, performance_tier, year, measure_id, measure_name,"
        " avg_star_rating, avg_answer_pct FROM scorecard c LEFT JOIN detail d ON c.facility_id = d.facility_id",
        _scorecard,
        _detail,
    )
    beside = "avg_readmission_pct avg_excess_ratio avg_star_rating avg_mortality_rate avg_hai_sir".split()
    out["report_scorecard_state"] = q(
        "SELECT facility_id, facility_name, c.state, avg_readmission_rate_pct, c.avg_excess_ratio,"
        " overall_star_rating, performance_tier, "
        + ", ".join(f"s.{c} AS state_{c}" for c in beside)
        + " FROM scorecard c LEFT JOIN states s ON c.state = s.state",
        _scorecard,
        _product,
        _states,
    )
    out["report_scorecard_trends"] = q(
        f"""SELECT facility_id, c.state, c.hospital_type, performance_tier, t.year,
        {big('sum(t.total_discharges)')} AS peer_discharges, {big('sum(t.total_readmissions)')} AS peer_readmissions
        FROM scorecard c LEFT JOIN trends t ON c.state = t.state AND c.hospital_type = t.hospital_type
        GROUP BY 1, 2, 3, 4, 5""",
        _scorecard,
        _trends,
    )
    out["report_top20_readmission"] = card(
        "SELECT facility_id, facility_name, avg_readmission_rate_pct FROM scorecard"
        " ORDER BY avg_readmission_rate_pct DESC NULLS LAST, facility_id LIMIT 20"
    )
    out["report_state_map"] = q(
        "SELECT state, avg_readmission_pct, avg_overall_rating FROM states", _product, _states
    )
    out["report_average_stars"] = card(
        f"SELECT {r('avg(overall_star_rating)', 4)} AS avg_star_rating, CAST(1 AS BIGINT) AS low, CAST(5 AS BIGINT) AS high,"
        " CAST(4 AS BIGINT) AS target FROM scorecard"
    )
    out["report_survey_domains"] = q(
        f"SELECT measure_name, {r('avg(CAST(avg_answer_pct AS DECIMAL(10,1)))', 4)} AS avg_answer_pct FROM detail"
        f" WHERE measure_id IN ({listed(K.DOMAINS)}) GROUP BY 1",
        _detail,
    )
    out["report_volume_and_rate"] = card(
        "SELECT facility_id, facility_name, total_discharges, avg_readmission_rate_pct FROM scorecard"
    )
    out["report_tier_distribution"] = card(
        "SELECT performance_tier, count(*) AS hospital_count FROM scorecard GROUP BY 1"
    )
    out["report_hospital_detail"] = card("SELECT * FROM scorecard WHERE facility_id = '000000007'")
    out["report_hospital_history"] = q(
        f"""SELECT facility_id, year, {big('sum(discharges)')} AS total_discharges,
        {big('sum(readmissions)')} AS total_readmissions, {r('avg(rate)', 2)} AS avg_readmission_pct,
        {r('avg(excess)', 4)} AS avg_excess_ratio FROM R WHERE facility_id = '000000007' GROUP BY 1, 2"""
    )
    out["report_survey_history"] = q(
        f"""SELECT facility_id, year, measure_id, measure_name, {r('avg(stars)', 2)} AS avg_star_rating,
        {r('avg(answer)', 1)} AS avg_answer_pct, max(surveys) AS completed_surveys
        FROM S WHERE facility_id = '000000007' AND measure_id IS NOT NULL GROUP BY 1, 2, 3, 4"""
    )
    out["report_quality_history"] = q(
        f"""SELECT facility_id, year, measure_category, measure_id, {r('avg(score)', 4)} AS avg_score,
        count(*) FILTER ({BETTER}) AS better, count(*) FILTER ({WORSE}) AS worse
        FROM Q WHERE facility_id = '000000007' AND measure_id IS NOT NULL GROUP BY 1, 2, 3, 4"""
    )
    out["report_sliced_by_owner_and_tier"] = card(
        "SELECT facility_id, hospital_ownership, performance_tier, avg_readmission_rate_pct FROM scorecard"
        f" WHERE hospital_ownership = 'Owner ASIA' AND performance_tier IN ('{K.BELOW}', '{K.AVERAGE}')"
    )
    states_ = "state IN ('NATION_3', 'NATION_7')"
    out["report_sliced_trends"] = trend(
        f"SELECT * FROM trends WHERE year IN (1996, 1997) AND clinical_category IN ('Pneumonia', 'Orthopaedics') AND {states_}"
    )
    out["report_sliced_utilization"] = q(
        "SELECT facility_id, year, volume_tier, total_discharges FROM utilization"
        " WHERE volume_tier IN ('Mid Volume', 'Low Volume') AND year = 1996",
        _use,
    )
    out["report_sliced_quality"] = q(
        f"SELECT * FROM quality_summary WHERE measure_category = 'Safety' AND {states_}", _quality
    )
    out["report_sliced_comparison"] = q(
        f"""SELECT measure_id, label AS compared_to_national, count(*) AS row_count FROM qm
        JOIN cal ON end_date_key = date_key JOIN meas USING (measure_key)
        WHERE label IN ('{K.WORSE}', '{K.SAME}') AND measure_category = 'Mortality' AND year IN (2023, 2024) GROUP BY 1, 2"""
    )
    total = big("sum(total_discharges)") + " AS total_discharges"
    out["report_annual_volume"] = trend(f"SELECT year, {total} FROM trends GROUP BY 1")
    out["report_annual_volume_by_state"] = trend(f"SELECT year, state, {total} FROM trends GROUP BY 1, 2")
    out["report_category_volume"] = trend(f"SELECT year, clinical_category, {total} FROM trends GROUP BY 1, 2")
    out["report_state_growth"] = trend(
        _yoy("sv", "state"),
        f"sv AS (SELECT state, year, {big('sum(total_discharges)')} AS v FROM trends GROUP BY 1, 2)",
    )
    cells = ", ".join(
        r(f"avg(CASE WHEN clinical_category = {text(c)} THEN CAST(avg_readmission_pct AS DECIMAL(10,2)) END)", 4)
        + f' AS "{c}"'
        for c in K.CATEGORIES
    )
    out["report_state_category_matrix"] = trend(f"SELECT state, {cells} FROM trends GROUP BY 1")
    out["report_efficiency_ranking"] = q(
        "SELECT year, facility_id, facility_name, efficiency_percentile FROM utilization", _use
    )
    out["report_excess_bed_days"] = card(
        f"SELECT {dbl('sum(total_readmissions * 4.6)')} AS total_excess_bed_days FROM scorecard"
    )
    out["report_volume_tiers"] = q(
        "SELECT volume_tier, count(DISTINCT facility_id) AS hospital_count FROM utilization GROUP BY 1", _use
    )
    score = r("avg(CAST(national_avg_score AS DECIMAL(18,4)))", 4) + " AS avg_score"
    out["report_mortality_trend"] = q(
        f"SELECT year, measure_name, {score} FROM quality_summary WHERE measure_category = 'Mortality' GROUP BY 1, 2",
        _quality,
    )
    out["report_infection_rates"] = q(
        f"SELECT measure_name, {score}, 1.0::DOUBLE AS reference FROM quality_summary"
        " WHERE measure_category = 'Safety' GROUP BY 1",
        _quality,
    )
    shares = ", ".join(
        r(f"sum(hospitals_{k}) * 100.0 / nullif(sum(hospitals_better + hospitals_same + hospitals_worse), 0)", 4)
        + f" AS pct_{k}"
        for k in ("better", "same", "worse")
    )
    out["report_comparison_shares"] = q(
        f"SELECT measure_name, {shares} FROM quality_summary GROUP BY 1", _quality
    )
    out["report_peer_table"] = card(
        "SELECT facility_id, facility_name, state, hospital_type, avg_readmission_rate_pct, avg_excess_ratio,"
        " overall_star_rating, avg_mortality_rate, avg_hai_sir, pct_above_national, performance_tier FROM scorecard"
    )
    out["report_outcome_quadrants"] = card(
        "SELECT facility_id, avg_mortality_rate, avg_hai_sir, avg_mortality_rate > 7.5 AS high_mortality,"
        " avg_hai_sir > 1.0 AS high_hai FROM scorecard"
        " WHERE avg_mortality_rate IS NOT NULL AND avg_hai_sir IS NOT NULL"
    )
    out["report_sliced_scorecard"] = card(
        "SELECT facility_id, state, hospital_type, performance_tier FROM scorecard"
        " WHERE state IN ('NATION_3', 'NATION_7') AND hospital_type = 'BUILDING'"
    )
    avg_rate = "avg(CAST(avg_readmission_rate_pct AS DECIMAL(10,2)))"
    out["report_national_average"] = card(
        f"SELECT {r(avg_rate, 4)} AS national_avg_rate FROM scorecard"
    )
    out["report_against_national"] = card(
        "SELECT facility_id, state, avg_readmission_rate_pct,"
        f" {r(f'CAST(avg_readmission_rate_pct AS DECIMAL(10,2)) - (SELECT round(CAST({avg_rate} AS DECIMAL(24,12)), 4) FROM scorecard)', 4)}"
        " AS difference_from_national FROM scorecard WHERE state IN ('NATION_3', 'NATION_7')"
    )
    out["report_totals"] = card(
        f"SELECT state, hospital_type, {big('grouping(state, hospital_type)')} AS level, count(*) AS hospital_count,"
        f" {r(avg_rate, 4)} AS avg_rate, {big('sum(total_discharges)')} AS total_discharges,"
        f" count(*) FILTER (performance_tier = '{K.TOP}') AS top_performers"
        " FROM scorecard GROUP BY CUBE (state, hospital_type)"
    )
    out["report_share_above_national"] = card(
        f"SELECT {r('count(*) FILTER (pct_above_national > 50) / count(*)', 6)} AS share_above FROM scorecard"
    )
    out["report_top_performer_count"] = card(
        f"SELECT count(*) FILTER (performance_tier = '{K.TOP}') AS top_performers FROM scorecard"
    )
    experience = [m[0] for m in K.MEASURE_SEED if m[2] == K.EXPERIENCE]
    cells = ", ".join(
        r(f"avg(CASE WHEN measure_id = '{m}' THEN answer END)", 4) + f' AS "{m}"' for m in experience
    )
    out["report_state_survey_matrix"] = q(
        f"SELECT state, {cells} FROM fs JOIN hosp USING (hospital_key) JOIN meas USING (measure_key) GROUP BY 1"
    )
    out["report_state_survey_matrix_year"] = out["report_state_survey_matrix"].replace(
        "JOIN meas USING (measure_key) GROUP BY 1", "JOIN meas USING (measure_key) WHERE end_date_key // 10000 = 1996 GROUP BY 1"
    )
    out["report_readmission_sheet"] = q(
        f"""SELECT hospital_key, {dbl('rate')} AS readmission_rate_pct,
        CASE WHEN excess > 1 THEN 'Above Expected' WHEN excess < 1 THEN 'Below Expected' ELSE 'At Expected' END AS ratio_flag,
        coalesce(hospital_type, 'Not Found') AS hospital_type,
        CASE WHEN overall_rating >= 4 THEN 'green' WHEN overall_rating = 3 THEN 'yellow'
             WHEN overall_rating <= 2 THEN 'red' END AS rating_band
        FROM fr LEFT JOIN hosp USING (hospital_key)"""
    )

    # loads
    out["load_date_dimension"] = q(
        f"""SELECT date_key, CAST(full_date AS VARCHAR) AS full_date, year, quarter, month(full_date) AS month, monthname(full_date) AS month_name,
        (dayofyear(full_date) + dayofweek(date_trunc('year', full_date)) - 1) // 7 + 1 AS week_of_year,
        dayofweek(full_date) + 1 AS day_of_week, dayname(full_date) AS day_name,
        dayofweek(full_date) IN (0, 6) AS is_weekend,
        year + CASE WHEN month(full_date) >= 10 THEN 1 ELSE 0 END AS fiscal_year,
        CASE WHEN month(full_date) >= 10 THEN 1 ELSE (month(full_date) + 2) // 3 + 1 END AS fiscal_quarter,
        coalesce(n, 0) AS row_count
        FROM cal LEFT JOIN (SELECT end_date_key, count(*) AS n FROM fr GROUP BY 1) ON end_date_key = date_key"""
    )
    names = "measure_id, measure_name, measure_category, higher_is_better, unit_of_measure"
    out["load_measures_after_earlier_load"] = q(
        f"""SELECT * FROM earlier UNION ALL SELECT {names} FROM meas
        WHERE lower(measure_id) NOT IN (SELECT measure_id FROM earlier)""",
        f"""earlier AS (SELECT DISTINCT lower(m) AS measure_id, 'Earlier ' || lower(m) AS measure_name,
        'Earlier' AS measure_category, true AS higher_is_better, '%' AS unit_of_measure
        FROM (SELECT {_quality_measure(text)} AS m FROM event0) WHERE m IS NOT NULL)""",
    )
    lettered = _readmission_load.replace("SELECT facility_id, measure_id,", "SELECT replace(facility_id, '1', 'B') AS facility_id, measure_id,", 1)
    out["load_readmissions_mixed_case"] = lettered.replace(
        big(_ymd("l_shipdate")) + " AS end_date_key",
        big(f"CASE WHEN l_returnflag = 'A' OR month(l_shipdate) <> 1 THEN {_ymd('l_shipdate')} END") + " AS end_date_key",
    )
    both = _readmission_load.replace(
        "SELECT facility_id, measure_id,",
        "SELECT year(l_shipdate) <= 1996 AS earlier_, year(l_shipdate) > 1996 OR (year(l_shipdate) = 1996 AND l_quantity > 10) AS later_,"
        " CASE WHEN measure_id IS NULL THEN d_ % 2 = 1 END AS unknown_, facility_id, measure_id,",
        1,
    )
    out["load_two_deliveries"] = f"""WITH both_ AS ({both})
        SELECT * EXCLUDE (earlier_, later_, unknown_) FROM both_ WHERE later_
        UNION ALL SELECT * EXCLUDE (earlier_, later_, unknown_) FROM both_ a WHERE earlier_ AND NOT EXISTS (
          SELECT 1 FROM both_ b WHERE later_ AND a.facility_id = b.facility_id AND a.end_date_key = b.end_date_key
          AND a.measure_id IS NOT DISTINCT FROM b.measure_id AND a.unknown_ IS NOT DISTINCT FROM b.unknown_
          AND a.start_date_key IS NOT DISTINCT FROM b.start_date_key)"""
    out["load_increments"] = out["load_two_deliveries"]
    out["load_by_header"] = out["load_by_position"] = out["load_appended"] = _readmission_load
    whole = lambda shown: f"CASE WHEN o_orderkey % 50 <> 0 THEN {shown} END"
    out["parse_delivered_lines"] = f"""SELECT CAST(o_custkey AS VARCHAR) AS facility_id,
        CASE WHEN o_orderkey % 50 = 0 THEN 'short' ELSE 'St. "' || o_orderstatus || '" Hospital, Inc' END AS facility_name,
        o_orderstatus AS state, {whole("o_orderpriority || ', all \\ causes'")} AS measure_name,
        {whole("CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)")} AS number_of_discharges,
        {whole("'1.5'")} AS excess_readmission_ratio, {whole("' padded '")} AS predicted_readmission_rate,
        {whole("'12/31/2020'")} AS end_date, o_orderkey % 50 = 0 AS is_corrupt FROM orders"""
    out["load_measure_dimension"] = q(
        f"""SELECT measure_id, measure_name, measure_category, higher_is_better, unit_of_measure,
        {big('coalesce(n, 0)')} AS fact_rows
        FROM meas LEFT JOIN (SELECT measure_key, count(*) AS n FROM (SELECT measure_key FROM fr
          UNION ALL SELECT measure_key FROM fs UNION ALL SELECT measure_key FROM qm) GROUP BY 1) USING (measure_key)"""
    )
    out["load_hospitals"] = _hospital_load
    out["refreshed_scorecard"] = out["vw_hospital_scorecard"]
    out["colocated_scorecard"] = out["vw_hospital_scorecard"]
    out["colocated_states"] = out["vw_state_benchmark"]
    out["colocated_hospital_types"] = out["hospital_type_comparison"]
    out["distinct_hospitals_sliced"] = q(
        f"""SELECT state, count(DISTINCT hospital_key) AS hospital_count FROM qm JOIN hosp USING (hospital_key)
        JOIN meas USING (measure_key) WHERE end_date_key // 10000 IN (2023, 2024)
        AND measure_category IN ('{K.MORTALITY}', '{K.SAFETY}') GROUP BY 1"""
    )
    out["report_hospital_types"] = out["hospital_type_comparison"]
    out["view_satisfaction_by_name"] = out["vw_satisfaction_detail"]
    out["materialised_scorecard"] = out["vw_hospital_scorecard"]
    out["exported_trends"] = out["vw_readmission_trends"]
    out["insert_new_hospitals"] = _hospital_insert
    out["upsert_hospitals"] = _hospital_upsert
    out["load_readmissions"] = _readmission_load
    out["load_satisfaction"] = _survey_load
    out["load_quality"] = _quality_load
    return out
