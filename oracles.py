"""SQL twins of the registered queries, for an independent engine on the same tables.

They follow the definitions row by row: the grid is expanded over the orders, p-values
come from Simpson's rule, points in zones from edge crossings of unnested rings.
"""

from __future__ import annotations

from slotwise.config import ALL_KPIS, CUSTOMER_KPIS, LOGISTICS_KPIS

FX_ORDERS = """
fx_base AS (
  SELECT event_id, ts, user_id % 12 AS zone_id, value AS v,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
fx_parts AS (
  SELECT CAST(event_id AS VARCHAR) AS platform_order_code, zone_id,
    'zone_' || zone_id AS zone_name, 'E' || (zone_id % 3) AS entity_id, 400 + zone_id % 3 AS asa_id,
    ts AS dps_sessionid_created_at_utc, ts + INTERVAL 8 HOUR AS order_placed_at_local,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts + INTERVAL 8 HOUR AS DATE)) + 1 AS BIGINT) AS day_num,
    CAST(k % 5 AS DOUBLE) * 0.5::DOUBLE AS actual_df_paid_by_customer,
    v AS gfv_local,
    round_even((v * 1.1::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS gmv_local,
    round_even((v * 0.15::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS commission_local,
    CAST(k % 7 AS DOUBLE) * 0.25::DOUBLE AS joker_vendor_fee_local,
    CASE WHEN v < 10 THEN round_even((10.0::DOUBLE - v) * 100.0::DOUBLE, 0) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS sof_local,
    0.0::DOUBLE AS service_fee_local,
    2.0::DOUBLE + CAST(k % 11 AS DOUBLE) * 0.5::DOUBLE AS delivery_costs_local,
    CASE WHEN event_id % 17 <> 0 THEN CAST(k % 40 AS DOUBLE) * 0.25::DOUBLE END AS dps_mean_delay,
    CASE WHEN event_id % 17 <> 0 THEN 500.0::DOUBLE + CAST(k AS DOUBLE) * 16.0::DOUBLE END AS delivery_distance_m,
    CASE WHEN event_id % 17 <> 0 THEN 20.0::DOUBLE + CAST(k % 30 AS DOUBLE) * 0.5::DOUBLE END AS actual_DT
  FROM fx_base),
fx_revenue AS (
  SELECT *, actual_df_paid_by_customer + commission_local + joker_vendor_fee_local + service_fee_local + sof_local
         AS revenue_local
  FROM fx_parts),
fx_orders AS (SELECT *, revenue_local - delivery_costs_local AS gross_profit_local FROM fx_revenue)"""

TAGGED = FX_ORDERS + """,
zone_groups AS (
  SELECT 'E0' AS entity_id, 400 AS asa_id, 'zg_1' AS zone_group_identifier, unnest(['zone_0','zone_3','zone_6','zone_9']) AS zone_name
  UNION ALL SELECT 'E1', 401, 'zg_2', unnest(['zone_1','zone_4','zone_7','zone_10'])
  UNION ALL SELECT 'E2', 402, 'zg_3', unnest(['zone_2','zone_5','zone_8','zone_11'])),
tagged AS (
  SELECT o.*, g.zone_group_identifier FROM fx_orders o
  JOIN zone_groups g ON o.entity_id = g.entity_id AND o.asa_id = g.asa_id AND o.zone_name = g.zone_name)"""

PREPARED = TAGGED + """,
starts AS (
  SELECT zone_group_identifier, epoch_us(min(dps_sessionid_created_at_utc)) // 1000000 AS start_s
  FROM tagged GROUP BY 1),
prepared AS (
  SELECT t.*, s.start_s, epoch_us(t.dps_sessionid_created_at_utc) // 1000000 AS ts_s
  FROM tagged t JOIN starts s ON t.zone_group_identifier = s.zone_group_identifier)"""

_HEX = "CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def _hash(text: str) -> str:
    return _HEX.format(text=text)


ALLOCATED = PREPARED + f""",
slotted AS (SELECT *, CAST(floor((ts_s - start_s) / 10800) AS BIGINT) AS slot_idx FROM prepared),
allocated AS (
  SELECT *,
    make_timestamp((start_s + slot_idx * 10800) * 1000000) AS slot_start,
    slot_idx % 8 AS slot_of_day,
    1 + {_hash("'v~28115~salt-a~' || zone_id || '~' || slot_idx")} % 3 AS variant,
    md5('28115~salt-a~' || zone_id || '~' || slot_idx) AS time_zone_unit_id
  FROM slotted)"""

RUNS = """,
grid AS (
  SELECT zone_group_identifier AS zone_group, start_s, w.w AS sb_window_size, n.n AS num_variants, l.l AS exp_length
  FROM starts, (SELECT unnest([2, 3, 4])::BIGINT AS w) w, (SELECT unnest([2, 3, 4, 5, 6, 7])::BIGINT AS n) n,
       (SELECT unnest([7, 14, 21, 28])::BIGINT AS l) l),
named_runs AS (
  SELECT *, zone_group || '-' || sb_window_size || '-window_size-' || num_variants || '-var_num-' || exp_length
            || '-exp_length' AS sim_run_id
  FROM grid),
runs AS (
  SELECT *, 1000 + """ + _hash("'k~' || sim_run_id || '~42'") + """ % 1001 AS run_key,
         md5('s~' || sim_run_id || '~42') AS run_salt
  FROM named_runs)"""

_RUN_COLS = "sim_run_id, zone_group, sb_window_size, num_variants, exp_length"

RUN_ORDERS = PREPARED + RUNS + f""",
run_slots AS (
  SELECT r.*, p.platform_order_code, p.zone_id, {', '.join('p.' + k for k in ALL_KPIS)},
         CAST(floor((p.ts_s - r.start_s) / (r.sb_window_size * 3600)) AS BIGINT) AS slot_idx
  FROM prepared p JOIN runs r ON p.zone_group_identifier = r.zone_group AND p.day_num <= r.exp_length),
run_orders AS (
  SELECT *,
    1 + {_hash("'v~' || run_key || '~' || run_salt || '~' || zone_id || '~' || slot_idx")} % num_variants AS variant,
    md5(run_key || '~' || run_salt || '~' || zone_id || '~' || slot_idx) AS time_zone_unit_id
  FROM run_slots)"""


def _totals() -> str:
    return ", ".join(
        f"round_even(coalesce(sum({k}), 0.0::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS {k}" for k in CUSTOMER_KPIS)


def _ratios() -> str:
    return ", ".join(
        f"round_even(({k} / CAST(order_count AS DOUBLE)) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS {k}"
        for k in CUSTOMER_KPIS)


def _means() -> str:
    return ", ".join(f"round_even(avg({k}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS {k}" for k in LOGISTICS_KPIS)


def _long(keys: str, source: str, kpis, name: str) -> str:
    cells = ", ".join(f"{{'kpi': '{k}', 'v': CAST({k} AS DOUBLE)}}" for k in kpis)
    return f"""
{name} AS (
  SELECT {keys}, variant, c.kpi AS kpi, c.v AS v
  FROM (SELECT {keys}, variant, unnest([{cells}]) AS c FROM {source}))"""


def _moments(keys: str, source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT {keys}, variant, kpi, count(v) AS n, avg(v) AS mean, var_samp(v) AS variance, min(v) AS low, max(v) AS high
  FROM {source} GROUP BY {keys}, variant, kpi)"""


def _welch(source: str, alpha: float = 0.1) -> str:
    """p-values from moments per (run, kpi_type, kpi, variant).

    The statistic comes from the differences of all pairs of variants, a constant variant is told by its range,
    the tail by Simpson's rule with 1000 steps.
    """
    keys = f"{_RUN_COLS}, kpi_type, kpi"
    same = "{0}.sim_run_id = {1}.sim_run_id AND {0}.kpi_type = {1}.kpi_type AND {0}.kpi = {1}.kpi"
    return f"""
weighted AS (SELECT *, CASE WHEN n >= 2 AND high > low THEN n / variance END AS w FROM {source}),
totals AS (
  SELECT {keys}, CAST(count(*) AS DOUBLE) AS k, CAST(count(w) AS DOUBLE) AS k_usable, sum(w) AS w_sum
  FROM weighted GROUP BY {keys}),
shares AS (
  SELECT {', '.join('x.' + c.strip() for c in keys.split(','))}, sum(pow(1 - x.w / t.w_sum, 2) / (x.n - 1)) AS lam
  FROM weighted x JOIN totals t ON {same.format('x', 't')} GROUP BY ALL),
pairs AS (
  SELECT a.sim_run_id, a.kpi_type, a.kpi, sum(a.w * b.w * pow(a.mean - b.mean, 2)) AS pair_ss
  FROM weighted a JOIN weighted b ON {same.format('a', 'b')} AND a.variant < b.variant GROUP BY ALL),
summed AS (
  SELECT {', '.join('t.' + c.strip() for c in keys.split(','))}, t.k, t.k_usable, p.pair_ss / t.w_sum AS between_ss, s.lam
  FROM totals t JOIN shares s ON {same.format('t', 's')} LEFT JOIN pairs p ON {same.format('t', 'p')}),
tested AS (
  SELECT {keys},
    CASE WHEN k >= 2 AND k_usable = k THEN (between_ss / (k - 1)) / (1 + 2 * (k - 2) * lam / (k * k - 1)) END AS f_stat,
    k - 1 AS df1, CASE WHEN k_usable = k THEN (k * k - 1) / nullif(3 * lam, 0) END AS df2
  FROM summed),
angles AS (
  SELECT *, atan(sqrt(df1 * f_stat / df2)) AS phi0,
         least(pi() / 2, atan(sqrt(df1 * f_stat / df2)) + 14 / sqrt(df2)) AS phi1
  FROM tested),
steps AS (SELECT range AS i FROM range(0, 1001)),
integrals AS (
  SELECT {keys},
    2 * exp(lgamma((any_value(df1) + any_value(df2)) / 2) - lgamma(any_value(df1) / 2) - lgamma(any_value(df2) / 2))
    * any_value((phi1 - phi0) / 3000)
    * sum((CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
          * pow(greatest(cos(phi0 + i * (phi1 - phi0) / 1000), 0), df2 - 1)
          * pow(sin(phi0 + i * (phi1 - phi0) / 1000), df1 - 1)) AS p
  FROM angles, steps WHERE f_stat IS NOT NULL GROUP BY {keys}),
p_values AS (
  SELECT {', '.join('t.' + c.strip() for c in keys.split(','))},
    CASE WHEN t.f_stat <= 0 THEN 1.0::DOUBLE
         WHEN i.p IS NOT NULL THEN round_even(least(greatest(i.p, 0.0::DOUBLE), 1.0::DOUBLE) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE END AS anova_pval
  FROM tested t LEFT JOIN integrals i
    ON t.sim_run_id = i.sim_run_id AND t.kpi_type = i.kpi_type AND t.kpi = i.kpi),
results AS (
  SELECT {_RUN_COLS}, kpi, anova_pval,
         CASE WHEN anova_pval <= {alpha} THEN 'significant' ELSE 'insignificant' END AS anova_sig, kpi_type
  FROM p_values)"""


_UNIT = f"{_RUN_COLS}, time_zone_unit_id, variant"
_TOT_KPIS = (*CUSTOMER_KPIS, "order_count")
_PER_ORDER_KPIS = (*CUSTOMER_KPIS, "order_count", *LOGISTICS_KPIS)
_TOT_FRAME = f""",
tot AS (SELECT {_UNIT}, {_totals()}, count(DISTINCT platform_order_code) AS order_count FROM run_orders GROUP BY {_UNIT})"""
_PER_ORDER_FRAME = f""",
tot_log AS (SELECT {_UNIT}, {_totals()}, count(DISTINCT platform_order_code) AS order_count, {_means()}
            FROM run_orders GROUP BY {_UNIT}),
per_order AS (SELECT {_UNIT}, {_ratios()}, order_count, {', '.join(LOGISTICS_KPIS)} FROM tot_log)"""


def _typed(kpi_type: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT *, '{kpi_type}' AS kpi_type FROM {source})"


_TOT_MOMENTS = (
    _TOT_FRAME + "," + _long(_RUN_COLS, "tot", _TOT_KPIS, "tot_long") + ","
    + _moments(_RUN_COLS, "tot_long", "tot_m0") + "," + _typed("tot", "tot_m0", "tot_m"))
_PER_ORDER_MOMENTS = (
    _PER_ORDER_FRAME + "," + _long(_RUN_COLS, "per_order", _PER_ORDER_KPIS, "po_long") + ","
    + _moments(_RUN_COLS, "po_long", "po_m0") + "," + _typed("per_order", "po_m0", "po_m"))
_ORDER_MOMENTS = (
    "," + _long(_RUN_COLS, "run_orders", ALL_KPIS, "ol_long") + ","
    + _moments(_RUN_COLS, "ol_long", "ol_m0") + "," + _typed("order_level", "ol_m0", "ol_m"))
_NO_ORDER_COUNT = "WHERE NOT (kpi_type = 'per_order' AND kpi = 'order_count')"

def _even_chi2(x: str) -> str:
    """The chi-square tail for k = 3, 5 or 7 variants: two, four or six degrees have a closed form."""
    h = f"({x} / 2)"
    return (f"round_even(exp(-{h}) * (1 + CASE WHEN k > 3 THEN {h} ELSE 0 END + CASE WHEN k > 5 THEN {h} * {h} / 2 ELSE 0 END)"
            " * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE")


# Sums of whole parts and billionths, as wide integers; deviations from the whole number next to the mean.
_EXACT_MOMENTS = """
parts AS (
  SELECT zone_group_identifier, variant, kpi, count(v) AS n, min(v) AS low, max(v) AS high,
    sum(floor(v)::HUGEINT) * 1000000000 + sum(round_even((v - floor(v)) * 1e9::DOUBLE, 0)::HUGEINT) AS s,
    sum(floor(v * v)::HUGEINT) * 1000000000 + sum(round_even((v * v - floor(v * v)) * 1e9::DOUBLE, 0)::HUGEINT) AS q
  FROM long_rows GROUP BY ALL),
centred AS (
  SELECT *, floor(((s // 1000000000)::DOUBLE + (s % 1000000000)::DOUBLE / 1e9::DOUBLE) / n + 0.5::DOUBLE)::HUGEINT AS c FROM parts),
deviations AS (
  SELECT *, (s - n * c * 1000000000)::DOUBLE / 1e9::DOUBLE AS d,
    (q - 2 * c * s + n * c * c * 1000000000)::DOUBLE / 1e9::DOUBLE AS dd
  FROM centred)
SELECT zone_group_identifier, variant, kpi, n,
  CASE WHEN low = high THEN low WHEN n > 0 THEN c::DOUBLE + d / n::DOUBLE END AS mean,
  CASE WHEN n > 1 THEN (CASE WHEN low = high THEN 0.0::DOUBLE ELSE greatest(dd - d * (d / n::DOUBLE), 0.0::DOUBLE) END) / (n - 1)::DOUBLE END AS variance
FROM deviations"""

RESULT_ROWS = """
fx_runs AS (
  SELECT event_id, (event_id // {count}) % 648 AS run,
         CASE WHEN event_id % 97 <> 0 THEN CAST(event_id * 7919 % 10001 AS DOUBLE) / 10000.0::DOUBLE END AS anova_pval,
         event_id % {count} AS kpi_no
  FROM events),
fx_cells AS (
  SELECT 'zg_' || (run // 72 + 1) AS zone_group, (run // 24) % 3 + 2 AS sb_window_size, (run // 4) % 6 + 2 AS num_variants,
         (run % 4 + 1) * 7 AS exp_length, [{names}][kpi_no + 1] AS named, anova_pval
  FROM fx_runs),
fx_pvals AS (
  SELECT zone_group || '-' || sb_window_size || '-window_size-' || num_variants || '-var_num-' || exp_length || '-exp_length'
           AS sim_run_id,
         zone_group, CAST(sb_window_size AS BIGINT) AS sb_window_size, CAST(num_variants AS BIGINT) AS num_variants,
         CAST(exp_length AS BIGINT) AS exp_length,
         named.kpi AS kpi, anova_pval,
         CASE WHEN anova_pval <= 0.1 THEN 'significant' ELSE 'insignificant' END AS anova_sig,
         named.kpi_type AS kpi_type
  FROM fx_cells),
labelled AS (
  SELECT *, CASE WHEN anova_pval <= 0.1 THEN 'significant' ELSE 'insignificant' END AS is_sig,
         CASE WHEN kpi IN ('dps_mean_delay', 'delivery_distance_m', 'actual_DT') THEN 'Log KPI' ELSE 'Biz KPI' END AS family
  FROM fx_pvals)"""


def _result_rows(kpis) -> str:
    names = ", ".join(f"{{'kpi_type': '{t}', 'kpi': '{k}'}}" for t, k in kpis)
    return RESULT_ROWS.format(count=len(kpis), names=names)


FX_PVALS = _result_rows([("tot", k) for k in _TOT_KPIS] + [("per_order", k) for k in ALL_KPIS])
FX_PVALS_ORDERS = _result_rows([("order_level", k) for k in ALL_KPIS])


def _pct_grid(family: str, denominator: str) -> str:
    cells = ", ".join(
        f"max(CASE WHEN exp_length = {n} THEN count_p_val_sig / CAST(count_obs AS DOUBLE) END) AS pct_{n}d"
        for n in (7, 14, 21, 28))
    return f"""
SELECT kpi_type, count_obs, sb_window_size, num_variants, {cells}, '{family}' AS family
FROM (
  SELECT l.kpi_type, l.sb_window_size, l.num_variants, l.exp_length, d.count_obs,
         count(CASE WHEN l.is_sig = 'significant' THEN l.sim_run_id END) AS count_p_val_sig
  FROM labelled l JOIN (
    SELECT sb_window_size, kpi_type, count(CASE WHEN family = '{denominator}' THEN sim_run_id END) AS count_obs
    FROM labelled GROUP BY sb_window_size, kpi_type) d
  ON l.sb_window_size = d.sb_window_size AND l.kpi_type = d.kpi_type
  WHERE l.family = '{family}'
  GROUP BY l.kpi_type, l.sb_window_size, l.num_variants, l.exp_length, d.count_obs) c
GROUP BY kpi_type, count_obs, sb_window_size, num_variants"""


_OVERALL = """
SELECT is_sig, count(*) AS records, (SELECT count(sim_run_id) FROM labelled) AS total_record_count,
       count(*) / CAST((SELECT count(sim_run_id) FROM labelled) AS DOUBLE) AS pct_sig_records
FROM labelled GROUP BY is_sig"""

_BIN = "CAST(floor(round_even(anova_pval * 10000.0::DOUBLE, 0) / {size}) AS BIGINT)"


def _bin_start(size: int) -> str:
    return f"CAST(bin_no AS DOUBLE) * {size}.0::DOUBLE / 10000.0::DOUBLE AS p_val_bin"


_SHARES = """
bins AS (SELECT kpi_type, kpi, {bin} AS bin_no FROM fx_pvals),
shares AS (
  SELECT kpi_type, kpi, bin_no, count(*) AS records,
         CAST(sum(count(*)) OVER (PARTITION BY kpi_type, kpi) AS BIGINT) AS kpi_records
  FROM bins GROUP BY kpi_type, kpi, bin_no)"""

_LON = "CAST({z} % 100 AS DOUBLE) * 0.5::DOUBLE"
_LAT = "CAST(({z} // 100) % 100 AS DOUBLE) * 0.5::DOUBLE"


def _ring(points) -> str:
    return "[" + ", ".join(
        f"{{'lon': lon + ({dx}::DOUBLE), 'lat': lat + ({dy}::DOUBLE)}}" for dx, dy in points) + "]"


def _square(h: float):
    return [(-h, -h), (h, -h), (h, h), (-h, h), (-h, -h)]


_ELL = [(-0.2, -0.2), (0.2, -0.2), (0.2, 0.0), (0.0, 0.0), (0.0, 0.2), (-0.2, 0.2), (-0.2, -0.2)]

FX_GEO = f"""
fx_zone0 AS (
  SELECT s_suppkey AS zone_id, s_name AS zone_name, s_suppkey % 7 <> 3 AS zone_active, s_suppkey // 5 AS city_id,
         s_suppkey // 25 AS country_no, {_LON.format(z='s_suppkey')} AS lon, {_LAT.format(z='s_suppkey')} AS lat
  FROM supplier),
fx_zones AS (
  SELECT zone_id, zone_name, zone_active, city_id, country_no,
    CASE WHEN zone_id % 3 = 0 THEN [{_ring(_square(0.2))}, {_ring(_square(0.0625))}]
         WHEN zone_id % 3 = 1 THEN [{_ring(_ELL)}]
         ELSE [{_ring(_square(0.2))}] END AS shape
  FROM fx_zone0),
fx_cities AS (
  SELECT country_no, city_id,
         list({{'id': zone_id, 'name': zone_name, 'is_active': zone_active, 'shape': shape}}) AS zones
  FROM fx_zones GROUP BY country_no, city_id),
fx_countries AS (
  SELECT 'c' || country_no AS country_code,
         [{{'entity_id': 'E' || (country_no % 5)}}, {{'entity_id': 'X' || (country_no % 5)}}] AS platforms,
         list({{'id': city_id, 'name': 'city_' || city_id, 'is_active': city_id % 6 <> 4, 'zones': zones}}) AS cities
  FROM fx_cities GROUP BY country_no),
by_platform AS (SELECT country_code, unnest(platforms) AS p, cities FROM fx_countries),
by_city AS (SELECT country_code, p, unnest(cities) AS ci FROM by_platform),
by_zone AS (SELECT country_code, p, ci, unnest(ci.zones) AS zo FROM by_city),
nested AS (
  SELECT p.entity_id AS entity_id, country_code, ci.name AS city_name, ci.id AS city_id, ci.is_active AS city_is_active,
         zo.shape AS zone_shape, zo.name AS zone_name, zo.id AS zone_id, zo.is_active AS zone_is_active
  FROM by_zone),
geo AS (
  SELECT * FROM nested
  WHERE entity_id IN ('E0', 'E1', 'E2', 'E3', 'E4') AND country_code <> 'c2' AND zone_is_active AND city_is_active),
fx_entities AS (
  SELECT CASE WHEN r_regionkey <> 4 THEN upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) END AS region,
         'R' || r_regionkey AS country_iso, r_name AS country_name,
         unnest(['E' || r_regionkey, 'X' || r_regionkey]) AS entity_id
  FROM region)"""


def _unless(modulus: int, value: str) -> str:
    return f"CASE WHEN key % {modulus} <> 0 THEN {value} END"


_D = "CAST({0} AS DOUBLE)"

FX_SESSIONS = f"""
fx_keys AS (
  SELECT *, o_orderkey AS key, o_custkey // 15 AS zone, (o_custkey // 15) // 25 AS country,
         round_even((o_totalprice / 100.0::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS gfv,
         o_orderdate + to_seconds(o_orderkey * 7 % 86400) AS placed
  FROM orders),
fx_sessions AS (
  SELECT CAST(o_orderdate AS DATE) AS created_date, placed AS order_placed_at,
    placed + INTERVAL 8 HOUR AS order_placed_at_local, placed - INTERVAL 5 MINUTE AS dps_sessionid_created_at,
    'region_' || (country % 5) AS region, 'E' || (country % 5) AS entity_id, 'c' || country AS country_code,
    'city_' || (zone // 5) AS city_name, zone // 5 AS city_id, 'zone_' || zone AS zone_name, zone AS zone_id,
    CAST(key AS VARCHAR) AS order_id, {_unless(101, "'P' || key")} AS platform_order_code,
    CASE WHEN key % 10 = 0 THEN 'Manual' ELSE 'Automatic scheme' END AS vendor_price_scheme_type,
    CAST(400 + country % 4 AS VARCHAR) AS assignment_id, 'v' || (key % 37) AS vendor_id,
    o_orderpriority AS vertical_type, 1.0::DOUBLE + CAST(key % 4 AS DOUBLE) * 0.25::DOUBLE AS exchange_rate,
    CAST(key % 9 AS DOUBLE) * 0.5::DOUBLE AS dps_delivery_fee_local,
    CAST(key % 4 AS DOUBLE) * 0.25::DOUBLE AS dps_surge_fee_local,
    CAST(key % 6 AS DOUBLE) * 0.5::DOUBLE AS dps_travel_time_fee_local,
    {_unless(13, "CAST(key % 8 AS DOUBLE) * 0.5::DOUBLE")} AS delivery_fee_local,
    round_even((gfv * 0.25::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS commission_local,
    {_unless(29, "CAST(key % 3 AS DOUBLE)")} AS joker_vendor_fee_local,
    {_unless(5, "CAST(key % 7 AS DOUBLE) * 0.1::DOUBLE")} AS service_fee_local,
    {_unless(3, "CAST(key % 11 AS DOUBLE)")} AS mov_customer_fee_local,
    {_unless(7, "CAST(key % 5 AS DOUBLE) * 500.0::DOUBLE")} AS dps_minimum_order_value_local,
    CAST(key % 10 AS DOUBLE) + 1.0::DOUBLE AS delivery_costs_local, gfv AS gfv_local,
    round_even((gfv * 1.1::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS gmv_local,
    {_unless(2, "CAST(key % 15 AS DOUBLE)")} AS mean_delay, CAST(key % 12 AS DOUBLE) AS dps_mean_delay,
    CAST(key % 25 AS DOUBLE) AS travel_time, CAST(key % 26 AS DOUBLE) AS dps_travel_time,
    CAST(key % 50 AS DOUBLE) * 64.0::DOUBLE AS delivery_distance_m, CAST(key % 45 AS DOUBLE) + 10.0::DOUBLE AS actual_DT,
    {_unless(50, "o_orderstatus <> 'P'")} AS is_sent,
    CASE WHEN key % 6 = 0 THEN TRUE WHEN key % 7 = 0 THEN NULL ELSE FALSE END AS by_discount,
    CASE WHEN key % 8 = 0 THEN TRUE WHEN key % 9 = 0 THEN NULL ELSE FALSE END AS by_voucher
  FROM fx_keys),
fx_locations AS (
  SELECT 'E' || (country % 5) AS global_entity_id, 'P' || key AS order_id,
    {_unless(41, _LON.format(z='zone') + " + CAST(key * 37 % 81 - 40 AS DOUBLE) / 160.0::DOUBLE")} AS lon,
    {_LAT.format(z='zone')} + CAST(key * 53 % 73 - 36 AS DOUBLE) / 160.0::DOUBLE AS lat
  FROM fx_keys),
fx_paid_fees AS (
  SELECT 'E' || (country % 5) AS global_entity_id, {_unless(3, "'P' || key")} AS code,
    CAST(o_orderdate AS DATE) AS created_date_utc, {_unless(4, "CAST(key % 16 AS DOUBLE) * 0.25::DOUBLE")} AS table_fee
  FROM fx_keys),
entities AS (SELECT * FROM fx_entities WHERE entity_id IN ('E0', 'E1', 'E2', 'E3', 'E4'))"""

# The small-order fee is what the customer pays below the minimum; it is not owed if the order is known to reach it.
_SOF = """CASE WHEN gfv_local >= dps_minimum_order_value_local THEN 0.0::DOUBLE
  WHEN mov_customer_fee_local IS NOT NULL THEN mov_customer_fee_local
  ELSE dps_minimum_order_value_local - gfv_local END"""
# A covered fee is zero; in regions with a fee table its entry goes first.
_OWN_FEE = "if(coalesce(by_discount, FALSE) OR coalesce(by_voucher, FALSE), 0.0::DOUBLE, delivery_fee_local)"
_FEE = f"""CASE WHEN fee_region IS NULL THEN NULL
  WHEN fee_region = ANY(['Europe', 'Asia']) AND table_fee IS NOT NULL THEN table_fee
  ELSE {_OWN_FEE} END"""


def _contained(source: str) -> str:
    """(row_no) of the rows of `source` (row_no, lon, lat, zone_shape) whose point lies inside."""
    return f"""
rings AS (SELECT row_no, lon, lat, unnest(zone_shape) AS ring FROM {source}),
corners AS (
  SELECT row_no, lon, lat, ring, unnest(range(1, len(ring))) AS i FROM rings),
edges AS (
  SELECT row_no, lon AS px, lat AS py, ring[i].lon AS x1, ring[i].lat AS y1, ring[i + 1].lon AS x2, ring[i + 1].lat AS y2
  FROM corners),
contained AS (
  SELECT row_no FROM edges
  GROUP BY row_no
  HAVING count(CASE WHEN (y1 > py) <> (y2 > py)
                     AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1 THEN 1 END) % 2 = 1
     AND count(CASE WHEN (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) = 0
                     AND px BETWEEN least(x1, x2) AND greatest(x1, x2)
                     AND py BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 END) = 0)"""


def _turns(sql: str) -> str:
    """turn(x) in the text becomes the angle from -180 up to but not 180."""
    while (at := sql.find("turn(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = sql[at + 5:end - 1]
        sql = f"{sql[:at]}(({x}) - 360.0::DOUBLE * floor((({x}) + 180.0::DOUBLE) / 360.0::DOUBLE)){sql[end:]}"
    return sql


# Where an edge's great circle meets a point's meridian follows from the tangents of its ends' latitudes.
GLOBE = f"""
globe_zones AS (
  SELECT 'z' || zone_id AS zone, unnest(shape) AS ring FROM fx_zones
  UNION ALL
  SELECT 'n' || n_nationkey, CASE WHEN n_nationkey < 2
      THEN list_transform([0, 1, 2], lambda i: {{'lon': turn(c + 120 * i), 'lat': CASE WHEN n_nationkey = 0 THEN 60 + 3 * i ELSE -55 - 2 * i END::DOUBLE}})
      ELSE [{{'lon': turn(c - 40), 'lat': -10.0::DOUBLE}}, {{'lon': turn(c + 40), 'lat': -10.0::DOUBLE}},
            {{'lon': turn(c + 40), 'lat': 30.0::DOUBLE}}, {{'lon': turn(c - 40), 'lat': 30.0::DOUBLE}}] END
  FROM (SELECT n_nationkey, n_nationkey * 15 - 180 AS c FROM nation)),
globe_edges AS (
  SELECT zone, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM globe_zones, unnest(range(1, len(ring) + 1)) AS corner(i)),
globe_east AS (
  SELECT zone, CASE WHEN turn(b.lon - a.lon) >= 0 THEN a ELSE b END AS w, CASE WHEN turn(b.lon - a.lon) >= 0 THEN b ELSE a END AS e,
    abs(turn(b.lon - a.lon)) AS d
  FROM globe_edges WHERE a <> b),
globe_points AS (
  SELECT 'c' || c_custkey AS point, (c_custkey * 37 % 360 - 180)::DOUBLE + 0.125::DOUBLE AS lon, (c_custkey * 53 % 178 - 89)::DOUBLE + 0.25::DOUBLE AS lat
  FROM customer
  UNION ALL SELECT order_id, lon, lat FROM fx_locations WHERE lon IS NOT NULL),
globe_met AS (
  SELECT point, zone, lat, w, e, d, turn(lon - w.lon) AS u FROM globe_points, globe_east WHERE turn(lon - w.lon) BETWEEN 0 AND d),
globe_crossed AS (
  SELECT *, CASE WHEN d > 0 THEN (tan(radians(w.lat)) * sin(radians(d - u)) + tan(radians(e.lat)) * sin(radians(u))) / sin(radians(d)) END AS height
  FROM globe_met),
globe_counts AS (
  SELECT point, zone, count(*) FILTER (u < d AND height > tan(radians(lat))) AS north,
    count(*) FILTER (height = tan(radians(lat)) OR u = 0 AND lat = w.lat OR u = d AND lat = e.lat
      OR d = 0 AND lat BETWEEN least(w.lat, e.lat) AND greatest(w.lat, e.lat)) AS on_edge
  FROM globe_crossed GROUP BY ALL)"""

_COPIED = """order_placed_at_local region entity_id country_code city_name city_id zone_name zone_id zone_shape lon lat
order_id platform_order_code vendor_price_scheme_type vendor_id vertical_type exchange_rate dps_delivery_fee_local
dps_surge_fee_local dps_travel_time_fee_local delivery_fee_local commission_local joker_vendor_fee_local
delivery_costs_local gfv_local gmv_local mean_delay dps_mean_delay travel_time dps_travel_time delivery_distance_m
actual_DT""".split()

# Each requirement is a set of its own; an order counts once per combination of its matches.
ORDER_KPIS = f"""{FX_GEO}, {FX_SESSIONS},
in_scope AS (
  SELECT * FROM fx_sessions
  WHERE is_sent AND vendor_price_scheme_type = 'Automatic scheme' AND assignment_id IN ('400', '401', '402')
    AND year(created_date) BETWEEN 1996 AND 1999),
in_entity AS (SELECT i.*, e.region AS fee_region FROM in_scope i JOIN entities e USING (entity_id)),
in_zone AS (
  SELECT i.*, g.zone_shape FROM in_entity i
  JOIN (SELECT entity_id, country_code, zone_id, zone_shape FROM geo) g USING (entity_id, country_code, zone_id)),
with_point AS (
  SELECT i.*, d.lon, d.lat FROM in_zone i
  JOIN (SELECT global_entity_id AS entity_id, order_id AS platform_order_code, lon, lat FROM fx_locations
        WHERE lon IS NOT NULL AND lat IS NOT NULL) d USING (entity_id, platform_order_code)),
matched AS (
  SELECT row_number() OVER () AS row_no, p.*, f.table_fee FROM with_point p
  LEFT JOIN (SELECT global_entity_id AS entity_id, code AS platform_order_code, created_date_utc AS created_date, table_fee
             FROM fx_paid_fees) f USING (entity_id, platform_order_code, created_date)),
{_contained('matched')},
kpis AS (
  SELECT {', '.join(_COPIED)}, created_date AS created_date_utc, order_placed_at AS order_placed_at_utc,
    dps_sessionid_created_at AS dps_sessionid_created_at_utc, CAST(assignment_id AS BIGINT) AS asa_id,
    DATE '1996-01-01' AS start_date_var, dayname(order_placed_at_local) AS dow_local,
    CAST(date_diff('day', DATE '1995-12-31', CAST(order_placed_at_local AS DATE)) AS BIGINT) AS day_num,
    coalesce(service_fee_local, 0.0::DOUBLE) AS service_fee_local, {_SOF} AS sof_local, {_FEE} AS actual_df_paid_by_customer
  FROM matched SEMI JOIN contained USING (row_no))"""

# n = 24 / 4 * 28 labels of 3 hours; the intervals cut (n - 1) * 3 hours into n parts.
_N = 168
_SPAN = (_N - 1) * 3 * 3600 * 1_000_000
_LAST = _SPAN + _SPAN // 1000


def _interval(offset: str) -> str:
    return (f"CASE WHEN {offset} >= 0 AND {offset} < {_LAST} "
            f"THEN least(({offset}) * {_N} // {_SPAN}, {_N - 1}) END")


_SERIES = """,
series AS (
  SELECT zone_group_identifier, start_s, i AS slot_no, make_timestamp((start_s + i * 10800) * 1000000) AS slot_label
  FROM starts, (SELECT range AS i FROM range(0, 168)) r)"""
_BINS = _SERIES + f""",
numbered AS (SELECT *, {_interval("slot_no * 10800000000")} AS interval_no FROM series),
bins AS (
  SELECT *, make_timestamp(start_s * 1000000 + (interval_no * {_SPAN} + {_N - 1}) // {_N}) AS interval_start,
    make_timestamp(start_s * 1000000 + CASE WHEN interval_no = {_N - 1} THEN {_LAST}
      ELSE ((interval_no + 1) * {_SPAN} + {_N - 1}) // {_N} END) AS interval_end
  FROM numbered)"""
_ZONE_SLOTS = _BINS + """,
zone_slots AS (
  SELECT b.zone_group_identifier, z.zone_name, b.slot_label, CAST(b.slot_label AS DATE) AS slot_date, b.interval_no,
         md5('salt-v1~' || z.zone_name || '~' || b.interval_no) AS time_zone_unit_id
  FROM bins b JOIN (SELECT DISTINCT zone_group_identifier, zone_name FROM prepared) z
    ON b.zone_group_identifier = z.zone_group_identifier)"""
_PLACED = f""",
placed AS (
  SELECT *, {_interval("(epoch_us(dps_sessionid_created_at_utc) - start_s * 1000000)")} AS interval_no FROM prepared)"""

_PVAL_ROWS = ("sim_run_id, zone_group, sb_window_size, num_variants, exp_length, kpi, anova_pval, anova_sig, kpi_type")



def _one_run(window: int, unit: str, join: str) -> str:
    """run_orders of a single design of 3 variants over 28 days, from orders with a unit and a variant."""
    return f""",
run_orders AS (
  SELECT p.zone_group_identifier || '-{window}-window_size-3-var_num-28-exp_length' AS sim_run_id,
    p.zone_group_identifier AS zone_group, {window}::BIGINT AS sb_window_size, 3::BIGINT AS num_variants,
    28::BIGINT AS exp_length, p.platform_order_code, {', '.join('p.' + k for k in ALL_KPIS)}, {unit} AS time_zone_unit_id,
    a.variant
  FROM {join} WHERE p.day_num <= 28 AND {unit} IS NOT NULL AND a.variant IS NOT NULL)"""


_HANDED_OVER = "JOIN (SELECT platform_order_code AS code, time_zone_unit_id, variant FROM allocated) a ON p.platform_order_code = a.code"
_IMPORTED = _one_run(3, "a.time_zone_unit_id", f"prepared p {_HANDED_OVER}")
_V1 = _one_run(4, "z.time_zone_unit_id", f"""placed p {_HANDED_OVER} JOIN zone_slots z
    ON p.zone_group_identifier = z.zone_group_identifier AND p.interval_no = z.interval_no AND p.zone_name = z.zone_name
    AND CAST(p.dps_sessionid_created_at_utc AS DATE) = z.slot_date""")
_BOTH_MOMENTS = f"""{_TOT_MOMENTS}{_PER_ORDER_MOMENTS},
all_m AS (SELECT * FROM tot_m UNION ALL SELECT * FROM po_m {_NO_ORDER_COUNT})"""

ORACLES: dict[str, str] = {
    "imported_slot_totals": f"""WITH {ALLOCATED}{_IMPORTED} SELECT zone_group AS zone_group_identifier, time_zone_unit_id, variant,
  {_totals()}, count(DISTINCT platform_order_code) AS order_count FROM run_orders GROUP BY 1, 2, 3""",
    "imported_welch": f"WITH {ALLOCATED}{_IMPORTED}{_BOTH_MOMENTS}, {_welch('all_m')} SELECT * FROM results",
    "v1_study": f"WITH {ALLOCATED}{_ZONE_SLOTS}{_PLACED}{_V1}{_BOTH_MOMENTS}, {_welch('all_m', 0.05)} SELECT * FROM results",
    "allocate_switchback": f"WITH {ALLOCATED} SELECT platform_order_code, zone_id, variant, time_zone_unit_id, slot_of_day FROM allocated",
    "allocate_fractional": f"""WITH {PREPARED}, slotted AS (
  SELECT *, CAST(floor((ts_s - start_s) / 5400) AS BIGINT) AS slot_idx FROM prepared)
SELECT platform_order_code, zone_id, 1 + {_hash("'v~7~salt-b~' || zone_id || '~' || slot_idx")} % 4 AS variant,
  md5('7~salt-b~' || zone_id || '~' || slot_idx) AS time_zone_unit_id, slot_idx % 16 AS slot_of_day FROM slotted""",
    "report_parameters": f"""WITH {FX_PVALS},
settings AS (SELECT a.a AS alpha, w.w AS bin_width FROM (SELECT unnest([0.05, 0.1])::DOUBLE AS a) a,
  (SELECT unnest([0.05, 0.1, 0.15, 0.2])::DOUBLE AS w) w)
SELECT alpha, bin_width, CAST(floor(round_even(anova_pval * 10000, 0) / round_even(bin_width * 10000, 0)) AS BIGINT) AS bin_no,
  CASE WHEN anova_pval <= alpha THEN 'significant' ELSE 'insignificant' END AS is_sig, count(*) AS records
FROM fx_pvals, settings GROUP BY ALL""",
    "slot_assign": f"WITH {ALLOCATED} SELECT platform_order_code, zone_group_identifier, slot_idx, slot_start, slot_of_day, time_zone_unit_id FROM allocated",
    "import_allocation": f"WITH {ALLOCATED} SELECT platform_order_code AS order_id, variant, time_zone_unit_id AS slot_id, slot_of_day FROM allocated",
    "attach_variants": f"""WITH {ALLOCATED} SELECT o.platform_order_code, o.zone_name, o.gfv_local, a.variant, a.time_zone_unit_id
FROM fx_orders o LEFT JOIN allocated a ON o.platform_order_code = a.platform_order_code""",
    "variant_balance": f"""WITH {ALLOCATED} SELECT zone_group_identifier, variant, count(*) AS orders, count(DISTINCT time_zone_unit_id) AS slots
FROM allocated GROUP BY 1, 2""",
    "variant_balance_test": f"""WITH {PREPARED}, designs AS (SELECT unnest([3, 5, 7])::BIGINT AS k),
placed AS (
  SELECT k, zone_group_identifier AS g, zone_id || '~' || CAST(floor((ts_s - start_s) / 10800) AS BIGINT) AS unit
  FROM prepared, designs),
drawn AS (SELECT k, g, unit, {_hash("'v~28115~salt-a~' || unit")} % k AS variant FROM placed),
counts AS (SELECT k, g, variant, count(*)::DOUBLE AS orders, count(DISTINCT unit)::DOUBLE AS slots FROM drawn GROUP BY ALL),
totals AS (SELECT k, g, sum(orders) AS orders, sum(slots) AS slots, sum(orders * orders) AS qo, sum(slots * slots) AS qs FROM counts GROUP BY ALL),
stats AS (
  SELECT *, (k * qs - slots * slots) / slots AS slots_chi2, (k * qo - orders * orders) / orders AS orders_chi2 FROM totals)
SELECT g AS zone_group_identifier, k AS num_variants, slots::BIGINT AS slots, orders::BIGINT AS orders, slots_chi2, orders_chi2,
  {_even_chi2('slots_chi2')} AS slots_p, {_even_chi2('orders_chi2')} AS orders_p
FROM stats""",
    "zone_groups": f"WITH {TAGGED} SELECT platform_order_code, entity_id, asa_id, zone_name, zone_group_identifier, gfv_local FROM tagged",
    "start_ts_per_group": f"""WITH {TAGGED} SELECT entity_id, zone_group_identifier,
  strftime(min(dps_sessionid_created_at_utc), '%Y-%m-%dT%H:%M:%SZ') AS min_dps_session_start_ts,
  strftime(max(dps_sessionid_created_at_utc), '%Y-%m-%dT%H:%M:%SZ') AS max_dps_session_start_ts
FROM tagged GROUP BY 1, 2""",
    "iso_timestamp": f"WITH {FX_ORDERS} SELECT platform_order_code, strftime(dps_sessionid_created_at_utc, '%Y-%m-%dT%H:%M:%SZ') AS session_ts_iso FROM fx_orders",
    "exp_length_filter": f"""WITH {TAGGED} SELECT zone_group_identifier, l AS exp_length, count(*) AS orders,
  count(DISTINCT day_num) AS days, max(day_num) AS last_day
FROM tagged JOIN (SELECT unnest([7, 14, 21, 28])::BIGINT AS l) lengths ON day_num <= l GROUP BY 1, 2""",
    "week_bucket": f"""WITH {PREPARED}, dated AS (
  SELECT platform_order_code, zone_group_identifier, CAST(dps_sessionid_created_at_utc AS DATE) AS dps_session_created_date,
    date_diff('day', min(CAST(dps_sessionid_created_at_utc AS DATE)) OVER (PARTITION BY zone_group_identifier),
              CAST(dps_sessionid_created_at_utc AS DATE)) AS d FROM prepared)
SELECT platform_order_code, zone_group_identifier, dps_session_created_date,
  CASE WHEN d BETWEEN 0 AND 6 THEN 'week_1' WHEN d BETWEEN 7 AND 13 THEN 'week_2' WHEN d BETWEEN 14 AND 20 THEN 'week_3'
       WHEN d BETWEEN 21 AND 27 THEN 'week_4' ELSE '0' END AS week_num FROM dated""",
    "export_allocation_input": f"""WITH {PREPARED} SELECT platform_order_code, zone_id,
  strftime(dps_sessionid_created_at_utc, '%Y-%m-%dT%H:%M:%SZ') AS session_ts_iso FROM prepared""",
    "export_allocation_order": f"""WITH {PREPARED} SELECT count(*) AS orders,
  strftime(min(dps_sessionid_created_at_utc), '%Y-%m-%dT%H:%M:%SZ') AS first_time,
  strftime(max(dps_sessionid_created_at_utc), '%Y-%m-%dT%H:%M:%SZ') AS last_time, 0::BIGINT AS out_of_order FROM prepared""",
    "sim_grid": f"WITH {PREPARED}{RUNS} SELECT {_RUN_COLS} FROM runs",
    "run_keys": f"WITH {PREPARED}{RUNS} SELECT sim_run_id, run_key, run_salt FROM runs",
    "slot_totals": f"""WITH {ALLOCATED} SELECT zone_group_identifier, time_zone_unit_id, variant, {_totals()},
  count(DISTINCT platform_order_code) AS order_count FROM allocated WHERE day_num <= 28 GROUP BY 1, 2, 3""",
    "slot_totals_wide_grid": f"""WITH {PREPARED}, cells AS (
  SELECT p.*, w.w AS window_s, l.l AS exp_length, CAST(floor((ts_s - start_s) / w.w) AS BIGINT) AS slot_idx
  FROM prepared p, (SELECT unnest([5400, 7200, 25200])::BIGINT AS w) w, (SELECT unnest([7, 14, 21, 28])::BIGINT AS l) l
  WHERE p.day_num <= l.l)
SELECT zone_group_identifier AS zone_group, zone_id, window_s, slot_idx, exp_length, count(DISTINCT platform_order_code) AS order_count,
  round_even(coalesce(sum(gfv_local), 0.0::DOUBLE) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS gfv_local,
  round_even(avg(actual_DT) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS actual_DT
FROM cells GROUP BY ALL""",
    "slot_per_order": f"""WITH {ALLOCATED}, tot AS (SELECT zone_group_identifier, time_zone_unit_id, variant, {_totals()},
  count(DISTINCT platform_order_code) AS order_count, {_means()} FROM allocated WHERE day_num <= 28 GROUP BY 1, 2, 3)
SELECT zone_group_identifier, time_zone_unit_id, variant, {_ratios()}, order_count, {', '.join(LOGISTICS_KPIS)} FROM tot""",
    "variant_moments": f"""WITH {ALLOCATED}, tot AS (SELECT zone_group_identifier, time_zone_unit_id, variant, {_totals()},
  count(DISTINCT platform_order_code) AS order_count, {_means()} FROM allocated WHERE day_num <= 28 GROUP BY 1, 2, 3),
per_order AS (SELECT zone_group_identifier, variant, {_ratios()}, order_count, {', '.join(LOGISTICS_KPIS)} FROM tot),
{_long('zone_group_identifier', 'per_order', _PER_ORDER_KPIS, 'long_rows')},
{_EXACT_MOMENTS}""",
    "welch_slot_tot": f"WITH {RUN_ORDERS}{_TOT_MOMENTS}, {_welch('tot_m')} SELECT * FROM results",
    "welch_slot_per_order": f"WITH {RUN_ORDERS}{_PER_ORDER_MOMENTS}, {_welch('po_m')} SELECT * FROM results",
    "welch_order_level": f"WITH {RUN_ORDERS}{_ORDER_MOMENTS}, {_welch('ol_m')} SELECT * FROM results",
    "pval_union": f"""WITH {RUN_ORDERS}{_TOT_MOMENTS}{_PER_ORDER_MOMENTS},
all_m AS (SELECT * FROM tot_m UNION ALL SELECT * FROM po_m {_NO_ORDER_COUNT}), {_welch('all_m')} SELECT * FROM results""",
    "aa_study": f"""WITH {RUN_ORDERS}{_TOT_MOMENTS}{_PER_ORDER_MOMENTS}{_ORDER_MOMENTS},
all_m AS (SELECT * FROM tot_m UNION ALL SELECT * FROM po_m {_NO_ORDER_COUNT} UNION ALL SELECT * FROM ol_m),
{_welch('all_m')} SELECT * FROM results""",
    "daily_study": f"""WITH {RUN_ORDERS}{_TOT_MOMENTS}{_PER_ORDER_MOMENTS}{_ORDER_MOMENTS},
all_m AS (SELECT * FROM tot_m UNION ALL SELECT * FROM po_m {_NO_ORDER_COUNT} UNION ALL SELECT * FROM ol_m),
{_welch('all_m')} SELECT * FROM results""",
    "sig_counts": f"""WITH {FX_PVALS} SELECT kpi_type, kpi, count(CASE WHEN is_sig = 'significant' THEN sim_run_id END) AS count_p_val_sig,
  count(*) AS records FROM labelled GROUP BY 1, 2""",
    "sig_share": f"""WITH {FX_PVALS} SELECT kpi_type, is_sig, count(*) AS records,
  (SELECT count(sim_run_id) FROM labelled) AS total_record_count,
  count(*) / CAST((SELECT count(sim_run_id) FROM labelled) AS DOUBLE) AS pct_sig_records FROM labelled GROUP BY 1, 2""",
    "sig_pct_grid": f"WITH {FX_PVALS} {_pct_grid('Biz KPI', 'Biz KPI')} UNION ALL {_pct_grid('Log KPI', 'Biz KPI')}",
    "sig_pct_grid_order_level": f"WITH {FX_PVALS_ORDERS} {_pct_grid('Biz KPI', 'Biz KPI')} UNION ALL {_pct_grid('Log KPI', 'Biz KPI')}",
    "sig_pct_grid_order_level_matching": f"WITH {FX_PVALS_ORDERS} {_pct_grid('Biz KPI', 'Biz KPI')} UNION ALL {_pct_grid('Log KPI', 'Log KPI')}",
    "overall_sig_slot": f"WITH {FX_PVALS} {_OVERALL}",
    "overall_sig_order": f"WITH {FX_PVALS_ORDERS} {_OVERALL}",
    "relabel_alpha": f"""WITH {FX_PVALS} SELECT anova_sig, CASE WHEN anova_pval <= 0.05 THEN 'significant' ELSE 'insignificant' END AS is_sig,
  count(*) AS records, min(anova_pval) AS lowest, max(anova_pval) AS highest FROM fx_pvals GROUP BY 1, 2""",
    "kpi_family": f"WITH {FX_PVALS} SELECT kpi_type, kpi, family AS biz_or_log_kpi, count(*) AS records FROM labelled GROUP BY 1, 2, 3",
    "pval_histogram": f"""WITH {FX_PVALS}, cells AS (
  SELECT kpi_type, kpi, {_BIN.format(size=500)} AS bin_no, is_sig, count(*) AS records FROM labelled
  WHERE kpi <> 'service_fee_local'
    AND ((kpi_type = 'per_order') OR (kpi_type = 'tot' AND family = 'Biz KPI'))
  GROUP BY 1, 2, 3, 4)
SELECT kpi_type, kpi, {_bin_start(500)}, is_sig, records,
  records / CAST(sum(records) OVER (PARTITION BY kpi_type, kpi) AS DOUBLE) AS pct_of_total FROM cells""",
    "pval_histogram_dense": f"""WITH {FX_PVALS}, cells AS (
  SELECT kpi_type, family, kpi, is_sig, {_BIN.format(size=500)} AS bin_no, count(*) AS records FROM labelled
  WHERE kpi <> 'service_fee_local' AND (kpi_type = 'per_order' OR family = 'Biz KPI') GROUP BY ALL),
ranges AS (SELECT kpi_type, family, min(bin_no) AS low, max(bin_no) AS high FROM cells GROUP BY ALL),
frame AS (
  SELECT k.*, unnest(range(r.low, r.high + 1)) AS bin_no
  FROM (SELECT DISTINCT kpi_type, family, kpi, is_sig FROM cells) k
  JOIN ranges r ON k.kpi_type = r.kpi_type AND k.family = r.family)
SELECT f.kpi_type, f.family, f.kpi, f.is_sig, CAST(f.bin_no AS DOUBLE) * 500.0::DOUBLE / 10000.0::DOUBLE AS p_val_bin,
  coalesce(c.records, 0) AS records
FROM frame f LEFT JOIN cells c
  ON f.kpi_type = c.kpi_type AND f.kpi = c.kpi AND f.is_sig = c.is_sig AND f.bin_no = c.bin_no
UNION ALL SELECT kpi_type, family, kpi, is_sig, NULL, records FROM cells WHERE bin_no IS NULL""",
    "pval_hist_pct": f"""WITH {FX_PVALS}, {_SHARES.format(bin=_BIN.format(size=1000))}
SELECT kpi_type, kpi, {_bin_start(1000)}, records, kpi_records, records / CAST(kpi_records AS DOUBLE) AS p_val_hist_pct
FROM shares WHERE bin_no IS NOT NULL""",
    "pval_hist_calcs": f"""WITH {FX_PVALS}, {_SHARES.format(bin=_BIN.format(size=500))}, pct AS (
  SELECT *, records / CAST(kpi_records AS DOUBLE) AS p_val_hist_pct FROM shares WHERE bin_no IS NOT NULL)
SELECT kpi_type, kpi, {_bin_start(500)}, records, p_val_hist_pct,
  records - lag(records) OVER w AS records_diff, p_val_hist_pct - lag(p_val_hist_pct) OVER w AS pct_diff,
  CAST(sum(records) OVER (PARTITION BY kpi_type, kpi ORDER BY bin_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving_records,
  CAST(sum(records) OVER (PARTITION BY kpi_type, kpi ORDER BY bin_no ROWS UNBOUNDED PRECEDING) AS DOUBLE)
    / CAST(kpi_records AS DOUBLE) AS running_pct
FROM pct WINDOW w AS (PARTITION BY kpi_type, kpi ORDER BY bin_no)""",
    "scan_nested": f"""WITH {FX_GEO} SELECT entity_id, country_code, city_id, city_name, city_is_active, zone_id, zone_name,
  zone_is_active, len(zone_shape) AS rings FROM nested""",
    "geo_zones": f"""WITH {FX_GEO} SELECT entity_id, country_code, city_name, city_id, zone_name, zone_id,
  len(flatten(zone_shape)) AS vertices FROM geo""",
    "entity_region": f"""WITH {FX_GEO}, {FX_SESSIONS} SELECT e.region, e.entity_id, e.country_iso, e.country_name FROM entities e
JOIN (SELECT DISTINCT entity_id FROM fx_sessions) s ON e.entity_id = s.entity_id""",
    "semi_join_entities": f"""WITH {FX_GEO}, {FX_SESSIONS} SELECT order_id, entity_id, zone_id, created_date FROM fx_sessions
WHERE entity_id IN (SELECT DISTINCT entity_id FROM geo)""",
    "order_kpis": f"""WITH {ORDER_KPIS} SELECT * EXCLUDE (zone_shape), len(flatten(zone_shape)) AS vertices FROM kpis""",
    "order_kpis_bucketed": f"""WITH {ORDER_KPIS} SELECT * EXCLUDE (zone_shape), len(flatten(zone_shape)) AS vertices FROM kpis""",
    "revenue_profit": f"""WITH {ORDER_KPIS}, earned AS (
  SELECT order_id, entity_id, actual_df_paid_by_customer, commission_local, joker_vendor_fee_local, service_fee_local,
    sof_local, delivery_costs_local,
    actual_df_paid_by_customer + commission_local + joker_vendor_fee_local + service_fee_local + sof_local AS revenue_local
  FROM kpis)
SELECT *, revenue_local - delivery_costs_local AS gross_profit_local FROM earned""",
    "small_order_fee": f"WITH {FX_GEO}, {FX_SESSIONS} SELECT order_id, {_SOF} AS sof_local FROM fx_sessions",
    "delivery_fee_paid": f"""WITH {FX_GEO}, {FX_SESSIONS}, priced AS (
  SELECT s.*, e.region AS fee_region, f.table_fee FROM fx_sessions s JOIN entities e ON s.entity_id = e.entity_id
  LEFT JOIN fx_paid_fees f ON s.entity_id = f.global_entity_id AND s.platform_order_code = f.code AND s.created_date = f.created_date_utc)
SELECT order_id, fee_region, {_FEE} AS actual_df_paid_by_customer FROM priced""",
    "dow_day_num": f"""WITH {FX_GEO}, {FX_SESSIONS} SELECT order_id, dayname(order_placed_at_local) AS dow_local,
  CAST(date_diff('day', DATE '1996-01-01', CAST(order_placed_at_local AS DATE)) + 1 AS BIGINT) AS day_num FROM fx_sessions""",
    "sql_variables": f"""WITH {FX_GEO}, {FX_SESSIONS} SELECT order_id, entity_id, created_date, CAST(assignment_id AS BIGINT) AS asa_id,
  DATE '1996-01-01' AS start_date_var, DATE '1999-12-31' AS end_date_var FROM fx_sessions
WHERE created_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND vendor_price_scheme_type = 'Automatic scheme'
  AND CAST(assignment_id AS BIGINT) IN (400, 401, 402) AND is_sent AND entity_id IN ('E0', 'E1', 'E2', 'E3', 'E4')""",
    "point_in_zone": f"""WITH {FX_GEO}, {FX_SESSIONS}, named AS (
  SELECT row_number() OVER () AS row_no, s.order_id, s.zone_id, d.lon, d.lat, n.zone_shape
  FROM fx_sessions s JOIN fx_locations d ON s.entity_id = d.global_entity_id AND s.platform_order_code = d.order_id
  JOIN nested n ON s.entity_id = n.entity_id AND s.country_code = n.country_code AND s.zone_id = n.zone_id),
{_contained('named')} SELECT order_id, zone_id, lon, lat FROM named WHERE row_no IN (SELECT row_no FROM contained)""",
    "point_in_zone_geodesic": _turns(f"""WITH {FX_GEO}, {FX_SESSIONS}, {GLOBE}
SELECT point, zone FROM globe_counts
WHERE on_edge = 0 AND (north % 2 = 1) <> (zone = 'n0')"""),
    "slot_series": f"WITH {PREPARED}{_SERIES} SELECT zone_group_identifier, slot_no, slot_label, CAST(slot_label AS DATE) AS slot_date FROM series",
    "equal_width_bins": f"WITH {PREPARED}{_BINS} SELECT zone_group_identifier, slot_no, slot_label, interval_no, interval_start, interval_end FROM bins",
    "slot_zone_grid": f"WITH {PREPARED}{_ZONE_SLOTS} SELECT * FROM zone_slots",
    "interval_join": f"""WITH {PREPARED}{_BINS}
SELECT p.platform_order_code, p.zone_group_identifier, b.interval_no FROM prepared p LEFT JOIN bins b
ON p.zone_group_identifier = b.zone_group_identifier AND p.dps_sessionid_created_at_utc >= b.interval_start
  AND p.dps_sessionid_created_at_utc < b.interval_end""",
    "interval_range_join": f"""WITH {PREPARED}, fx_slots AS (
  SELECT 'zg_' || (s_suppkey % 3 + 1) AS zone_group_identifier, s_suppkey AS slot_key,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(s_suppkey * 7919 % 50000) AS slot_from,
    to_minutes(CAST(pow(s_suppkey % 11, 3) * 20 AS BIGINT)) AS long_is
  FROM supplier)
SELECT p.platform_order_code, p.zone_group_identifier, z.slot_key FROM prepared p LEFT JOIN fx_slots z
ON p.zone_group_identifier = z.zone_group_identifier AND p.dps_sessionid_created_at_utc >= z.slot_from
  AND p.dps_sessionid_created_at_utc < z.slot_from + z.long_is""",
    "v1_slot_join": f"""WITH {PREPARED}{_ZONE_SLOTS}{_PLACED}
SELECT p.platform_order_code, p.zone_group_identifier, p.zone_name, p.interval_no, z.time_zone_unit_id
FROM placed p LEFT JOIN zone_slots z ON p.zone_group_identifier = z.zone_group_identifier AND p.interval_no = z.interval_no
  AND p.zone_name = z.zone_name AND CAST(p.dps_sessionid_created_at_utc AS DATE) = z.slot_date
WHERE p.day_num <= 28""",
    "scan_csv_gzip_inferred": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "scan_csv_gzip": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "infer_datetime_columns": """SELECT event_id, ts AS ts_text, event_type,
  CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE 'unknown' END AS mixed,
  CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS gaps FROM events""",
    "infer_datetime_formats": """SELECT event_id, date_trunc('second', ts) AS offsets, date_trunc('minute', ts) AS names,
  date_trunc('second', ts) AS day_first, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS month_first,
  CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%m/%d/%Y') END AS both_orders,
  CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS gaps, CAST(NULL AS VARCHAR) AS empty FROM events""",
    "ctas_replace": f"""WITH {FX_GEO} SELECT entity_id, country_code, city_name, city_id, zone_name, zone_id,
  len(flatten(zone_shape)) AS vertices FROM geo""",
    "write_results": f"WITH {FX_PVALS} SELECT {_PVAL_ROWS} FROM fx_pvals",
    "report_csv": f"WITH {FX_PVALS} SELECT {_PVAL_ROWS} FROM fx_pvals",
}
