"""Study inputs derived from the given tables by fixed formulas.

Each view has its SQL twin in oracles.py. The views only rename, compute and (for the
nested tables) group rows into small arrays; no row is filtered out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.config import ALL_KPIS, CUSTOMER_KPIS, LOGISTICS_KPIS, OrderScope, StudyGrid, ZoneGroup

GRID = StudyGrid(seed="42")
# Buckets of the fixture's tables, for small data.
BUCKETS = 8

WIDE_GRID = StudyGrid(window_hours=(1.5, 2, 7), num_variants=(2, 3), exp_lengths=(7, 14, 21, 28), seed="42")

GROUPS = tuple(
    ZoneGroup(f"E{e}", 400 + e, tuple(f"zone_{z}" for z in range(e, 12, 3)), f"zg_{e + 1}") for e in range(3)
)

SCOPE = OrderScope(
    entity_ids=("E0", "E1", "E2", "E3", "E4"),
    start_date=dt.date(1996, 1, 1),
    end_date=dt.date(1999, 12, 31),
    asa_ids=(400, 401, 402),
    excluded_country="c2",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ZONE = "floor(o_custkey / 15)"
COUNTRY = f"floor({ZONE} / 25)"


def cents(e: str) -> str:
    return f"rint(({e}) * 100D) / 100D"


def fx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level KPI table from `events`."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id % 12 AS zone_id", "value AS v",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    ).selectExpr(
        "CAST(event_id AS STRING) AS platform_order_code",
        "zone_id",
        "concat('zone_', zone_id) AS zone_name",
        "concat('E', zone_id % 3) AS entity_id",
        "400 + zone_id % 3 AS asa_id",
        "ts AS dps_sessionid_created_at_utc",
        "ts + INTERVAL 8 HOURS AS order_placed_at_local",
        "CAST(datediff(to_date(ts + INTERVAL 8 HOURS), DATE'2024-01-01') + 1 AS BIGINT) AS day_num",
        "CAST(k % 5 AS DOUBLE) * 0.5D AS actual_df_paid_by_customer",
        "v AS gfv_local",
        f"{cents('v * 1.1D')} AS gmv_local",
        f"{cents('v * 0.15D')} AS commission_local",
        "CAST(k % 7 AS DOUBLE) * 0.25D AS joker_vendor_fee_local",
        f"CASE WHEN v < 10D THEN {cents('10D - v')} ELSE 0D END AS sof_local",
        "0D AS service_fee_local",
        "2D + CAST(k % 11 AS DOUBLE) * 0.5D AS delivery_costs_local",
        "CASE WHEN event_id % 17 != 0 THEN CAST(k % 40 AS DOUBLE) * 0.25D END AS dps_mean_delay",
        "CASE WHEN event_id % 17 != 0 THEN 500D + CAST(k AS DOUBLE) * 16D END AS delivery_distance_m",
        "CASE WHEN event_id % 17 != 0 THEN 20D + CAST(k % 30 AS DOUBLE) * 0.5D END AS actual_DT",
    )
    return base.selectExpr(
        "*", "actual_df_paid_by_customer + commission_local + joker_vendor_fee_local + service_fee_local + sof_local"
        " AS revenue_local",
    ).selectExpr("*", "revenue_local - delivery_costs_local AS gross_profit_local")


def fx_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uneven, gapped and overlapping slots per zone group from `supplier`: minutes to weeks long, a few empty."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('zg_', s_suppkey % 3 + 1) AS zone_group_identifier", "s_suppkey AS slot_key",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(s_suppkey * 7919 % 50000 AS INT)) AS slot_from",
        "CAST(pow(s_suppkey % 11, 3) * 20 AS INT) AS minutes",
    ).selectExpr("zone_group_identifier", "slot_key", "slot_from", "slot_from + make_dt_interval(0, 0, minutes) AS slot_to")


def ring(corners: list[tuple[float, float]]) -> str:
    return "array(" + ", ".join(
        f"struct(lon + ({dx}D) AS lon, lat + ({dy}D) AS lat)" for dx, dy in corners) + ")"


def square(half: float) -> list[tuple[float, float]]:
    return [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]


ELL = [(-0.2, -0.2), (0.2, -0.2), (0.2, 0.0), (0.0, 0.0), (0.0, 0.2), (-0.2, 0.2), (-0.2, -0.2)]


def fx_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat zones from `supplier`: five zones per city, five cities per country.

    The shape is a square with a hole, an L or a square, by zone id.
    """
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS zone_id", "s_name AS zone_name", "s_suppkey % 7 != 3 AS zone_active",
        "floor(s_suppkey / 5) AS city_id", "floor(s_suppkey / 25) AS country_no",
        "CAST(s_suppkey % 100 AS DOUBLE) * 0.5D AS lon", "CAST(floor(s_suppkey / 100) % 100 AS DOUBLE) * 0.5D AS lat",
    ).selectExpr(
        "zone_id", "zone_name", "zone_active", "city_id", "country_no",
        f"CASE WHEN zone_id % 3 = 0 THEN array({ring(square(0.2))}, {ring(square(0.0625))}) "
        f"WHEN zone_id % 3 = 1 THEN array({ring(ELL)}) ELSE array({ring(square(0.2))}) END AS shape",
    )


def fx_globe_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat zones, and from `nation` wide zones with long edges: over the date line, and one around each pole."""
    def east(degrees: str) -> str:
        return f"CAST(pmod({degrees} + 180, 360) - 180 AS DOUBLE)"

    def corners(points: list[tuple[str, str]]) -> str:
        return "array(array(" + ", ".join(f"struct({lon} AS lon, CAST({lat} AS DOUBLE) AS lat)" for lon, lat in points) + "))"

    wide = corners([(east("c - 40"), "-10"), (east("c + 40"), "-10"), (east("c + 40"), "30"), (east("c - 40"), "30")])
    polar = corners([(east(f"c + {120 * i}"), f"IF(n_nationkey = 0, {60 + 3 * i}, {-55 - 2 * i})") for i in range(3)])
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_nationkey * 15 - 180 AS c").selectExpr(
        "concat('n', n_nationkey) AS zone", f"IF(n_nationkey < 2, {polar}, {wide}) AS shape")
    return fx_zones(spark, sf_dir).selectExpr("concat('z', zone_id) AS zone", "shape").unionByName(nations)


def fx_globe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points all over the globe from `customer`, and the delivery points."""
    globe = table(spark, sf_dir, "customer").selectExpr(
        "concat('c', c_custkey) AS point", "CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) + 0.125D AS lon",
        "CAST(c_custkey * 53 % 178 - 89 AS DOUBLE) + 0.25D AS lat")
    return globe.unionByName(fx_locations(spark, sf_dir).selectExpr(
        "order_id AS point", "delivery_location.longitude AS lon", "delivery_location.latitude AS lat"))


def fx_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested countries; at most 5 cities and 5 zones in an array, whatever the scale."""
    cities = fx_zones(spark, sf_dir).groupBy("country_no", "city_id").agg(F.expr(
        "array_sort(collect_list(struct(zone_id AS id, zone_name AS name, zone_active AS is_active, shape)))"
    ).alias("zones"))
    return cities.groupBy("country_no").agg(F.expr(
        "array_sort(collect_list(struct(city_id AS id, concat('city_', city_id) AS name, "
        "city_id % 6 != 4 AS is_active, zones)))").alias("cities")
    ).selectExpr(
        "concat('c', country_no) AS country_code",
        "array(struct(concat('E', country_no % 5) AS entity_id), struct(concat('X', country_no % 5) AS entity_id)) AS platforms",
        "cities",
    )


def fx_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested entities from `region`; one region is unknown."""
    return table(spark, sf_dir, "region").selectExpr(
        "CASE WHEN r_regionkey != 4 THEN initcap(r_name) END AS region",
        "concat('R', r_regionkey) AS country_iso", "r_name AS country_name",
        "array(struct(concat('E', r_regionkey) AS entity_id), struct(concat('X', r_regionkey) AS entity_id)) AS platforms",
    )


def fx_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions mapped to orders, from `orders`."""

    def unless(modulus: int, value: str) -> str:
        return f"CASE WHEN key % {modulus} != 0 THEN {value} END"

    keyed = table(spark, sf_dir, "orders").selectExpr(
        "*", "o_orderkey AS key", f"{ZONE} AS zone", f"{COUNTRY} AS country",
        f"{cents('o_totalprice / 100D')} AS gfv",
        "o_orderdate + make_dt_interval(0, 0, 0, CAST(o_orderkey * 7 % 86400 AS DECIMAL(18, 6))) AS placed",
    )
    return keyed.selectExpr(
        "to_date(o_orderdate) AS created_date", "placed AS order_placed_at",
        "placed + INTERVAL 8 HOURS AS order_placed_at_local",
        "placed - INTERVAL 5 MINUTES AS dps_sessionid_created_at",
        "concat('region_', country % 5) AS region", "concat('E', country % 5) AS entity_id",
        "concat('c', country) AS country_code", "concat('city_', floor(zone / 5)) AS city_name",
        "floor(zone / 5) AS city_id", "concat('zone_', zone) AS zone_name", "zone AS zone_id",
        "CAST(key AS STRING) AS order_id", f"{unless(101, 'concat(\'P\', key)')} AS platform_order_code",
        "CASE WHEN key % 10 = 0 THEN 'Manual' ELSE 'Automatic scheme' END AS vendor_price_scheme_type",
        "CAST(400 + country % 4 AS STRING) AS assignment_id", "concat('v', key % 37) AS vendor_id",
        "o_orderpriority AS vertical_type", "1D + CAST(key % 4 AS DOUBLE) * 0.25D AS exchange_rate",
        "CAST(key % 9 AS DOUBLE) * 0.5D AS dps_delivery_fee_local",
        "CAST(key % 4 AS DOUBLE) * 0.25D AS dps_surge_fee_local",
        "CAST(key % 6 AS DOUBLE) * 0.5D AS dps_travel_time_fee_local",
        f"{unless(13, 'CAST(key % 8 AS DOUBLE) * 0.5D')} AS delivery_fee_local",
        f"{cents('gfv * 0.25D')} AS commission_local",
        f"{unless(29, 'CAST(key % 3 AS DOUBLE)')} AS joker_vendor_fee_local",
        f"{unless(5, 'CAST(key % 7 AS DOUBLE) * 0.1D')} AS service_fee_local",
        f"{unless(3, 'CAST(key % 11 AS DOUBLE)')} AS mov_customer_fee_local",
        f"{unless(7, 'CAST(key % 5 AS DOUBLE) * 500D')} AS dps_minimum_order_value_local",
        "CAST(key % 10 AS DOUBLE) + 1D AS delivery_costs_local", "gfv AS gfv_local",
        f"{cents('gfv * 1.1D')} AS gmv_local", f"{unless(2, 'CAST(key % 15 AS DOUBLE)')} AS mean_delay",
        "CAST(key % 12 AS DOUBLE) AS dps_mean_delay", "CAST(key % 25 AS DOUBLE) AS travel_time",
        "CAST(key % 26 AS DOUBLE) AS dps_travel_time", "CAST(key % 50 AS DOUBLE) * 64D AS delivery_distance_m",
        "CAST(key % 45 AS DOUBLE) + 10D AS actual_DT", "CASE WHEN key % 50 != 0 THEN o_orderstatus != 'P' END AS is_sent",
        "CASE WHEN key % 6 = 0 THEN true WHEN key % 7 = 0 THEN NULL ELSE false END AS is_delivery_fee_covered_by_discount",
        "CASE WHEN key % 8 = 0 THEN true WHEN key % 9 = 0 THEN NULL ELSE false END AS is_delivery_fee_covered_by_voucher",
    )


def fx_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery points around the zone centres, from `orders`: inside, outside, on edges, missing."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", f"{ZONE} AS zone").selectExpr(
        "concat('E', floor(zone / 25) % 5) AS global_entity_id", "concat('P', key) AS order_id",
        "struct(CASE WHEN key % 41 != 0 THEN CAST(zone % 100 AS DOUBLE) * 0.5D + CAST(key * 37 % 81 - 40 AS DOUBLE) / 160D END"
        " AS longitude, CAST(floor(zone / 100) % 100 AS DOUBLE) * 0.5D + CAST(key * 53 % 73 - 36 AS DOUBLE) / 160D"
        " AS latitude) AS delivery_location",
    )


def fx_paid_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid delivery fees from `orders`; every third order has none."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"concat('E', {COUNTRY} % 5) AS global_entity_id",
        "CASE WHEN o_orderkey % 3 != 0 THEN concat('P', o_orderkey) END AS code",
        "to_date(o_orderdate) AS created_date_utc",
        "CASE WHEN o_orderkey % 4 != 0 THEN CAST(o_orderkey % 16 AS DOUBLE) * 0.25D END AS delivery_fee_local",
    )


# KPI names of the result fixture: totals first, then per-order KPIs.
RESULT_KPIS = (
    [("tot", k) for k in (*CUSTOMER_KPIS, "order_count")] + [("per_order", k) for k in ALL_KPIS]
)


def _result_rows(spark: SparkSession, sf_dir: str, kpis: list[tuple[str, str]]) -> DataFrame:
    names = ", ".join(f"struct('{t}' AS kpi_type, '{k}' AS kpi)" for t, k in kpis)
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"floor(event_id / {len(kpis)}) % 648 AS run",
        f"element_at(array({names}), CAST(event_id % {len(kpis)} AS INT) + 1) AS named",
        "CASE WHEN event_id % 97 != 0 THEN CAST(event_id * 7919 % 10001 AS DOUBLE) / 10000D END AS anova_pval",
    ).selectExpr(
        "concat('zg_', floor(run / 72) + 1) AS zone_group", "floor(run / 24) % 3 + 2 AS sb_window_size",
        "floor(run / 4) % 6 + 2 AS num_variants", "(run % 4 + 1) * 7 AS exp_length", "named", "anova_pval",
    )
    return rows.selectExpr(
        "concat(zone_group, '-', sb_window_size, '-window_size-', num_variants, '-var_num-', exp_length, '-exp_length')"
        " AS sim_run_id",
        "zone_group", "sb_window_size", "num_variants", "exp_length", "named.kpi AS kpi", "anova_pval",
        "CASE WHEN anova_pval <= 0.1D THEN 'significant' ELSE 'insignificant' END AS anova_sig",
        "named.kpi_type AS kpi_type",
    )


def fx_pvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of a slot-level study from `events`."""
    return _result_rows(spark, sf_dir, RESULT_KPIS)


def fx_pvals_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of an order-level study from `events`."""
    return _result_rows(spark, sf_dir, [("order_level", k) for k in (*CUSTOMER_KPIS, *LOGISTICS_KPIS)])
