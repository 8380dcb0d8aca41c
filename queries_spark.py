"""The registered queries: every operator on views of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixture_views as fx
from slotwise.config import CUSTOMER_KPIS, LOGISTICS_KPIS, REPORT_ALPHAS, REPORT_BIN_WIDTHS, Allocation
from slotwise.functions.geo import geo_point
from slotwise.functions.scalars import day_number, iso_timestamp, weekday_name
from slotwise.operators import allocation as al
from slotwise.operators import interval_slots as iv
from slotwise.operators import report as rp
from slotwise.operators import slots as sl
from slotwise.operators import warehouse as wh
from slotwise.operators import welch as we
from slotwise.operators import zones as zo
from slotwise.operators.geodesic import zones_of_points
from slotwise.operators.interval_join import join_intervals
from slotwise.plans import study
from slotwise.plans.daily import DailyStudy, stage_by_day
from slotwise.sources import tables as tb
from slotwise.sources.datetimes import infer_formats
from slotwise.sources.staging import stage, staging_path

Query = Callable[[SparkSession, str], DataFrame]

DESIGN = Allocation(window_hours=3, num_variants=3, key=28115, salt="salt-a")
# Window and days of the interval queries; the label step stays at its 3 hours.
IV_WINDOW, IV_DAYS, IV_SALT = 4, 28, "salt-v1"
GROUP = zo.GROUP


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return zo.prepare_orders(fx.fx_orders(spark, sf), fx.GROUPS)


def starts(spark: SparkSession, sf: str) -> DataFrame:
    return zo.group_starts(zo.tag_zone_groups(fx.fx_orders(spark, sf), fx.GROUPS))


def allocated(spark: SparkSession, sf: str) -> DataFrame:
    return al.allocate(prepared(spark, sf), DESIGN)


# --- allocation -----------------------------------------------------------------------


def allocate_switchback(spark, sf):
    return allocated(spark, sf).select(
        "platform_order_code", "zone_id", "variant", "time_zone_unit_id", "slot_of_day")


def allocate_fractional(spark, sf):
    """A window of one and a half hours, four variants, another key and salt."""
    design = Allocation(window_hours=1.5, num_variants=4, key=7, salt="salt-b")
    return al.allocate(prepared(spark, sf), design).select(
        "platform_order_code", "zone_id", "variant", "time_zone_unit_id", "slot_of_day")


def slot_assign(spark, sf):
    return allocated(spark, sf).select(
        "platform_order_code", GROUP, "slot_idx", "slot_start", "slot_of_day", "time_zone_unit_id")


def import_allocation(spark, sf):
    path = staging_path(spark, "allocation")
    tb.write_allocation(allocated(spark, sf), path)
    a = tb.read_allocation(spark, path)
    return a.select(
        F.col("OrderID").alias("order_id"), F.col("Variant").alias("variant"),
        F.col("SlotID").alias("slot_id"), F.col("SlotOfDay").alias("slot_of_day"))


def attach_variants(spark, sf):
    a = allocated(spark, sf).select(
        F.col("platform_order_code").alias("OrderID"), F.col("variant").alias("Variant"),
        F.col("time_zone_unit_id").alias("SlotID"))
    return al.attach_variants(fx.fx_orders(spark, sf), a).select(
        "platform_order_code", "zone_name", "gfv_local", "variant", "time_zone_unit_id")


def variant_balance(spark, sf):
    return al.variant_balance(allocated(spark, sf))


def variant_balance_test(spark, sf):
    """Whether variants have equal shares of slots and orders, for designs of three, five and seven variants."""
    rows, out = prepared(spark, sf), None
    for n in (3, 5, 7):
        design = Allocation(window_hours=3, num_variants=n, key=28115, salt="salt-a")
        one = al.balance_test(al.variant_balance(al.allocate(rows, design)), n)
        out = one if out is None else out.unionByName(one)
    return out


# --- zone groups and times ------------------------------------------------------------


def zone_groups(spark, sf):
    return zo.tag_zone_groups(fx.fx_orders(spark, sf), fx.GROUPS).select(
        "platform_order_code", "entity_id", "asa_id", "zone_name", GROUP, "gfv_local")


def start_ts_per_group(spark, sf):
    return zo.group_start_times(zo.tag_zone_groups(fx.fx_orders(spark, sf), fx.GROUPS))


def iso_timestamps(spark, sf):
    return fx.fx_orders(spark, sf).select(
        "platform_order_code", iso_timestamp(F.col(zo.SESSION_TS)).alias("session_ts_iso"))


def exp_length_filter(spark, sf):
    return zo.per_exp_length(zo.tag_zone_groups(fx.fx_orders(spark, sf), fx.GROUPS), fx.GRID.exp_lengths)


def week_bucket(spark, sf):
    return zo.with_week(prepared(spark, sf)).select(
        "platform_order_code", GROUP, "dps_session_created_date", "week_num")


def export_allocation_input(spark, sf):
    path = staging_path(spark, "allocation-input")
    tb.write_allocation_input(al.allocation_input(prepared(spark, sf)), path)
    return spark.read.options(**tb.CSV_OPTIONS).schema(
        "platform_order_code string, zone_id bigint, session_ts_iso string").csv(path)


def export_allocation_order(spark, sf):
    """The allocator's input is written in the order of time: read back and checked line by line."""
    path = staging_path(spark, "allocation-input")
    tb.write_allocation_input(al.allocation_input(prepared(spark, sf)), path)
    return tb.allocation_input_order(spark, path)


# --- grid -----------------------------------------------------------------------------


def sim_grid(spark, sf):
    return al.simulation_grid(starts(spark, sf), fx.GRID).select(
        "sim_run_id", "zone_group", "sb_window_size", "num_variants", "exp_length")


def run_keys(spark, sf):
    return al.simulation_grid(starts(spark, sf), fx.GRID).select("sim_run_id", "run_key", "run_salt")


# --- slots and tests ------------------------------------------------------------------


def _design_rows(spark, sf):
    return zo.within_exp_length(prepared(spark, sf), 28)


def slot_totals(spark, sf):
    return sl.slot_totals(sl.design_sums(_design_rows(spark, sf), DESIGN, with_logistics=False))


def slot_per_order(spark, sf):
    return sl.slot_per_order(sl.design_sums(_design_rows(spark, sf), DESIGN))


def slot_totals_wide_grid(spark, sf):
    """Totals and distinct orders per zone, window, slot and length of a grid whose masks need several words."""
    rows = prepared(spark, sf)
    return sl.grid_slots(sl.granule_facts(rows, fx.WIDE_GRID), sl.slot_order_counts(rows, fx.WIDE_GRID), fx.WIDE_GRID).selectExpr(
        "zone_group", "zone_id", "window_s", "slot_idx", "exp_length", "order_count",
        f"{sl.rounded_totals()['gfv_local']} AS gfv_local", f"{sl.logistics_mean('actual_DT')} AS actual_DT")


def variant_moments(spark, sf):
    per_order = sl.slot_per_order(sl.design_sums(_design_rows(spark, sf), DESIGN))
    kpis = [*CUSTOMER_KPIS, "order_count", *LOGISTICS_KPIS]
    return we.moments(per_order, [GROUP], kpis)


def _slot_p_values(spark, sf, kpi_type):
    rows = prepared(spark, sf)
    slots = sl.grid_slots(sl.granule_facts(rows, fx.GRID), sl.slot_order_counts(rows, fx.GRID), fx.GRID)
    return tb.conform_results(we.p_values(we.slot_level_moments(slots, fx.GRID, (kpi_type,)), fx.GRID))


def welch_slot_tot(spark, sf):
    return _slot_p_values(spark, sf, "tot")


def welch_slot_per_order(spark, sf):
    return _slot_p_values(spark, sf, "per_order")


def welch_order_level(spark, sf):
    return study.order_study(fx.fx_orders(spark, sf), fx.GROUPS, fx.GRID)


def pval_union(spark, sf):
    return study.slot_study(fx.fx_orders(spark, sf), fx.GROUPS, fx.GRID)


def aa_study(spark, sf):
    return study.full_study(fx.fx_orders(spark, sf), fx.GROUPS, fx.GRID)


def daily_study(spark, sf):
    """The full study from facts kept by day: all orders of the first days in one go, then two days more."""
    kept = DailyStudy(spark, staging_path(spark, "daily"), fx.GROUPS, fx.GRID)
    orders = stage_by_day(fx.fx_orders(spark, sf), "orders-by-day")
    kept.begin(orders)
    days = [r[0] for r in orders.select("day_num").distinct().orderBy("day_num").collect() if r[0] <= max(fx.GRID.exp_lengths)]
    kept.add_range(orders, days[:-2])
    kept.add_days(orders, days[-2:])
    return kept.results()


def _imported(spark, sf):
    """An allocation as another tool hands it over: written to CSV and read again."""
    path = staging_path(spark, "allocation")
    tb.write_allocation(allocated(spark, sf), path)
    return tb.read_allocation(spark, path)


def imported_slot_totals(spark, sf):
    rows = al.attach_variants(zo.tag_zone_groups(fx.fx_orders(spark, sf), fx.GROUPS), _imported(spark, sf))
    return sl.slot_totals(sl.allocated_sums(zo.within_exp_length(rows, 28), with_logistics=False))


def imported_welch(spark, sf):
    return study.imported_study(
        fx.fx_orders(spark, sf), _imported(spark, sf), fx.GROUPS, DESIGN.window_hours, DESIGN.num_variants, 28)


def v1_study(spark, sf):
    return study.interval_study(
        fx.fx_orders(spark, sf), _imported(spark, sf), fx.GROUPS, IV_WINDOW, DESIGN.num_variants, IV_DAYS, IV_SALT)


# --- reports --------------------------------------------------------------------------


def sig_counts(spark, sf):
    return rp.sig_counts(fx.fx_pvals(spark, sf))


def sig_share(spark, sf):
    return rp.significance_share(fx.fx_pvals(spark, sf))


def sig_pct_grid(spark, sf):
    results = fx.fx_pvals(spark, sf)
    biz = rp.significance_grid(results, "Biz KPI").withColumn("family", F.lit("Biz KPI"))
    log = rp.significance_grid(results, "Log KPI").withColumn("family", F.lit("Log KPI"))
    return biz.unionByName(log)


def _order_level_grid(spark, sf, denominator):
    results = fx.fx_pvals_orders(spark, sf)
    biz = rp.significance_grid(results, "Biz KPI", denominator=denominator).withColumn("family", F.lit("Biz KPI"))
    log = rp.significance_grid(results, "Log KPI", denominator=denominator).withColumn("family", F.lit("Log KPI"))
    return biz.unionByName(log)


def sig_pct_grid_order_level(spark, sf):
    return _order_level_grid(spark, sf, "biz")


def sig_pct_grid_order_level_matching(spark, sf):
    return _order_level_grid(spark, sf, "matching")


def overall_sig_slot(spark, sf):
    return rp.overall_significance(fx.fx_pvals(spark, sf))


def overall_sig_order(spark, sf):
    return rp.overall_significance(fx.fx_pvals_orders(spark, sf))


def relabel_alpha(spark, sf):
    return rp.relabel(fx.fx_pvals(spark, sf), 0.05).groupBy("anova_sig", "is_sig").agg(
        F.count(F.lit(1)).alias("records"), F.min("anova_pval").alias("lowest"), F.max("anova_pval").alias("highest"))


def kpi_family(spark, sf):
    return rp.with_family(fx.fx_pvals(spark, sf)).groupBy("kpi_type", "kpi", "biz_or_log_kpi").agg(
        F.count(F.lit(1)).alias("records"))


SHEETS = (("per_order", "Biz KPI"), ("tot", "Biz KPI"), ("per_order", "Log KPI"))


def pval_histogram(spark, sf):
    results = fx.fx_pvals(spark, sf)
    # Three sheets of one table; a row belongs to one at most, so one scan serves all of them.
    wanted = None
    for kpi_type, family in SHEETS:
        here = (F.col("kpi_type") == kpi_type) & (F.col("biz_or_log_kpi") == family)
        wanted = here if wanted is None else wanted | here
    rows = rp.with_family(results).where(wanted & (F.col("kpi") != "service_fee_local"))
    return rp.p_value_histogram(rows)


def pval_histogram_dense(spark, sf):
    results, out = fx.fx_pvals(spark, sf), None
    for kpi_type, family in SHEETS:
        one = rp.dense_histogram(rp.sheet(results, kpi_type, family)).withColumn("family", F.lit(family))
        out = one if out is None else out.unionByName(one)
    return out


def report_parameters(spark, sf):
    """Labelled rows per bin for every setting of the report's two parameters."""
    rows, out = fx.fx_pvals(spark, sf), None
    for alpha in REPORT_ALPHAS:
        for width in REPORT_BIN_WIDTHS:
            one = rp.binned(rows, width, alpha).groupBy(
                F.lit(alpha).alias("alpha"), F.lit(width).alias("bin_width"), "bin_no", "is_sig").agg(
                F.count(F.lit(1)).alias("records"))
            out = one if out is None else out.unionByName(one)
    return out


def pval_hist_pct(spark, sf):
    return rp.histogram_shares(fx.fx_pvals(spark, sf), 0.1).select(
        "kpi_type", "kpi", "p_val_bin", "records", "kpi_records", "p_val_hist_pct")


def pval_hist_calcs(spark, sf):
    return rp.histogram_calcs(fx.fx_pvals(spark, sf))


# --- warehouse tables -----------------------------------------------------------------


def _zones(spark, sf):
    return wh.geo_zones(fx.fx_countries(spark, sf), fx.SCOPE)


def scan_nested(spark, sf):
    return wh.scan_nested(fx.fx_countries(spark, sf)).select(
        "entity_id", "country_code", "city_id", "city_name", "city_is_active", "zone_id", "zone_name",
        "zone_is_active", F.size("zone_shape").cast("bigint").alias("rings"))


def geo_zones(spark, sf):
    return _zones(spark, sf).select(
        "entity_id", "country_code", "city_name", "city_id", "zone_name", "zone_id",
        F.size(F.flatten("zone_shape")).cast("bigint").alias("vertices"))


def entity_region(spark, sf):
    return wh.entity_region(fx.fx_entities(spark, sf), fx.fx_sessions(spark, sf), fx.SCOPE)


def semi_join_entities(spark, sf):
    return wh.semi_join_entities(fx.fx_sessions(spark, sf), _zones(spark, sf)).select(
        "order_id", "entity_id", "zone_id", "created_date")


def _order_kpis(spark, sf, sessions=None, locations=None, paid_fees=None):
    # The zones are a table of their own, made before the orders.
    return wh.order_kpis(
        sessions or fx.fx_sessions(spark, sf), locations or fx.fx_locations(spark, sf), paid_fees or fx.fx_paid_fees(spark, sf),
        stage(_zones(spark, sf), "geo-zones"), fx.fx_entities(spark, sf), fx.SCOPE)


def _flat_kpis(rows):
    return (
        rows.withColumn("lon", F.col("customer_location.lon")).withColumn("lat", F.col("customer_location.lat"))
        .withColumn("vertices", F.size(F.flatten("zone_shape")).cast("bigint"))
        .drop("customer_location", "zone_shape"))


def order_kpis(spark, sf):
    return _flat_kpis(_order_kpis(spark, sf))


def order_kpis_bucketed(spark, sf):
    """As order_kpis, from copies of the big tables that are bucketed by entity and order code."""
    copies = (
        (fx.fx_sessions(spark, sf), ("entity_id", "platform_order_code")),
        (fx.fx_locations(spark, sf), ("global_entity_id", "order_id")),
        (fx.fx_paid_fees(spark, sf), ("global_entity_id", "code")))
    path = staging_path(spark, "bucketed")
    tables = [tb.write_bucketed(df, f"slotwise_{i}_{path[-32:]}", keys, fx.BUCKETS, f"{path}/{i}") for i, (df, keys) in enumerate(copies)]
    return _flat_kpis(_order_kpis(spark, sf, *tables))


def revenue_profit(spark, sf):
    return wh.revenue_profit(_order_kpis(spark, sf)).select(
        "order_id", "entity_id", "actual_df_paid_by_customer", "commission_local", "joker_vendor_fee_local",
        "service_fee_local", "sof_local", "delivery_costs_local", "revenue_local", "gross_profit_local")


def small_order_fee(spark, sf):
    return fx.fx_sessions(spark, sf).select(
        "order_id", wh.small_order_fee(
            F.col("gfv_local"), F.col("dps_minimum_order_value_local"), F.col("mov_customer_fee_local")).alias("sof_local"))


def delivery_fee_paid(spark, sf):
    entities = wh.entity_platforms(fx.fx_entities(spark, sf), fx.SCOPE).select("entity_id", F.col("region").alias("fee_region"))
    s = wh.join_dimension(fx.fx_sessions(spark, sf), entities, ["entity_id"])
    fees = fx.fx_paid_fees(spark, sf).select(
        F.col("global_entity_id").alias("entity_id"), F.col("code").alias("platform_order_code"),
        F.col("created_date_utc").alias("created_date"), F.col("delivery_fee_local").alias("table_fee"))
    return s.join(fees, ["entity_id", "platform_order_code", "created_date"], "left").select(
        "order_id", "fee_region", wh.delivery_fee_paid(
            F.col("fee_region"), F.col("table_fee"), F.col("is_delivery_fee_covered_by_discount"),
            F.col("is_delivery_fee_covered_by_voucher"), F.col("delivery_fee_local"), fx.SCOPE.fee_table_regions,
        ).alias("actual_df_paid_by_customer"))


def dow_day_num(spark, sf):
    local = F.col("order_placed_at_local")
    return fx.fx_sessions(spark, sf).select(
        "order_id", weekday_name(local).alias("dow_local"),
        day_number(local, F.lit(fx.SCOPE.start_date)).cast("bigint").alias("day_num"))


def scope_variables(spark, sf):
    return wh.sessions_in_scope(fx.fx_sessions(spark, sf), fx.SCOPE).select(
        "order_id", "entity_id", "created_date", F.col("assignment_id").cast("bigint").alias("asa_id"),
        F.lit(fx.SCOPE.start_date).alias("start_date_var"), F.lit(fx.SCOPE.end_date).alias("end_date_var"))


def point_in_zone(spark, sf):
    zones = stage(wh.scan_nested(fx.fx_countries(spark, sf)), "zones")
    points = fx.fx_sessions(spark, sf).select("order_id", "platform_order_code", *wh.ZONE_KEYS).join(
        fx.fx_locations(spark, sf).select(
            F.col("global_entity_id").alias("entity_id"), F.col("order_id").alias("platform_order_code"),
            geo_point(F.col("delivery_location.longitude"), F.col("delivery_location.latitude")).alias("point")),
        ["entity_id", "platform_order_code"])
    inside = wh.points_in_zones(points, zones, "point")
    return inside.select("order_id", "zone_id", F.col("point.lon").alias("lon"), F.col("point.lat").alias("lat"))


def point_in_zone_geodesic(spark, sf):
    """Every point with the zones that hold it, edges along great circles."""
    return zones_of_points(fx.fx_globe_points(spark, sf), fx.fx_globe_zones(spark, sf), "lon", "lat", "shape").select("point", "zone")


# --- interval slots -------------------------------------------------------------------


def slot_series(spark, sf):
    return iv.slot_series(starts(spark, sf), IV_WINDOW, IV_DAYS).select(GROUP, "slot_no", "slot_label", "slot_date")


def equal_width_bins(spark, sf):
    return iv.equal_width_bins(starts(spark, sf), IV_WINDOW, IV_DAYS).select(
        GROUP, "slot_no", "slot_label", "interval_no", "interval_start", "interval_end")


def slot_zone_grid(spark, sf):
    return iv.slot_zone_grid(prepared(spark, sf), IV_WINDOW, IV_DAYS, IV_SALT).select(
        GROUP, "zone_name", "slot_label", "slot_date", "interval_no", "time_zone_unit_id")


def interval_join(spark, sf):
    return iv.with_interval(prepared(spark, sf), IV_WINDOW, IV_DAYS).select(
        "platform_order_code", GROUP, "interval_no")


def interval_range_join(spark, sf):
    """Orders in slots of any shape; orders outside all slots stay."""
    rows = prepared(spark, sf).select("platform_order_code", GROUP, zo.SESSION_TS)
    return join_intervals(rows, fx.fx_slots(spark, sf), zo.SESSION_TS, "slot_from", "slot_to", [GROUP], "left").select(
        "platform_order_code", GROUP, "slot_key")


def v1_slot_join(spark, sf):
    rows = zo.within_exp_length(prepared(spark, sf), IV_DAYS)
    return iv.with_zone_slot(rows, IV_WINDOW, IV_DAYS, IV_SALT).select(
        "platform_order_code", GROUP, "zone_name", "interval_no", "time_zone_unit_id")


# --- sources and sinks ----------------------------------------------------------------

EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def _events_csv(spark, sf):
    path = staging_path(spark, "events-csv")
    (fx.table(spark, sf, "events").select(*EVENTS)
     .write.options(header=True, compression="gzip", **tb.CSV_OPTIONS).csv(path))
    return path


def scan_csv_gzip(spark, sf):
    return tb.read_csv_gzip(
        spark, _events_csv(spark, sf),
        schema="event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def scan_csv_gzip_inferred(spark, sf):
    return tb.read_csv_gzip(spark, _events_csv(spark, sf)).withColumn("event_id", F.col("event_id").cast("bigint")).withColumn(
        "user_id", F.col("user_id").cast("bigint"))


def infer_datetime_columns(spark, sf):
    texts = fx.table(spark, sf, "events").select(
        F.col("event_id"), F.col("ts").cast("string").alias("ts_text"), "event_type",
        F.when(F.col("event_id") % 2 == 0, F.to_date("ts").cast("string")).otherwise("unknown").alias("mixed"),
        F.when(F.col("event_id") % 2 == 0, F.to_date("ts").cast("string")).alias("gaps"))
    return tb.infer_datetime_columns(texts)


def infer_datetime_formats(spark, sf):
    """Mixed offsets, month names, day first, month first, both at once (stays text), gaps and an empty column."""
    texts = fx.table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 3 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
           WHEN 1 THEN concat(date_format(ts + INTERVAL 2 HOURS, 'yyyy-MM-dd HH:mm:ss'), '+02:00')
           ELSE concat(date_format(ts - INTERVAL 330 MINUTES, 'yyyy/M/d HH:mm:ss'), ' -0530') END AS offsets""",
        "IF(event_id % 2 = 0, date_format(ts, 'd MMM yyyy HH:mm'), date_format(ts, 'MMMM d, yyyy h:mm a')) AS names",
        "date_format(ts, 'dd/MM/yyyy HH:mm:ss') AS day_first", "date_format(ts, 'M/d/yyyy') AS month_first",
        "IF(event_id % 2 = 0, date_format(ts, 'dd/MM/yyyy'), date_format(ts, 'MM/dd/yyyy')) AS both_orders",
        "IF(event_id % 5 = 0, ' ', date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss')) AS gaps", "CAST(NULL AS STRING) AS empty")
    return infer_formats(texts)


def ctas_replace(spark, sf):
    path = staging_path(spark, "zones-table")
    name = "slotwise_zones_" + path[-32:]
    return tb.replace_table(geo_zones(spark, sf), name, path)


def write_results(spark, sf):
    path = staging_path(spark, "results-table")
    return tb.write_results(fx.fx_pvals(spark, sf), "slotwise_results_" + path[-32:], path)


def report_csv(spark, sf):
    path = staging_path(spark, "report-csv")
    tb.write_report_csv(tb.conform_results(fx.fx_pvals(spark, sf)), path)
    return spark.read.options(header=True, **tb.CSV_OPTIONS).schema(tb.RESULT_SCHEMA).csv(path)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    allocate_switchback, allocate_fractional, slot_assign, import_allocation, attach_variants, variant_balance, variant_balance_test,
    zone_groups, start_ts_per_group, exp_length_filter, week_bucket, export_allocation_input, export_allocation_order,
    sim_grid, run_keys,
    slot_totals, slot_totals_wide_grid, slot_per_order, variant_moments, welch_slot_tot, welch_slot_per_order, welch_order_level,
    pval_union, aa_study, daily_study, imported_slot_totals, imported_welch, v1_study,
    sig_counts, sig_share, sig_pct_grid, sig_pct_grid_order_level, sig_pct_grid_order_level_matching, overall_sig_slot, overall_sig_order,
    relabel_alpha, kpi_family, pval_histogram, pval_histogram_dense, report_parameters, pval_hist_pct, pval_hist_calcs,
    scan_nested, geo_zones, entity_region, semi_join_entities, order_kpis, order_kpis_bucketed, revenue_profit, small_order_fee,
    delivery_fee_paid, dow_day_num, point_in_zone, point_in_zone_geodesic,
    slot_series, equal_width_bins, slot_zone_grid, interval_join, interval_range_join, v1_slot_join,
    scan_csv_gzip, scan_csv_gzip_inferred, infer_datetime_columns, infer_datetime_formats, ctas_replace, write_results, report_csv,
)} | {"iso_timestamp": iso_timestamps, "sql_variables": scope_variables}
