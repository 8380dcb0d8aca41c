import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import fixture_views as fx
from helpers import rows_of
from slotwise.operators import joins
from slotwise.operators import warehouse as wh


def test_small_order_fee(spark):
    cases = [(10.0, 8.0, 1.0), (8.0, 8.0, 1.0), (5.0, 8.0, 1.0), (5.0, 8.0, None), (5.0, None, 2.0), (5.0, None, None)]
    df = spark.createDataFrame(pa.table({
        "i": range(6), **{n: pa.array([c[j] for c in cases], pa.float64()) for j, n in enumerate("gmf")}}))
    got = [r[0] for r in df.orderBy("i").select(wh.small_order_fee(F.col("g"), F.col("m"), F.col("f"))).collect()]
    assert got == [0.0, 0.0, 1.0, 3.0, 2.0, None]


def test_delivery_fee_paid(spark):
    cases = [
        ("Asia", 3.0, True, False, 9.0), ("Asia", None, True, False, 9.0), ("Europe", None, None, False, 9.0),
        ("Africa", 3.0, False, None, 9.0), ("Africa", 3.0, None, True, 9.0), (None, 3.0, False, False, 9.0),
        ("Asia", None, None, None, None),
    ]
    kinds = (pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.float64())
    df = spark.createDataFrame(pa.table({
        "i": range(len(cases)), **{n: pa.array([c[j] for c in cases], kinds[j]) for j, n in enumerate("rtdvf")}}))
    fee = wh.delivery_fee_paid(*(F.col(c) for c in "rtdvf"), ("Europe", "Asia"))
    assert [r[0] for r in df.orderBy("i").select(fee).collect()] == [3.0, 0.0, 9.0, 9.0, 0.0, None, None]


def test_unknown_part_makes_revenue_unknown(spark):
    names = ("actual_df_paid_by_customer", "commission_local", "joker_vendor_fee_local", "service_fee_local", "sof_local",
             "delivery_costs_local")
    df = spark.createDataFrame(pa.table({
        n: pa.array([1.0, None if n == "joker_vendor_fee_local" else 1.0], pa.float64()) for n in names}))
    got = rows_of(wh.revenue_profit(df).select("gross_profit_local", "revenue_local"))
    assert got == [(4.0, 5.0), (None, None)]


def test_day_number_spans_the_local_calendar(spark):
    from slotwise.functions.scalars import day_number

    days = [dt.datetime(2022, 12, 31, 23), dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 29, 1)]
    df = spark.createDataFrame(pa.table({"t": pa.array(days, pa.timestamp("us"))}))
    assert sorted(r[0] for r in df.select(day_number(F.col("t"), F.lit(dt.date(2023, 1, 1)))).collect()) == [0, 1, 29]


def test_empty_arrays_give_nulls_and_platforms_pair_with_zones(spark):
    df = spark.sql("""
      SELECT 'c1' AS country_code, array(named_struct('entity_id', 'E1'), named_struct('entity_id', 'E2')) AS platforms,
        array(named_struct('name', 'x', 'id', 1L, 'is_active', true, 'zones', array(
          named_struct('shape', array(array(named_struct('lon', 0D, 'lat', 0D))), 'name', 'z', 'id', 5L, 'is_active', true)))) AS cities
      UNION ALL SELECT 'c2', NULL, NULL""")
    got = rows_of(wh.scan_nested(df).select("country_code", "entity_id", "zone_id"))
    assert got == [("c1", "E1", 5), ("c1", "E2", 5), ("c2", None, None)]


def test_duplicate_matches_multiply(spark, sf_dir):
    def run(zones, locations, entities, fees):
        return wh.order_kpis(fx.fx_sessions(spark, sf_dir), locations, fees, zones, entities, fx.SCOPE).count()

    zones = wh.geo_zones(fx.fx_countries(spark, sf_dir), fx.SCOPE)
    locations, entities, fees = (f(spark, sf_dir) for f in (fx.fx_locations, fx.fx_entities, fx.fx_paid_fees))
    once = run(zones, locations, entities, fees)
    assert once > 0
    assert run(zones.union(zones), locations, entities, fees) == 2 * once
    assert run(zones, locations.union(locations), entities, fees) == 2 * once
    assert run(zones, locations, entities.union(entities), fees) == 2 * once
    assert run(zones, locations, entities, fees.limit(0)) == once


def test_configured_join_equals_plain_join(spark, sf_dir):
    big = fx.fx_sessions(spark, sf_dir).select("order_id", "zone_id", "entity_id")
    dim = big.select("zone_id").distinct().where("zone_id % 2 = 0").withColumn("x", F.col("zone_id") * 2)
    dim = dim.union(dim)
    for how in ("inner", "left", "left_semi"):
        small = joins.join_dimension(big, dim, ["zone_id"], how, configured_rows=10)
        large = joins.join_dimension(big, dim, ["zone_id"], how, configured_rows=joins.MAX_BROADCAST_ROWS + 1)
        assert rows_of(small) == rows_of(large) == rows_of(joins.join_dimension(big, dim, ["zone_id"], how))


def test_scope_filters_reach_the_scan(spark, tmp_path):
    # Else the plan's text would be cut short.
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    path = str(tmp_path / "sessions")
    spark.range(10).selectExpr(
        "DATE'1996-01-01' AS created_date", "'Automatic scheme' AS vendor_price_scheme_type", "true AS is_sent",
        "'400' AS assignment_id", "'E0' AS entity_id", "id").write.parquet(path)
    plan = wh.sessions_in_scope(spark.read.parquet(path), fx.SCOPE)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for name in ("created_date", "vendor_price_scheme_type", "is_sent", "entity_id"):
        assert name in pushed.split("ReadSchema")[0]


@pytest.mark.parametrize("bad", ["abc"])
def test_bad_assignment_ids_are_an_error(spark, bad):
    df = spark.createDataFrame(pa.table({
        "created_date": [dt.date(1996, 5, 1)], "vendor_price_scheme_type": ["Automatic scheme"], "is_sent": [True],
        "assignment_id": [bad], "entity_id": ["E0"]}))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        wh.sessions_in_scope(df, fx.SCOPE).collect()
