import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import GROUPS, START, order, orders, rows_of
from slotwise.config import Allocation, OrderScope, StudyGrid, check_alpha, check_bin_width
from slotwise.operators import allocation as al
from slotwise.operators import zones as zo


def study_orders(spark):
    rows = [order(f"o{i}", 37 * i, zone="ab"[i % 2], zone_id=i % 2) for i in range(400)]
    rows += [order(f"p{i}", 53 * i, zone="c", zone_id=7, asa=2) for i in range(200)]
    return orders(spark, rows)


def test_one_variant_per_slot_and_all_variants_used(spark):
    out = al.allocate(zo.prepare_orders(study_orders(spark), GROUPS), Allocation(3, 3, 7, "s"))
    slots = out.groupBy("zone_id", "slot_idx").agg(
        F.count_distinct("variant").alias("v"), F.count_distinct("time_zone_unit_id").alias("u")).collect()
    assert all(r.v == 1 and r.u == 1 for r in slots)
    assert out.select("time_zone_unit_id").distinct().count() == len(slots)
    assert {r[0] for r in out.select("variant").distinct().collect()} == {1, 2, 3}


def test_same_result_after_repartition_and_another_with_other_salt(spark):
    base = study_orders(spark)
    one = al.allocate(zo.prepare_orders(base, GROUPS), Allocation(2, 4, 7, "s")).select("platform_order_code", "variant")
    two = al.allocate(zo.prepare_orders(base.repartition(5, "zone_name"), GROUPS), Allocation(2, 4, 7, "s")).select(
        "platform_order_code", "variant")
    other = al.allocate(zo.prepare_orders(base, GROUPS), Allocation(2, 4, 7, "t")).select("platform_order_code", "variant")
    assert rows_of(one) == rows_of(two)
    assert rows_of(one) != rows_of(other)


def test_slot_edges_and_fractional_window(spark):
    rows = [order("o0", 0), order("o1", 89), order("o2", 90), order("o3", 24 * 60 + 90)]
    out = al.allocate(zo.prepare_orders(orders(spark, rows), GROUPS), Allocation(1.5, 2, 1, "s"))
    got = {r[0]: tuple(r)[1:] for r in out.select("platform_order_code", "slot_idx", "slot_of_day", "slot_start").collect()}
    assert got == {
        "o0": (0, 0, START), "o1": (0, 0, START),
        "o2": (1, 1, START + dt.timedelta(minutes=90)), "o3": (17, 1, START + dt.timedelta(hours=25.5)),
    }


def test_missing_zone_or_time_has_no_slot(spark):
    rows = [order("o0", 0), order("o1", 5, zone_id=None)]
    out = al.allocate(zo.prepare_orders(orders(spark, rows), GROUPS), Allocation(2, 2, 1, "s"))
    got = {r[0]: (r[1], r[2]) for r in out.select("platform_order_code", "variant", "time_zone_unit_id").collect()}
    assert got["o1"] == (None, None) and got["o0"][0] in (1, 2)


def test_group_start_cuts_sub_seconds(spark):
    df = orders(spark, [order("o0", 0), order("o1", 60)]).withColumn(
        "dps_sessionid_created_at_utc", F.col("dps_sessionid_created_at_utc") + F.expr("INTERVAL '0.75' SECOND"))
    tagged = zo.tag_zone_groups(df, GROUPS)
    assert [tuple(r) for r in zo.group_start_times(tagged).collect()] == [
        ("E0", "zg_1", "2023-01-01T00:48:04Z", "2023-01-01T01:48:04Z")]


def test_imported_allocation_keeps_unmatched_and_multiplies_duplicates(spark):
    df = orders(spark, [order("o0", 0), order("o1", 5), order("o1", 6), order(None, 7)])
    imported = spark.createDataFrame(pa.table({
        "OrderID": ["o1", "o1"], "Variant": pa.array([1, 2], pa.int64()), "SlotID": ["s", "t"]}))
    got = rows_of(al.attach_variants(df, imported).select("platform_order_code", "variant"))
    assert got == sorted([("o0", None), (None, None)] + [("o1", 1), ("o1", 2)] * 2, key=repr)


def test_order_in_two_groups_comes_out_twice(spark):
    groups = (*GROUPS, type(GROUPS[0])("E0", 1, ("a", "a"), "zg_3"))
    got = rows_of(zo.tag_zone_groups(orders(spark, [order("o0", 0)]), groups).select(zo.GROUP))
    assert got == [("zg_1",), ("zg_3",)]


def test_grid(spark):
    starts = zo.group_starts(zo.tag_zone_groups(study_orders(spark), GROUPS))
    runs = al.simulation_grid(starts, StudyGrid()).collect()
    assert len(runs) == len({r.sim_run_id for r in runs}) == 2 * 3 * 6 * 4
    assert "zg_1-3-window_size-5-var_num-21-exp_length" in {r.sim_run_id for r in runs}
    assert all(1000 <= r.run_key <= 2000 and len(r.run_salt) == 32 for r in runs)
    assert len({r.run_salt for r in runs}) == len(runs)


def test_day_filter(spark):
    df = orders(spark, [order("a", 0, day=0), order("b", 0, day=7), order("c", 0, day=8), order("d", 0, day=29),
                        order("e", 0).copy() | {"day_num": None}])
    assert rows_of(zo.within_exp_length(df, 7).select("platform_order_code")) == [("a",), ("b",)]
    tagged = df.withColumn(zo.GROUP, F.lit("zg_1"))
    got = rows_of(zo.per_exp_length(tagged, (7, 14)).select("exp_length", "orders", "days", "last_day"))
    # Sorted by column name: days, exp_length, last_day, orders.
    assert got == [(2, 7, 7, 2), (3, 14, 8, 3)]


def test_missing_order_codes_keep_their_orders(spark):
    df = orders(spark, [order("a", 0), order(None, 1), order(None, 2), order("b", 3)])
    allocated = spark.createDataFrame([("a", 1, "s"), (None, 2, "t"), ("a", 3, "u")], "OrderID string, Variant long, SlotID string")
    got = rows_of(al.attach_variants(df, allocated).select("platform_order_code", "variant"))
    assert got == sorted([("a", 1), ("a", 3), (None, None), (None, None), ("b", None)], key=repr)


def test_parameters_are_checked():
    for bad in (lambda: Allocation(0, 2), lambda: Allocation(2, 0), lambda: Allocation(2, 1.5),
                lambda: StudyGrid(window_hours=()), lambda: StudyGrid(num_variants=(1,)), lambda: StudyGrid(alpha=1),
                lambda: check_alpha(0.2), lambda: check_bin_width(0.3),
                lambda: OrderScope(start_date=dt.date(2023, 2, 1)), lambda: OrderScope(asa_ids=())):
        with pytest.raises(ValueError):
            bad()
    drawn = Allocation(3.0, 3)
    assert 0 <= drawn.key <= 32767 and len(drawn.salt) == 36


def test_long_value_lists_are_pushed_as_a_range(spark, monkeypatch):
    df = orders(spark, [order("a", 0), order("b", 0, zone="c"), order("c", 0, asa=3), order("d", 0, entity="E9")])
    listed = rows_of(zo.tag_zone_groups(df, GROUPS).select("platform_order_code", zo.GROUP))
    monkeypatch.setattr(zo, "MAX_PUSHED_VALUES", 0)
    ranged = zo.tag_zone_groups(df, GROUPS)
    assert rows_of(ranged.select("platform_order_code", zo.GROUP)) == listed
