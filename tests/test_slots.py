import random

import pytest
from pyspark.sql import functions as F

from helpers import GROUPS, order, orders, rows_of
from slotwise.config import ALL_KPIS, Allocation, StudyGrid
from slotwise.operators import allocation as al
from slotwise.operators import slots as sl
from slotwise.operators import zones as zo

GRID = StudyGrid(window_hours=(2, 3, 4), num_variants=(2, 3), exp_lengths=(1, 2, 4))


def random_orders(spark, n=1500, codes=300):
    """Repeated codes (also across lengths), a hot code, missing codes, zones, days and KPIs."""
    rnd = random.Random(3)
    rows = []
    for _ in range(n):
        code = "hot" if rnd.random() < 0.33 else None if rnd.random() < 0.1 else f"o{rnd.randrange(codes)}"
        zone = rnd.choice("abc")
        kpis = {k: rnd.choice([None, round(rnd.random() * 9, 2)]) for k in ALL_KPIS}
        rows.append(order(
            code, rnd.randrange(5 * 24 * 60), zone=zone, zone_id=rnd.choice([None, ord(zone), ord(zone)]),
            asa=2 if zone == "c" else 1, day=rnd.choice([0, 1, 2, 3, 4, 5]), **kpis))
    return orders(spark, rows)


def direct_counts(prepared, grid):
    out = None
    for w in grid.windows_s:
        for n in grid.exp_lengths:
            part = (
                prepared.where((F.col("day_num") <= n) & F.col("zone_id").isNotNull())
                .withColumn("slot_idx", F.floor((F.unix_seconds(F.col(zo.SESSION_TS).cast("timestamp")) - F.col("start_s")) / w))
                .groupBy(F.col(zo.GROUP).alias("zone_group"), "zone_id", "slot_idx")
                .agg(F.count_distinct("platform_order_code").alias("order_count"), F.sum("gfv_local").alias("gfv"),
                     F.count("actual_DT").alias("n_dt"))
                .select("zone_group", "zone_id", F.lit(w).cast("bigint").alias("window_s"), "slot_idx",
                        F.lit(n).cast("bigint").alias("exp_length"), "order_count", F.round("gfv", 6).alias("gfv"), "n_dt"))
            out = part if out is None else out.unionByName(part)
    return out


def test_grid_slots_equal_the_direct_aggregation(spark):
    prepared = zo.prepare_orders(random_orders(spark), GROUPS)
    slots = sl.grid_slots(sl.granule_facts(prepared, GRID), sl.slot_order_counts(prepared, GRID), GRID)
    got = slots.select("zone_group", "zone_id", "window_s", "slot_idx", "exp_length", "order_count",
                       F.round("s_gfv_local", 6).alias("gfv"), F.col("n_actual_DT").alias("n_dt"))
    assert rows_of(got) == rows_of(direct_counts(prepared, GRID))


def test_masks_of_one_and_of_several_words_agree(spark, monkeypatch):
    prepared = zo.prepare_orders(random_orders(spark), GROUPS)
    keys = ["zone_group", "zone_id", "window_s", "slot_idx", "exp_length"]
    narrow = sl._grid_rows(prepared, GRID).where("platform_order_code IS NOT NULL").select(
        "zone_group", "zone_id", "granule", "first_length", "platform_order_code")
    masked = rows_of(sl._masked_order_counts(narrow, GRID, 12))
    for bits in (62, 7):
        monkeypatch.setattr(sl, "_WORD_BITS", bits)
        wide = sl._wide_order_counts(narrow, GRID, GRID.windows_s).groupBy(*keys).agg(F.sum("order_count").alias("order_count"))
        assert rows_of(wide) == masked


@pytest.mark.parametrize("hours", [(0.7, 5, 9), (1.5, 2, 7), (1, 2, 3, 4, 5, 7)])
def test_any_grid(spark, hours):
    prepared = zo.prepare_orders(random_orders(spark, 200), GROUPS)
    grid = StudyGrid(window_hours=hours, num_variants=(2,), exp_lengths=(2, 4))
    slots = sl.grid_slots(sl.granule_facts(prepared, grid), sl.slot_order_counts(prepared, grid), grid)
    got = slots.select("zone_group", "zone_id", "window_s", "slot_idx", "exp_length", "order_count",
                       F.round("s_gfv_local", 6).alias("gfv"), F.col("n_actual_DT").alias("n_dt"))
    assert rows_of(got) == rows_of(direct_counts(prepared, grid))


def test_one_shuffle_of_the_codes_for_a_wide_grid(spark):
    grid = StudyGrid(window_hours=(1.5, 2, 7), num_variants=(2,), exp_lengths=(7, 14, 21, 28))
    assert sl.window_families(grid) == [[5400, 7200, 25200]]
    counts = sl.slot_order_counts(zo.prepare_orders(random_orders(spark, 100), GROUPS), grid)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "platform_order_code" in line for line in plan.splitlines()) == 1


def test_windows_without_a_common_block_are_apart():
    grid = StudyGrid(window_hours=(0.7, 5, 9), num_variants=(2,), exp_lengths=(2, 4))
    families = sl.window_families(grid)
    assert sorted(w for f in families for w in f) == sorted(grid.windows_s) and 1 < len(families) <= 3


def test_design_and_allocated_sums_agree(spark):
    prepared = zo.within_exp_length(zo.prepare_orders(random_orders(spark), GROUPS), 4)
    allocation = Allocation(3, 3, 7, "s")
    by_slot = sl.slot_per_order(sl.design_sums(prepared, allocation))
    by_order = sl.slot_per_order(sl.allocated_sums(al.allocate(prepared, allocation)))
    assert rows_of(by_slot) == rows_of(by_order)


def test_slot_values(spark):
    rows = [
        order("o1", 0, gfv_local=0.125, actual_DT=0.125, sof_local=None),
        order("o1", 1, gfv_local=None, actual_DT=None, sof_local=None),
        order("o2", 2, gfv_local=1.0, actual_DT=None, sof_local=None),
        order(None, 3, gfv_local=1.0, actual_DT=None, sof_local=None),
    ]
    sums = sl.design_sums(zo.prepare_orders(orders(spark, rows), GROUPS), Allocation(3, 2, 7, "s"))
    tot, per = sl.slot_totals(sums).first(), sl.slot_per_order(sums).first()
    assert (tot.gfv_local, tot.sof_local, tot.order_count) == (2.12, 0.0, 2)  # 2.125 to even
    assert (per.gfv_local, per.actual_DT, per.order_count) == (1.06, 0.12, 2)
    missing = sl.slot_per_order(sl.design_sums(
        zo.prepare_orders(orders(spark, [order("o1", 0, actual_DT=None)]), GROUPS), Allocation(3, 2, 7, "s"))).first()
    assert missing.actual_DT is None


@pytest.mark.parametrize("window", [2, 3, 4])
def test_union_of_slots_covers_every_order_once(spark, window):
    rows = [order(f"o{i}", 11 * i, zone="ab"[i % 2], zone_id=i % 2) for i in range(500)]
    sums = sl.design_sums(zo.prepare_orders(orders(spark, rows), GROUPS), Allocation(window, 3, 7, "s"))
    assert sums.agg(F.sum("order_count")).first()[0] == 500


def test_study_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    path = str(tmp_path / "orders")
    random_orders(spark, 50).withColumn("unused", F.lit("x")).write.parquet(path)
    prepared = zo.prepare_orders(spark.read.parquet(path), GROUPS)
    plan = sl.granule_facts(prepared, GRID, ["gfv_local"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    facts = next(s for s in scans if "gfv_local" in s.split("ReadSchema")[1])
    for wanted in ("LessThanOrEqual(day_num,4)", "In(asa_id, [1,2])", "EqualTo(entity_id,E0)", "IsNotNull(zone_id)"):
        assert wanted in facts
    assert "unused" not in plan and "gmv_local" not in plan
    starts = next(s for s in scans if s is not facts)
    assert "gfv_local" not in starts and "platform_order_code" not in starts
