"""Facts kept by day equal one pass over all orders, bit by bit."""

import pytest
from pyspark.sql import functions as F

import fixture_views as fx
from helpers import rows_of
from slotwise.config import StudyGrid
from slotwise.operators import slots as sl
from slotwise.operators import zones as zo
from slotwise.plans.daily import DailyStudy, stage_by_day
from slotwise.plans.study import study_facts

GRIDS = [StudyGrid(window_hours=(2, 3), num_variants=(2, 3), exp_lengths=(3, 7), seed="1"),
         StudyGrid(window_hours=(1.5, 2, 7), num_variants=(2,), exp_lengths=(3, 7), seed="1")]
KEYS = ["zone_group", "zone_id", "window_s", "slot_idx", "exp_length"]


@pytest.fixture(scope="module")
def by_day(spark):
    rows = fx.fx_orders(spark, "/root/testdata/sf0.001")
    # Codes that come again on other days.
    return stage_by_day(rows.withColumn("platform_order_code", F.expr("CAST(CAST(platform_order_code AS INT) % 150 AS STRING)")), "by-day")


@pytest.mark.parametrize("grid", GRIDS, ids=["one word", "several words"])
def test_day_by_day_equals_the_whole(spark, tmp_path, by_day, grid):
    kept = DailyStudy(spark, str(tmp_path / "kept"), fx.GROUPS, grid)
    kept.begin(by_day)
    kept.add_days(by_day, [1, 2, 3])
    kept.add_range(by_day, [5, 6, 7])
    kept.add_days(by_day, [4, 4, 2])  # a day may come late and again
    assert kept.days() == [1, 2, 3, 4, 5, 6, 7]
    facts, counts = study_facts(by_day, fx.GROUPS, grid)
    want = sl.grid_slots(facts, counts, grid)
    got = sl.grid_slots(kept.facts(), kept.order_counts(), grid)
    assert rows_of(got) == rows_of(want) and want.agg(F.sum("order_count")).first()[0] > 100


def test_results_so_far_are_those_of_the_days_so_far(spark, tmp_path, by_day):
    grid = GRIDS[0]
    kept = DailyStudy(spark, str(tmp_path / "kept"), fx.GROUPS, grid)
    kept.begin(by_day)
    kept.add_range(by_day, range(1, 8))
    alone = DailyStudy(spark, str(tmp_path / "alone"), fx.GROUPS, grid)
    alone.begin(by_day)
    alone.add_range(by_day, range(1, 5))
    assert rows_of(kept.results(through=4)) == rows_of(alone.results())


def test_a_new_day_reads_that_day_only(spark, tmp_path, by_day):
    kept = DailyStudy(spark, str(tmp_path / "kept"), fx.GROUPS, GRIDS[0])
    kept.begin(by_day)
    rows = kept.prepared(by_day, [3])
    for frame in (sl.granule_facts(rows, GRIDS[0]), sl.order_masks(rows, GRIDS[0], GRIDS[0].windows_s)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan" in line and "zone_name" in line)
        assert "PartitionFilters" in scan and "= 3)" in scan.split("PartitionFilters")[1].split("]")[0]
    files = by_day.where("day_num = 3").select(F.input_file_name()).distinct().collect()
    assert files and all("day_num=3/" in r[0] for r in files)
