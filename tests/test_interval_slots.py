import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import GROUPS, START, order, orders, rows_of
from slotwise.operators import interval_slots as iv
from slotwise.operators import zones as zo


def test_bins_equal_pandas_cut(spark):
    starts = zo.group_starts(zo.tag_zone_groups(orders(spark, [order("o", 0)]), GROUPS))
    got = iv.equal_width_bins(starts, 3, 1).orderBy("slot_no").collect()
    labels = pd.Series([START + dt.timedelta(hours=3 * i) for i in range(8)])
    cut = pd.cut(labels, bins=8, right=False)
    assert [r.slot_label for r in got] == list(labels)
    assert [r.interval_start for r in got] == [c.left.to_pydatetime() for c in cut]
    for row, c in zip(got, cut):
        assert abs((row.interval_end - c.right.to_pydatetime()).total_seconds()) < 1e-3
    assert (got[1].interval_start - got[0].interval_start) == dt.timedelta(hours=2, minutes=37, seconds=30)


def test_labels_are_three_hours_apart_whatever_the_window(spark):
    starts = zo.group_starts(zo.tag_zone_groups(orders(spark, [order("o", 0)]), GROUPS))
    for window, n in ((2, 12), (4, 6)):
        got = [r.slot_label for r in iv.slot_series(starts, window, 1).orderBy("slot_no").collect()]
        assert got == [START + dt.timedelta(hours=3 * i) for i in range(n)]
    with pytest.raises(ValueError):
        iv.slot_total(24, 1)


def test_computed_interval_equals_the_search(spark):
    rows = [order(f"o{i}", 17 * i, zone="ab"[i % 2], zone_id=i % 2) for i in range(160)]
    prepared = zo.prepare_orders(orders(spark, rows), GROUPS)
    starts = prepared.select(zo.GROUP, "start_s").distinct()
    bins = iv.equal_width_bins(starts, 4, 1).select(zo.GROUP, "interval_no", "interval_start", "interval_end")
    ts = F.col(zo.SESSION_TS)
    searched = prepared.join(bins, zo.GROUP).where((ts >= F.col("interval_start")) & (ts < F.col("interval_end")))
    computed = iv.with_interval(prepared, 4, 1).where("interval_no IS NOT NULL")
    columns = ["platform_order_code", "interval_no"]
    assert rows_of(computed.select(columns)) == rows_of(searched.select(columns))
    assert 0 < computed.count() < 160


def test_zone_slot_equals_the_join(spark):
    rows = [order(f"o{i}", 17 * i, zone="ab"[i % 2], zone_id=i % 2) for i in range(160)]
    prepared = zo.prepare_orders(orders(spark, rows), GROUPS)
    grid = iv.slot_zone_grid(prepared, 4, 2, "s").select(
        zo.GROUP, "zone_name", "interval_no", F.col("slot_date").alias("d"), "time_zone_unit_id")
    joined = iv.with_interval(prepared, 4, 2).withColumn("d", F.to_date(zo.SESSION_TS)).join(
        grid, [zo.GROUP, "zone_name", "interval_no", "d"], "left")
    computed = iv.with_zone_slot(prepared, 4, 2, "s")
    columns = ["platform_order_code", "time_zone_unit_id"]
    assert rows_of(joined.select(columns)) == rows_of(computed.select(columns))
    assert grid.count() == grid.select("time_zone_unit_id").distinct().count() == 2 * 12
