"""Bucketed copies of the warehouse tables join without a shuffle."""

import re

import pytest

import fixture_views as fx
import queries_spark as qs
from helpers import rows_of
from slotwise.sources import tables as tb


@pytest.fixture
def only_zones_are_sent(spark):
    """The zones and entities are broadcast, the three big tables are not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    """Shuffles by order code; the copies are written before the plan is made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines()
            if "Exchange hashpartitioning" in line and re.search(r"\b(platform_order_code|_fee_code|order_id|code)#", line)]


def test_big_joins_need_no_shuffle(spark, only_zones_are_sent):
    sf_dir = "/root/testdata/sf0.01"
    copies = {
        "s": (fx.fx_sessions(spark, sf_dir), ("entity_id", "platform_order_code")),
        "l": (fx.fx_locations(spark, sf_dir), ("global_entity_id", "order_id")),
        "f": (fx.fx_paid_fees(spark, sf_dir), ("global_entity_id", "code"))}
    made = {n: tb.write_bucketed(df, f"slotwise_test_{n}", keys, 4) for n, (df, keys) in copies.items()}
    for df in made.values():
        assert len(df.inputFiles()) <= 4
    bucketed = qs._order_kpis(spark, sf_dir, made["s"], made["l"], made["f"])
    assert exchanges(bucketed) == []
    plain = qs._order_kpis(spark, sf_dir)
    assert len(exchanges(plain)) == 3  # sessions, locations and fees once each
    assert rows_of(bucketed.drop("zone_shape")) == rows_of(plain.drop("zone_shape"))


def test_rows_without_a_key_are_left_out_and_files_are_sorted(spark):
    rows = [(i % 7 if i % 5 else None, i) for i in range(100)]
    out = tb.write_bucketed(spark.createDataFrame(rows, "k int, v int"), "slotwise_test_k", ["k"], 3)
    assert sorted((r.k, r.v) for r in out.collect()) == sorted(r for r in rows if r[0] is not None)
    for path in out.inputFiles():
        keys = [r.k for r in spark.read.parquet(path).coalesce(1).collect()]
        assert keys == sorted(keys)
    # Writing again replaces the copy.
    assert tb.write_bucketed(spark.createDataFrame(rows[:10], "k int, v int"), "slotwise_test_k", ["k"], 3).count() == 8
