"""The default grid over the study's own zone groups: run and row counts, and consistency."""

import pytest
from pyspark.sql import functions as F

import fixture_views as fx
from helpers import GROUPS, order, orders, rows_of
from slotwise.config import STUDY_ZONE_GROUPS, StudyGrid
from slotwise.plans.study import full_study, imported_study
from slotwise.sources.staging import stage


@pytest.fixture(scope="module")
def results(spark):
    zones = [(g.entity_id, g.asa_id, z) for g in STUDY_ZONE_GROUPS for z in g.zone_names]
    names = F.array(*[
        F.struct(F.lit(e).alias("entity_id"), F.lit(a).cast("bigint").alias("asa_id"), F.lit(z).alias("zone_name"))
        for e, a, z in zones])
    orders = fx.fx_orders(spark, "/root/testdata/sf0.01").drop("entity_id", "asa_id", "zone_name", "zone_id")
    number = F.pmod(F.xxhash64("platform_order_code"), F.lit(len(zones)))
    mapped = orders.withColumn("zone_id", number).withColumn("z", F.get(names, number.cast("int"))).select("*", "z.*")
    return stage(full_study(mapped, STUDY_ZONE_GROUPS, StudyGrid(seed="1")), "study-results")


def test_row_counts(results):
    assert results.select("sim_run_id").distinct().count() == 648
    assert results.where("kpi_type IN ('tot', 'per_order')").count() == 15_552
    assert results.where("kpi_type = 'order_level'").count() == 8_424


def test_kpis_per_run(results):
    got = {r.kpi_type: r.kpis for r in results.groupBy("kpi_type").agg(F.count_distinct("kpi").alias("kpis")).collect()}
    assert got == {"tot": 11, "per_order": 13, "order_level": 13}
    assert results.where("kpi_type = 'per_order' AND kpi = 'order_count'").count() == 0


def test_labels_and_the_constant_fee(results):
    assert results.where("(anova_sig = 'significant') != coalesce(anova_pval <= 0.1, false)").count() == 0
    assert results.where("kpi = 'service_fee_local' AND anova_pval IS NOT NULL").count() == 0
    share = results.where("anova_pval IS NOT NULL").agg(F.avg((F.col("anova_pval") <= 0.1).cast("double"))).first()[0]
    assert 0.04 < share < 0.2


def test_imported_allocation_leaves_out_orders_without_unit_or_variant(spark):
    rows = orders(spark, [order(f"o{i}", 60 * i, gfv_local=float(i % 7)) for i in range(40)])
    allocation = [(f"o{i}", 1 + i % 2, f"slot-{i // 2}") for i in range(30)] + [("o30", None, "x"), ("o31", 1, None)]
    allocated = spark.createDataFrame(allocation, "OrderID string, Variant long, SlotID string")
    got = imported_study(rows, allocated, GROUPS, 2, 2, 28)
    assert got.count() == 24
    whole = allocated.where("Variant IS NOT NULL AND SlotID IS NOT NULL")
    assert rows_of(got) == rows_of(imported_study(rows, whole, GROUPS, 2, 2, 28))
