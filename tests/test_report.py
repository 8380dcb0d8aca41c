import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from slotwise.operators import report as rp


def results(spark, rows):
    """rows of (window, variants, length, kpi, p, kpi_type)"""
    return spark.createDataFrame(pa.table({
        "sim_run_id": [f"r{i}" for i in range(len(rows))], "zone_group": ["zg_1"] * len(rows),
        "sb_window_size": pa.array([r[0] for r in rows], pa.int64()),
        "num_variants": pa.array([r[1] for r in rows], pa.int64()),
        "exp_length": pa.array([r[2] for r in rows], pa.int64()), "kpi": [r[3] for r in rows],
        "anova_pval": pa.array([r[4] for r in rows], pa.float64()), "anova_sig": ["significant"] * len(rows),
        "kpi_type": [r[5] for r in rows]}))


ROWS = [
    (2, 2, 7, "gfv_local", 0.05, "tot"), (2, 2, 7, "gmv_local", 0.1, "tot"), (2, 3, 7, "gfv_local", 0.5, "tot"),
    (2, 2, 14, "gfv_local", 0.2, "tot"), (3, 2, 7, "gfv_local", 0.01, "tot"), (2, 2, 7, "actual_DT", 0.01, "per_order"),
    (2, 2, 7, "gfv_local", 0.9, "per_order"), (2, 3, 14, "gfv_local", None, "per_order"),
]


def test_label_follows_the_reports_alpha(spark):
    df = results(spark, ROWS)
    assert df.count() == rp.relabel(df, 0.05).count()
    assert rp.relabel(df, 0.05).where("is_sig = 'significant'").count() == 3
    assert rp.relabel(df, 0.1).where("is_sig = 'significant'").count() == 4


def test_denominator_covers_all_lengths_and_variants(spark):
    got = rp.significance_cells(results(spark, ROWS), "Biz KPI")
    cells = {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()}
    assert cells["tot", 2, 2, 7] == (2, 4, 0.5)
    assert cells["tot", 2, 3, 7] == (0, 4, 0.0)
    assert cells["tot", 3, 2, 7] == (1, 1, 1.0)
    log = {tuple(r)[:4]: tuple(r)[4:] for r in rp.significance_cells(results(spark, ROWS), "Log KPI").collect()}
    # As published: business KPIs are counted below the logistics shares, too.
    assert log == {("per_order", 2, 2, 7): (1, 2, 0.5)}
    own = rp.significance_cells(results(spark, ROWS), "Log KPI", denominator="matching").first()
    assert (own.count_obs, own.pct_p_val_sig) == (1, 1.0)


def test_grid_puts_lengths_across(spark):
    wide = rp.significance_grid(results(spark, ROWS), "Biz KPI")
    assert [c for c in wide.columns if c.startswith("pct")] == ["pct_7d", "pct_14d", "pct_21d", "pct_28d"]
    row = wide.where("kpi_type = 'tot' AND sb_window_size = 2 AND num_variants = 2").first()
    assert (row.pct_7d, row.pct_14d, row.pct_21d) == (0.5, 0.0, None)


def test_overall_shares_add_up(spark):
    got = {r.is_sig: tuple(r)[1:] for r in rp.overall_significance(results(spark, ROWS)).collect()}
    assert got == {"significant": (4, 8, 0.5), "insignificant": (4, 8, 0.5)}


def test_bins_are_exact_on_their_edges(spark):
    ps = [0.0, 0.0499, 0.05, 0.15, 0.3, 0.9999, 1.0]
    df = spark.createDataFrame(pa.table({"p": ps}))
    got = [r[0] for r in df.select(rp.p_value_bin(F.col("p"), 0.05)).collect()]
    assert got == [0, 0, 1, 3, 6, 19, 20]


def test_histogram_and_empty_bins(spark):
    rows = [(2, 2, 7, "gfv_local", p, "tot") for p in (0.01, 0.02, 0.31, None)] + [(2, 2, 7, "gmv_local", 0.2, "tot")]
    hist = rp.p_value_histogram(results(spark, rows), 0.1)
    assert rows_of(hist.where("kpi = 'gfv_local'").select("p_val_bin", "records")) == sorted([(0.0, 2), (0.3, 1), (None, 1)], key=repr)
    assert hist.where("kpi = 'gfv_local'").agg(F.sum("pct_of_total")).first()[0] == pytest.approx(1)
    dense = rp.dense_histogram(results(spark, rows), 0.1)
    assert rows_of(dense.where("kpi = 'gmv_local'").select("p_val_bin", "records")) == [
        (0.0, 0), (0.1, 0), (0.2, 1), (0.3, 0)]
    missing = dense.where("kpi = 'gfv_local' AND p_val_bin IS NULL").select("is_sig", "records")
    assert rows_of(missing) == [("insignificant", 1)]
    nothing = rp.dense_histogram(results(spark, [(2, 2, 7, "gfv_local", None, "tot")]), 0.1)
    assert rows_of(nothing.select("p_val_bin", "records")) == [(None, 1)]


def test_calcs_along_the_bins(spark):
    ps = (0.01, 0.02, 0.11, 0.31, 0.32, 0.33, None)
    got = rp.histogram_calcs(results(spark, [(2, 2, 7, "gfv_local", p, "tot") for p in ps]), 0.1).orderBy("p_val_bin").collect()
    assert [r.records for r in got] == [2, 1, 3]
    assert [r.records_diff for r in got] == [None, -1, 2]
    assert [r.moving_records for r in got] == [2, 3, 6]
    assert got[-1].running_pct == pytest.approx(6 / 7)


def test_parameters(spark):
    df = results(spark, ROWS)
    for bad in (lambda: rp.relabel(df, 0.2), lambda: rp.binned(df, 0.03), lambda: rp.significance_cells(df, "Other"),
                lambda: rp.significance_cells(df, "Biz KPI", denominator="none")):
        with pytest.raises(ValueError):
            bad()


def test_sheet_leaves_out_the_service_fee(spark):
    df = results(spark, [(2, 2, 7, k, 0.5, "per_order") for k in ("gfv_local", "service_fee_local", "actual_DT")])
    assert rows_of(rp.sheet(df, "per_order", "Biz KPI").select("kpi")) == [("gfv_local",)]
