import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import GROUPS, order, orders
from slotwise.config import ALL_KPIS, StudyGrid
from slotwise.operators import slots as sl
from slotwise.operators import welch as we
from slotwise.operators import zones as zo
from slotwise.sources.staging import stage
from test_slots import random_orders


def frame(spark, groups):
    rows = [(v, float(x) if x is not None else None) for v, xs in groups.items() for x in xs]
    return spark.createDataFrame(pa.table({
        "g": ["r"] * len(rows), "variant": pa.array([r[0] for r in rows], pa.int64()),
        "x": pa.array([r[1] for r in rows], pa.float64())}))


def welch(spark, groups):
    m = we.moments(frame(spark, groups), ["g"], ["x"])
    return we.welch_statistics(m, ["g", "kpi"]).first()


def by_hand(groups):
    xs = [np.array(v, float) for v in groups.values()]
    n, m, s2 = (np.array([f(x) for x in xs]) for f in (len, np.mean, lambda x: np.var(x, ddof=1)))
    w, k = n / s2, len(xs)
    lam = np.sum((1 - w / w.sum()) ** 2 / (n - 1))
    f = np.sum(w * (m - (w * m).sum() / w.sum()) ** 2) / (k - 1) / (1 + 2 * (k - 2) * lam / (k * k - 1))
    return f, (k * k - 1) / (3 * lam)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_statistic(spark, k):
    rng = np.random.default_rng(k)
    groups = {i + 1: rng.normal(10 + i / 4, 1 + i, 20 + 7 * i) for i in range(k)}
    got, (f, df2) = welch(spark, groups), by_hand(groups)
    assert got.f_stat == pytest.approx(f, rel=1e-9)
    assert (got.df1, got.df2) == (k - 1, pytest.approx(df2, rel=1e-9))
    assert 0 <= got.anova_pval <= 1 and got.anova_pval == round(got.anova_pval, 4)


def test_textbook_two_groups(spark):
    # Two groups: Welch's t-test, whose p at t = 2 with equal variances is the t tail.
    got = welch(spark, {1: [1, 2, 3, 4, 5], 2: [3, 4, 5, 6, 7]})
    assert got.f_stat == pytest.approx(4.0) and got.df2 == pytest.approx(8.0)
    assert got.anova_pval == 0.0805


@pytest.mark.parametrize("groups", [
    {1: [1, 2, 3]},  # one variant
    {1: [1, 2, 3], 2: [5]},  # a variant with one value
    {1: [1, 2, 3], 2: [5, 5, 5]},  # a variant without variance
    {1: [0.1] * 9, 2: [0.1] * 9},  # constant KPI
    {1: [1, 2, 3], 2: [None, None]},  # a variant without values
])
def test_degenerate_groups_have_no_p_value(spark, groups):
    got = welch(spark, groups)
    assert got.f_stat is None and got.anova_pval is None


def test_missing_values_are_skipped_and_equal_means_give_one(spark):
    got = welch(spark, {1: [1, 2, 3, None], 2: [0, 2, 4, None]})
    assert got.f_stat == 0 and got.anova_pval == 1.0


def test_order_level_moments_equal_the_direct_ones(spark):
    grid = StudyGrid(window_hours=(2, 3), num_variants=(2, 3), exp_lengths=(2, 4), seed="9")
    prepared = zo.prepare_orders(random_orders(spark), GROUPS)
    got = we.order_level_moments(sl.granule_facts(prepared, grid), grid)
    rows = sl._grid_rows(prepared, grid)
    direct = sl.with_variants(
        sl._per_length(sl._per_window(rows, grid), grid), grid)
    want = we.moments(direct, we.RUN_KEYS, ALL_KPIS)
    pairs = got.alias("a").join(want.alias("b"), [*we.RUN_KEYS, "variant", "kpi"], "full").select(
        F.col("a.n").alias("n1"), F.col("b.n").alias("n2"), F.col("a.mean").alias("m1"), F.col("b.mean").alias("m2"),
        F.col("a.variance").alias("v1"), F.col("b.variance").alias("v2")).collect()
    # Groups, windows, lengths, variants of both counts, KPIs.
    assert len(pairs) == 2 * 2 * 2 * (2 + 3) * 13
    for r in pairs:
        assert r.n1 == r.n2
        if r.n1:
            assert r.m1 == pytest.approx(r.m2, rel=1e-12)
        if r.n1 > 1:
            assert r.v1 == pytest.approx(r.v2, rel=1e-9, abs=1e-12)


def test_constant_variant_away_from_the_mean_is_found(spark):
    # One zone's orders all cost 0.3, the other's vary: no variance is left in some variants.
    rows = [order(f"o{i}", 31 * i, zone="ab"[i % 2], zone_id=i % 2, gfv_local=0.3 if i % 2 else 0.1 * (i % 7))
            for i in range(300)]
    grid = StudyGrid(window_hours=(24,), num_variants=(5, 6), exp_lengths=(7,), seed="2")
    prepared = zo.prepare_orders(orders(spark, rows), GROUPS)
    got = we.order_level_moments(sl.granule_facts(prepared, grid, ["gfv_local"]), grid, ["gfv_local"])
    direct = we.moments(
        sl.with_variants(sl._per_length(sl._per_window(sl._grid_rows(prepared, grid), grid), grid), grid),
        we.RUN_KEYS, ["gfv_local"])
    constant = [tuple(r) for r in direct.where("variance = 0").select(*we.RUN_KEYS, "variant").collect()]
    assert constant
    assert sorted(constant) == sorted(
        tuple(r) for r in got.where("variance = 0").select(*we.RUN_KEYS, "variant").collect())


def test_share_of_false_alarms_is_near_alpha(spark):
    # Orders without any effect: about alpha of the p-values may be significant.
    rng = np.random.default_rng(1)
    rows = [order(f"o{i}", int(m), zone="c", zone_id=7, asa=2, gfv_local=float(v))
            for i, (m, v) in enumerate(zip(rng.integers(0, 27 * 1440, 6000), rng.normal(20, 5, 6000)))]
    grids = [StudyGrid(num_variants=(2, 3, 4, 5, 6, 7), exp_lengths=(28,), seed=str(seed)) for seed in range(10)]
    # Facts do not depend on the seed: one table serves every re-draw of the variants.
    facts = stage(sl.granule_facts(zo.prepare_orders(orders(spark, rows), GROUPS), grids[0], ["gfv_local"]), "facts")
    labels = []
    for grid in grids:
        results = we.p_values(we.order_level_moments(facts, grid, ["gfv_local"]), grid)
        labels += [r.anova_sig == "significant" for r in results.collect()]
    assert len(labels) == 10 * 18
    assert 0.03 < np.mean(labels) < 0.2
