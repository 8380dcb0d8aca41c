"""Sums and moments whose bits do not depend on the order or the partitions of the rows."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import fixture_views as fx
from slotwise.functions import exact
from slotwise.operators import slots as sl
from slotwise.operators import welch as we
from slotwise.operators import zones as zo


def values(seed, n=900):
    rnd = random.Random(seed)
    return [rnd.choice([rnd.uniform(-1e6, 1e6), rnd.gauss(0, 1), round(rnd.uniform(0, 100), 2), rnd.uniform(0, 1e-6), 62.97679125])
            for _ in range(n)]


def frame(spark, rows, partitions):
    return spark.createDataFrame(rows, "g string, variant long, x double, y double").repartition(partitions)


def test_sums_are_the_rounded_exact_ones(spark):
    rows = [(v,) for v in values(1) if abs(v) > 1e-3] + [(None,), (float("nan"),), (float("inf"),), (1e300,)]
    df = spark.createDataFrame(rows, "x double").select(F.expr(exact.known("x")).alias("x"))
    got = df.agg(*map(F.expr, exact.sums("x", "w", "b"))).select(F.expr(exact.total("w", "b")).alias("s")).first().s
    want = sum(Fraction(round(Fraction(v) * 10**9), 10**9) for v, in rows[:-4])
    assert math.isclose(got, float(want), rel_tol=1e-15)


def test_cents_add_up_exactly(spark):
    df = spark.range(100_000).selectExpr("CAST(id % 977 AS DOUBLE) / 100D AS x")
    got = df.agg(*map(F.expr, exact.sums("x", "w", "b"))).select(F.expr(exact.total("w", "b")).alias("s")).first().s
    assert got == sum(i % 977 for i in range(100_000)) / 100


@pytest.mark.parametrize("seed", [1, 2])
def test_moments_have_the_same_bits_whatever_the_partitions(spark, seed):
    rows = [("a" if i % 3 else "b", i % 2 + 1, x, 7.1 if i % 5 else None) for i, x in enumerate(values(seed))]
    found = []
    for partitions in (1, 7, 64):
        random.Random(partitions).shuffle(rows)
        found.append(sorted(tuple(r) for r in we.moments(frame(spark, rows, partitions), ["g"], ["x", "y"]).collect()))
    assert found[0] == found[1] == found[2]
    for g, variant, kpi, n, mean, variance in found[0]:
        own = [Fraction(r[2 if kpi == "x" else 3]) for r in rows if (r[0], r[1]) == (g, variant) and r[2 if kpi == "x" else 3] is not None]
        centre = sum(own) / len(own)
        assert n == len(own) and math.isclose(mean, float(centre), rel_tol=1e-12, abs_tol=1e-9)
        want = float(sum((v - centre)**2 for v in own) / (n - 1))
        assert math.isclose(variance, want, rel_tol=1e-9, abs_tol=1e-12)
        assert kpi == "x" or variance == 0


def test_slots_and_orders_have_the_same_bits_whatever_the_partitions(spark, sf_dir):
    orders = fx.fx_orders(spark, sf_dir).withColumn("gfv_local", F.expr("gfv_local / 7D"))
    found = []
    for partitions in (1, 7, 64):
        rows = zo.prepare_orders(orders.orderBy(F.rand(partitions)).repartition(partitions), fx.GROUPS)
        facts = sl.granule_facts(rows, fx.GRID, ["gfv_local", "actual_DT"])
        moments = we.order_level_moments(facts, fx.GRID, ["gfv_local", "actual_DT"])
        design = sl.design_sums(rows, sl.Allocation(window_hours=3, num_variants=3, key=1, salt="s"))
        found.append((sorted(map(str, moments.collect())), sorted(map(str, design.collect()))))
    assert found[0] == found[1] == found[2]


def test_empty_groups_have_no_moments(spark):
    got = we.moments(frame(spark, [("a", 1, None, 2.5), ("a", 1, None, None)], 2), ["g"], ["x", "y"]).collect()
    assert sorted((r.kpi, r.n, r.mean, r.variance) for r in got) == [("x", 0, None, None), ("y", 1, 2.5, None)]
