"""The chi-square tail and the balance test built on it."""

import math

import pyarrow as pa
import pytest

from helpers import GROUPS, order, orders
from high_precision import D, chi2_tail
from slotwise.config import Allocation
from slotwise.functions.chi2 import chi2_survival
from slotwise.operators import allocation as al
from slotwise.operators import zones as zo


def tails(spark, cases):
    df = spark.createDataFrame(pa.table({
        "i": range(len(cases)), "x": pa.array([c[0] for c in cases], pa.float64()), "k": pa.array([c[1] for c in cases], pa.float64())}))
    return [r[0] for r in df.orderBy("i").select(chi2_survival("x", "k")).collect()]


def test_tail_has_ten_digits(spark):
    cases = [(k * f, k) for k in (1.0, 2.0, 2.5, 3.0, 6.0, 50.0, 999.0, 1e4)
             for f in (1e-8, 1e-3, 0.3, 0.9, 0.99, 1.0, 1.01, 1.1, 1.5, 3.0, 10.0, 40.0)]
    checked = 0
    for (x, k), got in zip(cases, tails(spark, cases)):
        want = chi2_tail(x, k)
        if want > D("1e-30"):
            assert abs(D(got) / want - 1) < D("1e-10"), (x, k)
            checked += 1
    assert checked > 70


def test_tail_limits(spark):
    assert tails(spark, [(0.0, 3.0), (-1.0, 3.0), (None, 3.0), (2.0, None), (2.0, 0.0)]) == [1.0, 1.0, None, None, None]
    assert tails(spark, [(1e9, 3.0)])[0] == 0.0


def balance(spark, rows):
    return spark.createDataFrame(rows, "zone_group_identifier string, variant long, orders long, slots long")


def test_shares(spark):
    got = {r.zone_group_identifier: r for r in al.balance_test(balance(spark, [
        ("even", 1, 100, 10), ("even", 2, 100, 10), ("even", 3, 100, 10),
        ("lost", 1, 100, 10), ("lost", 2, 100, 20),
        ("lost", None, 7, 0)]), 3).collect()}
    assert (got["even"].slots_chi2, got["even"].slots_p, got["even"].orders_p) == (0.0, 1.0, 1.0)
    # A variant without slots counts as zero: 10, 20 and 0 of 30.
    assert got["lost"].slots_chi2 == 20.0 and got["lost"].slots_p == round(math.exp(-10), 4)
    assert got["lost"].orders == 200 and got["lost"].orders_chi2 == 100.0


def test_one_variant_has_no_p_value(spark):
    r = al.balance_test(balance(spark, [("g", 1, 5, 5)]), 1).first()
    assert (r.slots_chi2, r.slots_p, r.orders_p) == (0.0, None, None)
    assert al.balance_test(balance(spark, []), 3).count() == 0


@pytest.mark.parametrize("variants", [2, 4])
def test_hashed_allocations_are_balanced(spark, variants):
    rows = [order(f"o{i}", 31 * i, zone="ab"[i % 2], zone_id=i % 2) for i in range(1500)]
    prepared = zo.prepare_orders(orders(spark, rows), GROUPS)
    p = [al.balance_test(al.variant_balance(al.allocate(prepared, Allocation(1, variants, key, "s"))), variants).first().slots_p
         for key in range(6)]
    assert sum(v > 0.05 for v in p) >= 4 and min(p) > 1e-4
