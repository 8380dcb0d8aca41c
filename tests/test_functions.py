import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from high_precision import D, f_tail
from slotwise.functions import geo
from slotwise.functions.fdist import f_survival
from slotwise.operators.warehouse import points_in_zones
from slotwise.functions.scalars import (
    day_number, epoch_seconds, from_epoch_seconds, half_even, iso_timestamp, kpi_family, significance, utc_date, week_label,
    weekday_name,
)


def column(spark, values, expr, kind=pa.float64()):
    df = spark.createDataFrame(pa.table({"i": range(len(values)), "x": pa.array(values, kind)}))
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_half_even_is_numpys_rounding(spark):
    values = [0.125, 2.675, 0.135, 1.005, 0.375, -0.125, 2.5, None]
    got = column(spark, values, F.expr(half_even("x", 2)))
    assert got == [None if v is None else float(np.round(v, 2)) for v in values]


def test_labels(spark):
    assert column(spark, [0.1, 0.1001, math.nan, None], significance(F.col("x"), 0.1)) == [
        "significant", "insignificant", "insignificant", "insignificant"]
    names = ["actual_DT", "order_count", "gfv_local"]
    assert column(spark, names, kpi_family(F.col("x")), pa.string()) == ["Log KPI", "Biz KPI", "Biz KPI"]


def test_weeks_and_iso(spark):
    first = dt.date(2023, 1, 1)
    days = [0, 6, 7, 13, 14, 20, 21, 27, 28, -1]
    got = column(spark, [first + dt.timedelta(days=d) for d in days], week_label(F.col("x"), F.lit(first)), pa.date32())
    assert got == ["week_1", "week_1", "week_2", "week_2", "week_3", "week_3", "week_4", "week_4", "0", "0"]
    ts = dt.datetime(2023, 1, 1, 0, 48, 4, 999999)
    assert column(spark, [ts], iso_timestamp(F.col("x")), pa.timestamp("us")) == ["2023-01-01T00:48:04Z"]


def survival(spark, cases):
    df = spark.createDataFrame(pa.table({
        "i": range(len(cases)), **{n: pa.array([c[j] for c in cases], pa.float64()) for j, n in enumerate(("f", "a", "b"))}}))
    return [r[0] for r in df.orderBy("i").select(f_survival("f", "a", "b")).collect()]


def test_f_survival_closed_forms(spark):
    cases, want = [], []
    for f in (1e-6, 0.2, 0.9, 1.0, 1.7, 4.0, 25.0, 400.0):
        for d in (1.5, 3.0, 10.0, 333.3, 1e5):
            cases.append((f, 2.0, d))  # two degrees above: a plain power
            want.append((1 + 2 * f / d) ** (-d / 2))
            cases.append((f, d, 2.0))
            want.append(1 - (d * f / (2 + d * f)) ** (d / 2))
        cases.append((f, 1.0, 1.0))
        want.append(1 - 2 / math.pi * math.atan(math.sqrt(f)))
        cases.append((f, 4.0, 1e7))  # close to a chi-square with 4 degrees
        want.append(math.exp(-2 * f) * (1 + 2 * f))
    for got, expected, case in zip(survival(spark, cases), want, cases):
        assert got == pytest.approx(expected, abs=2e-6 if case[2] == 1e7 else 1e-9), case


def test_f_survival_has_ten_digits_for_any_degrees(spark):
    degrees = (1.0, 1.5, 2.0, 3.7, 10.0, 100.0, 1e4, 1e6, 1e9, 1e12)
    cases = [(f, d1, d2) for d1 in (1.0, 2.0, 3.0, 6.0, 20.0, 101.0, 1e4) for d2 in degrees
             for f in (1e-6, 0.01, 0.2, 0.9, 0.999, 1.0, 1.001, 1.1, 1.7, 4.0, 25.0)]
    checked = 0
    for case, got in zip(cases, survival(spark, cases)):
        want = f_tail(*case)
        if want > D("1e-30"):
            assert abs(D(got) / want - 1) < D("1e-10"), case
            checked += 1
    assert checked > 600


def test_f_survival_limits(spark):
    got = survival(spark, [(0.0, 3.0, 5.0), (None, 3.0, 5.0), (2.0, None, 5.0), (1e9, 3.0, 50.0)])
    assert got[:3] == [1.0, None, None]
    assert 0 <= got[3] < 1e-100


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def contained(spark, rings, points):
    shape_type = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
    shape = [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in rings]
    keys = {"entity_id": ["e"], "country_code": ["c"], "zone_id": pa.array([1], pa.int64())}
    zones = spark.createDataFrame(pa.table({**keys, "zone_shape": pa.array([shape], shape_type)}))
    df = spark.createDataFrame(pa.table({
        "entity_id": ["e"] * len(points), "country_code": ["c"] * len(points),
        "zone_id": pa.array([1] * len(points), pa.int64()), "order_id": range(len(points)),
        "x": pa.array([p[0] for p in points], pa.float64()), "y": pa.array([p[1] for p in points], pa.float64())}))
    df = df.withColumn("point", geo.geo_point(F.col("x"), F.col("y")))
    inside = {r[0] for r in points_in_zones(df, zones, "point").select("order_id").collect()}
    return [i in inside for i in range(len(points))]


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
HOLE = [(1, 1), (3, 1), (3, 3), (1, 3)]


@pytest.mark.parametrize("rings", [[SQUARE], [SQUARE + SQUARE[:1]], [SQUARE, HOLE], [[(0, 0), (4, 0), (0, 4), (4, 4)]]])
def test_point_in_zone_grid(spark, rings):
    points = [(x / 2, y / 2) for x in range(-1, 10) for y in range(-1, 10)]
    got = contained(spark, rings, points)
    assert got == [even_odd(rings, x, y) for x, y in points]


def test_point_in_zone_many_corners(spark):
    rng = np.random.default_rng(5)
    angles = np.sort(rng.uniform(0, 2 * math.pi, 300))
    radius = rng.uniform(0.3, 1.0, 300)
    star = [(float(r * math.cos(a)), float(r * math.sin(a))) for r, a in zip(radius, angles)]
    points = [(float(x), float(y)) for x, y in rng.uniform(-1, 1, (400, 2))] + star[:50]
    got = contained(spark, [star], points)
    assert got == [even_odd([star], x, y) for x, y in points]
    assert True in got and got[400:] == [False] * 50


def test_point_in_zone_missing_point(spark):
    assert contained(spark, [SQUARE], [(None, 1.0), (1.0, None), (1.0, 1.0)]) == [False, False, True]


def test_flat_shape_holds_nothing(spark):
    assert contained(spark, [[(0, 1), (4, 1)]], [(1.0, 1.0), (5.0, 1.0)]) == [False, False]


def test_times_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "Asia/Singapore", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session)
            for sql in ("TIMESTAMP'2023-01-01 00:48:04.5Z'", "TIMESTAMP_NTZ'2023-01-01 00:48:04.5'"):
                ts = F.expr(sql)
                got = spark.range(1).select(
                    iso_timestamp(ts), epoch_seconds(ts), utc_date(ts).cast("string"), weekday_name(ts),
                    day_number(ts, F.expr("DATE'2022-12-31'")), from_epoch_seconds(epoch_seconds(ts)).cast("string")).first()
                assert tuple(got) == (
                    "2023-01-01T00:48:04Z", 1672534084, "2023-01-01", "Sunday", 2, "2023-01-01 00:48:04")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
