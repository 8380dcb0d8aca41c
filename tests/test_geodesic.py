"""Containment on the sphere against winding numbers, which know no meridians."""

import math
import random

import pytest
from pyspark.sql import functions as F

from slotwise.functions.geo import zone_contains, zone_index
from slotwise.operators import geodesic as gd
from slotwise.operators import joins

SHAPE = "array<array<struct<lon:double,lat:double>>>"


def unit(lon, lat):
    lon, lat = math.radians(lon), math.radians(lat)
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def winds_around(ring, lon, lat):
    """Directions from the point to the corners turn once around."""
    x, y, z = unit(lon, lat)
    east = (-math.sin(math.radians(lon)), math.cos(math.radians(lon)), 0.0)
    north = (y * east[2] - z * east[1], z * east[0] - x * east[2], x * east[1] - y * east[0])
    angles = []
    for p in ring:
        v = unit(*p)
        angles.append(math.atan2(sum(a * b for a, b in zip(v, east)), sum(a * b for a, b in zip(v, north))))
    turn = sum((b - a + math.pi) % (2 * math.pi) - math.pi for a, b in zip(angles, angles[1:] + angles[:1]))
    return abs(turn) > math.pi and sum(a * b for a, b in zip((x, y, z), map(sum, zip(*[unit(*p) for p in ring])))) > 0


def contained(rings, lon, lat):
    return sum(winds_around(r, lon, lat) for r in rings) % 2 == 1


def box(west, south, east, north):
    return [(west, south), (east, south), (east, north), (west, north)]


ZONES = {
    "long edges": [box(-40, 20, 40, 60)],
    "date line": [box(160, -30, -150, 25)],
    "date line, closed ring, turned": [[*reversed(box(175, 40, -170, 55)), (-170, 55)]],
    "north pole": [[(-170, 70), (-50, 60), (70, 75), (130, 65)]],
    "south pole with a hole": [[(0, -50), (120, -60), (-120, -55)], [(0, -80), (90, -78), (180, -82), (-90, -79)]],
    "hole": [box(0, -20, 50, 20), box(10, -10, 30, 10)],
    "two parts": [box(60, 0, 80, 10), box(-80, 0, -60, 10)],
    "small": [box(100.001, 30.002, 100.003, 30.004)],
    "tall": [box(-100, -85, -99, 85)],
    "triangle": [[(-30, -40), (35, -45), (5, -5)]],
}


def frames(spark, points, zones=ZONES):
    rows = [(name, [[{"lon": float(x), "lat": float(y)} for x, y in r] for r in rings]) for name, rings in zones.items()]
    return (spark.createDataFrame(points, "i int, lon double, lat double").repartition(4),
            spark.createDataFrame(rows, f"zone string, shape {SHAPE}"))


def found(spark, points, zones=ZONES):
    got = gd.zones_of_points(*frames(spark, points, zones), "lon", "lat", "shape")
    assert got.columns == ["i", "lon", "lat", "zone"]
    return sorted((r.i, r.zone) for r in got.collect())


def some_points(seed, n=1500):
    rnd = random.Random(seed)
    points = [(i, rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1)))) for i in range(n)]
    points += [(n + i, rnd.uniform(100, 100.004), rnd.uniform(30.001, 30.005)) for i in range(100)]
    points += [(n + 100 + i, rnd.uniform(-180, 180), s * rnd.uniform(60, 90)) for i in range(150) for s in (1, -1)]
    return points


@pytest.mark.parametrize("shares", [3, 1000])
def test_points_find_their_zones(spark, monkeypatch, shares):
    monkeypatch.setattr(joins, "SHARES", shares)
    points = some_points(shares)
    want = sorted((i, name) for i, lon, lat in points for name, rings in ZONES.items() if contained(rings, lon, lat))
    assert {name for _, name in want} == set(ZONES)
    assert found(spark, points) == want
    # The same places one turn further east or west.
    assert found(spark, [(i, lon + 360 * (i % 3 - 1), lat) for i, lon, lat in points]) == want


def test_long_edges_bulge_where_planar_ones_do_not(spark):
    north, south = [(1, 0.0, 64.0)], [(2, 0.0, 21.0)]
    assert found(spark, north + south, {"long edges": ZONES["long edges"]}) == [(1, "long edges")]
    points, zones = frames(spark, north + south)
    planar = points.crossJoin(zones.where("zone = 'long edges'").withColumn("z", zone_index("shape"))).where(
        zone_contains("z", "lon", "lat"))
    assert [r.i for r in planar.collect()] == [2]


def test_edges_and_corners_are_outside(spark):
    square = {"square": [box(-10, 0, 10, 20)]}
    points = [(1, 0.0, 0.0), (2, -10.0, 0.0), (3, 10.0, 5.0), (4, -10.0, 7.0), (5, 10.0, 20.0), (6, 0.0, 1e-9), (7, 0.0, -1e-9)]
    assert found(spark, points, square) == [(6, "square")]


def test_awkward_rows(spark):
    points = [(1, None, 1.0), (2, 1.0, None), (3, float("nan"), 1.0), (4, 1.0, 95.0), (5, 5.0, 5.0), (5, 5.0, 5.0), (6, 0.0, 90.0)]
    points_df, zones = frames(spark, points, {"a": [box(0, 0, 10, 10)], "b": [], "c": [[]], "d": [[(1, 1)]], "e": [box(0, 0, 10, 10)]})
    zones = zones.unionByName(spark.createDataFrame([("none", None)], zones.schema))
    got = gd.zones_of_points(points_df, zones, "lon", "lat", "shape")
    assert sorted((r.i, r.zone) for r in got.collect()) == [(5, "a"), (5, "a"), (5, "e"), (5, "e")]
    assert gd.zones_of_points(points_df, zones.limit(0), "lon", "lat", "shape").count() == 0
    assert gd.zones_of_points(points_df.limit(0), zones, "lon", "lat", "shape").count() == 0
    with pytest.raises(ValueError):
        gd.zones_of_points(points_df, zones.withColumnRenamed("zone", "I"), "lon", "lat", "shape")


def test_a_zone_has_few_cells(spark):
    _, zones = frames(spark, [])
    cover = gd.zone_cover(zones, "shape").groupBy("zone").agg(F.count("*").alias("cells"), F.max("__level").alias("level"))
    cells = {r.zone: (r.cells, r.level) for r in cover.collect()}
    assert all(n <= 30 for n, _ in cells.values()) and cells["small"][1] >= 18 and cells["long edges"][1] <= 4


def test_squares_away_from_edges_need_no_test(spark, monkeypatch):
    rnd = random.Random(5)
    stars = {f"star {i}": [[(c + rnd.uniform(-w, w), rnd.uniform(-w, w) / 2 + s) for _ in range(n)]] for i, (c, s, w, n) in enumerate(
        [(0, 0, 40, 7), (175, 60, 20, 9), (-60, -70, 1, 12), (20, 10, 0.001, 5), (90, 72, 30, 6)])}
    zones = ZONES | stars
    points = some_points(11) + [(9000 + i, c + rnd.uniform(-1, 1) * w, s + rnd.uniform(-1, 1) * w / 2) for c, s, w in [
        (0, 0, 40), (175, 60, 20), (-60, -70, 1), (20, 10, 0.001), (90, 72, 30)] for i in range(200)]
    fast = found(spark, points, zones)
    bits = gd.zone_cover(frames(spark, [], zones)[1], "shape").selectExpr(
        "bit_count(__rim) AS rim", "bit_count(__inside) AS inside", "bit_count(__rim & __inside) AS both").agg(
        F.sum("rim").alias("rim"), F.sum("inside").alias("inside"), F.sum("both").alias("both")).first()
    assert bits.both == 0 and bits.rim < bits.inside
    # Every square taken as near an edge: all points are tested.
    monkeypatch.setattr(gd, "_masks", lambda: "struct(-1L AS rim, 0L AS odd)")
    assert found(spark, points, zones) == fast


def test_the_cover_is_planned_without_copies_of_its_expressions(spark):
    plan = gd.zone_cover(frames(spark, [])[1], "shape")._jdf.queryExecution().executedPlan().toString()
    assert max(map(len, plan.splitlines())) < 20_000
