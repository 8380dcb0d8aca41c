"""Which zones contain a point, on the sphere and without knowing a zone's name.

Edges are great-circle arcs, as a warehouse's geography type has them; longitudes may cross the date line, a zone
may hold a pole. An edge runs eastward from (lon, lat) over `d` degrees, with the unit normal n of its plane pointing
north. Going north from a point, an edge is crossed if the point's meridian meets it and the point lies south of its
plane, n . p < 0. The number of crossings tells inside from outside; a point on an edge is outside.

Every zone is covered by a few cells of a grid whose width is a power of two fitting its size. A cell holds
the edges of its column only. A point has one cell per level that occurs, so points meet zones by an
equi-join, hot cells salted.

A cell is ruled into 8 by 8 squares. No edge comes near most of them, so they lie inside or outside as a whole; two masks of
64 bits tell these, and only points in the other squares, along the zone's rim, are tested against edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.operators.joins import salted_join
from slotwise.sources.staging import stage

#: Cells along the longer side of a zone's box are about this many at most; the narrowest cells are 360 / 2^24 degrees.
CELLS_PER_SIDE, FINEST = 4, 24
#: Squares along a cell's side: their square is the number of bits of a mask.
RULED = 8
# An edge this near, in degrees, counts as in the square: far more than rounding can shift it.
_NEAR = "1e-6D"
_OWN = ("__level", "__column", "__row", "__edges", "__pole", "__inside", "__rim", "__square", "__lon", "__lat")


def _let(name: str, value: str, body: str) -> str:
    """Compute `value` once per row and use it under a name (a one-element transform)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def wrapped(degrees: str) -> str:
    """The same angle from -180 up to but not 180."""
    return f"(({degrees}) - 360D * floor((({degrees}) + 180D) / 360D))"


def _edges(shape: str) -> str:
    """Edges of all rings that have a length, eastward: lon, lat, lat2, d, normal."""
    ends = (
        f"flatten(transform({shape}, ring -> transform(ring, (p, i) -> struct(CAST(p.lon AS DOUBLE) AS x1, CAST(p.lat AS DOUBLE) AS y1, "
        "CAST(get(ring, (i + 1) % size(ring)).lon AS DOUBLE) AS x2, CAST(get(ring, (i + 1) % size(ring)).lat AS DOUBLE) AS y2))))")
    east = (
        f"transform({ends}, e -> {_let('d', wrapped('e.x2 - e.x1'), 'IF(d >= 0, struct(e.x1 AS lon, e.y1 AS lat, e.x2 AS lon2, e.y2 AS lat2, d AS d), struct(e.x2 AS lon, e.y2 AS lat, e.x1 AS lon2, e.y1 AS lat2, -d AS d))')})")
    a = ("cos(radians(k.lat)) * cos(radians(k.lon))", "cos(radians(k.lat)) * sin(radians(k.lon))", "sin(radians(k.lat))")
    b = ("cos(radians(k.lat2)) * cos(radians(k.lon2))", "cos(radians(k.lat2)) * sin(radians(k.lon2))", "sin(radians(k.lat2))")
    crossed = (f"({a[1]}) * ({b[2]}) - ({a[2]}) * ({b[1]})", f"({a[2]}) * ({b[0]}) - ({a[0]}) * ({b[2]})",
               f"({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]})")
    return (
        f"transform(filter({east}, k -> k.d > 0 OR k.lat != k.lat2), k -> struct(k.lon AS lon, k.lat AS lat, k.lat2 AS lat2, k.d AS d, "
        f"{crossed[0]} AS nx, {crossed[1]} AS ny, {crossed[2]} AS nz))")


def _latitudes(e: str) -> str:
    """Lowest and highest latitude of an edge: its ends or, where the arc holds it, the turning point of its circle."""
    size = f"sqrt({e}.nx * {e}.nx + {e}.ny * {e}.ny)"
    turn = f"degrees(atan2({size}, {e}.nz))"
    at = f"degrees(atan2(-{e}.ny, -{e}.nx))"
    over = f"{e}.d > 0 AND {wrapped(f'{at} - {e}.lon')} BETWEEN 0 AND {e}.d"
    under = f"{e}.d > 0 AND {wrapped(f'{at} + 180D - {e}.lon')} BETWEEN 0 AND {e}.d"
    return (f"struct(IF({under}, -{turn}, least({e}.lat, {e}.lat2)) AS low, "
            f"IF({over}, {turn}, greatest({e}.lat, {e}.lat2)) AS high)")


def _winds(ring: str) -> str:
    """Whether a ring goes around a pole: its steps in longitude add up to a full turn."""
    step = wrapped(f"get({ring}, (i + 1) % size({ring})).lon - p.lon")
    return f"abs(aggregate(transform({ring}, (p, i) -> {step}), 0D, (s, x) -> s + x)) > 180D"


def _poles(shape: str, sign: str) -> str:
    """Number of rings around the pole on one side: the one that more of the ring's height lies on."""
    height = "aggregate(ring, 0D, (s, p) -> s + sin(radians(p.lat)))"
    return f"size(filter({shape}, ring -> size(ring) > 0 AND {_winds('ring')} AND {height} {sign} 0))"


def _strips() -> str:
    """Per strip of a column, from east to west: the edges that come near it, with the lowest and highest row of squares
    that they come near there and whether they cross the strip's middle."""
    width = f"(360D / __count / {RULED})"
    west = f"((__column * {RULED} + k) * {width} - 180D)"

    def latitude(u: str) -> str:
        at = f"radians(e.lon + {u})"
        return f"degrees(atan(-(e.nx * cos({at}) + e.ny * sin({at})) / e.nz))"

    def turns(u: str) -> str:
        return f"{wrapped(u)} BETWEEN t.u1 AND t.u2"

    # Short, steep and polar edges stand for their whole range, edges with an unknown end for any.
    whole = f"e.d < {width} OR abs(e.lat) > 89.9D OR abs(e.lat2) > 89.9D"
    top = "degrees(atan2(-e.ny, -e.nx)) - e.lon"
    part = (f"struct(IF({turns(f'{top} + 180D')}, r.low, least(t.l1, t.l2)) AS low, "
            f"IF({turns(top)}, r.high, greatest(t.l1, t.l2)) AS high)")
    ends = _let("u", f"struct(greatest(0D, w) AS u1, least(e.d, w + {width}) AS u2)", (
        f"struct(u.u1 AS u1, u.u2 AS u2, {latitude('u.u1')} AS l1, {latitude('u.u2')} AS l2)"))
    clipped = (f"CASE WHEN e.nz IS NULL OR isnan(e.nz) THEN struct(-90D AS low, 90D AS high) WHEN {whole} THEN r "
               f"ELSE {_let('t', ends, part)} END")
    middle = wrapped(f"{west} + {width} / 2D - e.lon")
    row = f"floor(({{0}} + 90D) / 360D * __count * {RULED})"
    one = _let("r", _latitudes("e"), _let("c", clipped, (
        f"struct({row.format(f'c.low - {_NEAR}')} AS low, {row.format(f'c.high + {_NEAR}')} AS high, "
        f"{middle} >= 0D AND {middle} < e.d AS over)")))
    near = f"coalesce(w <= e.d + {_NEAR} AND w + {width} >= -{_NEAR}, true)"
    met = f"filter(transform(__edges, e -> {_let('w', wrapped(f'{west} - e.lon'), f'IF({near}, {one}, NULL)')}), x -> x IS NOT NULL)"
    return f"transform(sequence({RULED - 1}, 0), k -> {met})"


def _masks() -> str:
    """Two masks of a cell's squares, strips from west to east and each from south to north: __rim, near an edge, and
    __odd, an odd number of edges further north."""
    def below(row: str) -> str:
        return f"shiftleft(1L, CAST(least(greatest({row} - __row * {RULED}, 0L), {RULED}L) AS INT))"

    strip = (f"aggregate(strip, struct(0L AS rim, IF(__pole, {2 ** RULED - 1}L, 0L) AS odd), (s, x) -> struct("
             f"s.rim | ({below('x.high + 1')} - {below('x.low')}) AS rim, IF(x.over, s.odd ^ ({below('x.low')} - 1L), s.odd) AS odd))")
    return (f"aggregate(transform(__strips, strip -> {strip}), struct(0L AS rim, 0L AS odd), (m, s) -> struct("
            f"shiftleft(m.rim, {RULED}) | s.rim AS rim, shiftleft(m.odd, {RULED}) | s.odd AS odd))")


def zone_cover(zones: DataFrame, shape: str) -> DataFrame:
    """The zones' columns but the shape, a row per cell: __level, __column, __row, __pole (north pole inside), __edges,
    and masks of the cell's squares: __inside, and __rim near an edge.

    A missing or empty shape, or one without any edge, has no cell.
    """
    kept = [c for c in zones.columns if c != shape]
    # A small file of zones is read by a task or two, and covering them is the work, so they are spread. Staged, since
    # later filters on the edges would else move into the scan, each with a copy of all expressions above.
    spread = zones.where(f"size({shape}) > 0").repartition(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edged = stage(spread.select(
        *kept, F.expr(_edges(shape)).alias("__edges"), F.expr(f"{_poles(shape, '>')} % 2 = 1").alias("__pole"),
        F.expr(f"{_poles(shape, '>')} > 0").alias("__north"), F.expr(f"{_poles(shape, '<=')} > 0").alias("__south")), "zone-edges")
    # Longitudes from the first edge's start; an edge over the far side means that the zone may be anywhere.
    first = "get(__edges, 0).lon"
    start = wrapped(f"e.lon - {first}")
    boxed = edged.where("size(__edges) > 0").withColumn("__ends", F.expr(f"transform(__edges, e -> {_latitudes('e')})")).select(
        *kept, "__edges", "__pole",
        F.expr("IF(__south, -90D, array_min(transform(__ends, e -> e.low)))").alias("__low"),
        F.expr("IF(__north, 90D, array_max(transform(__ends, e -> e.high)))").alias("__high"),
        F.expr(f"array_min(transform(__edges, e -> {start}))").alias("__west"),
        F.expr(f"array_max(transform(__edges, e -> {start} + e.d))").alias("__east"), F.expr(first).alias("__first"))
    boxed = boxed.withColumn("__around", F.expr("__east >= 180D"))
    boxed = boxed.withColumn("__span", F.expr("greatest(IF(__around, 360D, __east - __west), __high - __low, 1e-9D)"))
    level = f"CAST(greatest(0, least({FINEST}, floor(log2(360D * {CELLS_PER_SIDE} / __span)))) AS INT)"
    sized = boxed.withColumn("__level", F.expr(level)).withColumn("__count", F.expr("shiftleft(1L, __level)"))
    # A little wider than the box, so that rounding cannot lose a point at its rim.
    column = "floor((__first + {0} + 180D) / 360D * __count)"
    rows = "floor((least(greatest({0}, -90D), 90D) + 90D) / 360D * __count)"
    cells = sized.select(
        *kept, "__edges", "__pole", "__level", "__count",
        F.explode_outer(F.expr(
            f"IF(__around, sequence(0L, __count - 1), array_distinct(transform(sequence({column.format('__west - 1e-9D')}, "
            f"{column.format('__east + 1e-9D')}), c -> pmod(c, __count))))")).alias("__column"),
        F.expr(f"sequence({rows.format('__low - 1e-9D')}, {rows.format('__high + 1e-9D')})").alias("__rows"))
    # Edges that the cell's column can meet: those that start in it and those that reach into it from the west.
    width = "(360D / __count)"
    west = f"(__column * {width} - 180D)"
    touches = (f"{wrapped(f'e.lon - {west}')} BETWEEN -1e-9D AND {width} + 1e-9D "
               f"OR pmod({west} - e.lon, 360D) <= e.d + 1e-9D OR __count = 1")
    strips = cells.where("__column IS NOT NULL").withColumn("__edges", F.expr(f"filter(__edges, e -> {touches})")).withColumn(
        "__strips", F.expr(_strips()))
    ruled = strips.withColumn("__row", F.explode_outer("__rows")).withColumn("__masks", F.expr(_masks()))
    return ruled.withColumns({"__rim": F.expr("__masks.rim"), "__inside": F.expr("__masks.odd & ~__masks.rim")}).drop(
        "__rows", "__count", "__strips", "__masks")


def _inside() -> Column:
    """Whether the point (__lon, __lat) is in the zone whose column's edges are __edges."""
    p = ("cos(radians(__lat)) * cos(radians(__lon))", "cos(radians(__lat)) * sin(radians(__lon))", "sin(radians(__lat))")
    u = wrapped("__lon - e.lon")
    side = "e.nx * p.x + e.ny * p.y + e.nz * p.z"
    on_edge = ("(u = 0 AND (__lat = e.lat OR e.d = 0 AND __lat BETWEEN least(e.lat, e.lat2) AND greatest(e.lat, e.lat2))) "
               f"OR (u = e.d AND __lat = e.lat2) OR (0 <= u AND u <= e.d AND e.d > 0 AND {side} = 0)")
    step = f"CASE WHEN s < 0 OR u < 0 OR u > e.d THEN s WHEN {on_edge} THEN -1 WHEN u < e.d AND {side} < 0 THEN 1 - s ELSE s END"
    crossings = f"aggregate(__edges, IF(__pole, 1, 0), (s, e) -> {_let('u', u, step)})"
    tested = _let("p", f"struct({p[0]} AS x, {p[1]} AS y, {p[2]} AS z)", crossings) + " = 1"
    return F.expr(f"CASE WHEN __square IS NULL OR getbit(__rim, __square) = 1 THEN {tested} ELSE getbit(__inside, __square) = 1 END")


def zones_of_points(points: DataFrame, zones: DataFrame, lon: str, lat: str, shape: str) -> DataFrame:
    """Every point with each zone that contains it: the points' columns, then the zones' without the shape.

    `lon` and `lat` (degrees, any turn) are columns of the points, `shape` an ARRAY<ARRAY<STRUCT<lon, lat>>> column of the
    zones: rings, open or closed, holes as rings of their own, edges shorter than half a turn, smaller than a
    hemisphere. Points without a coordinate or beyond a pole are in no zone. Repeated points and zones each give rows.
    """
    names = [c for c in zones.columns if c != shape]
    taken = {c.lower() for c in points.columns}
    if clash := [c for c in (*names, *_OWN) if c.lower() in taken]:
        raise ValueError(f"both sides have the columns {clash}")
    cover = stage(zone_cover(zones, shape), "zone-cover")
    # At most FINEST + 1 levels.
    levels = sorted(r[0] for r in cover.select("__level").distinct().collect())
    placed = points.withColumn("__lon", F.expr(wrapped(f"CAST(`{lon}` AS DOUBLE)"))).withColumn(
        "__lat", F.expr(f"CAST(`{lat}` AS DOUBLE)")).where("__lon IS NOT NULL AND __lat BETWEEN -90D AND 90D")
    count = "shiftleft(1L, __level)"
    probes = placed.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn(
        "__column", F.expr(f"pmod(floor((__lon + 180D) / 360D * {count}), {count})")).withColumn(
        "__row", F.expr(f"floor((__lat + 90D) / 360D * {count})")).withColumn("__square", F.expr(
            f"CASE WHEN NOT isnan(__lon) THEN CAST(floor((__lon + 180D) / 360D * {count} * {RULED}) % {RULED} * {RULED} "
            f"+ floor((__lat + 90D) / 360D * {count} * {RULED}) % {RULED} AS INT) END"))
    met = salted_join(probes, cover, ["__level", "__column", "__row"])
    return met.where(_inside()).select(*points.columns, *names)
