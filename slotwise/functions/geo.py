"""Planar point-in-zone test.

A zone shape is ARRAY<ARRAY<STRUCT<lon, lat>>>: a list of rings (outer rings and holes
alike, open or closed). A point lies inside when its ray crosses an odd number of edges
and it is on no edge. Edges are kept by latitude band, so that a point meets only
the few edges near its latitude.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def geo_point(lon: Column, lat: Column) -> Column:
    """Longitude first; NULL if a coordinate is missing."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def _let(name: str, value: str, body: str) -> str:
    """Compute `value` once per row and use it under a name (a one-element transform)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _band(lat: str, box: str, bands: str) -> str:
    """Number of the latitude band; never falls as the latitude rises, so rounding cannot skip an edge."""
    return (
        f"CAST(coalesce(least(floor(try_divide({lat} - {box}.min_lat, ({box}.max_lat - {box}.min_lat) / {bands})), "
        f"CAST({bands} - 1 AS BIGINT)), 0L) AS INT)")


def zone_index(shape: str) -> Column:
    """Box and banded edges of a shape column: STRUCT<box, bands>. An edge is in every band that it touches.

    There are as many bands as the root of the number of edges, so a point meets about that many.
    """
    edges = (
        f"flatten(transform({shape}, ring -> transform(ring, (p, i) -> struct(p.lon AS x1, p.lat AS y1, "
        "get(ring, (i + 1) % size(ring)).lon AS x2, get(ring, (i + 1) % size(ring)).lat AS y2))))")
    box = (
        "struct(array_min(transform(e.edges, k -> k.x1)) AS min_lon, array_max(transform(e.edges, k -> k.x1)) AS max_lon, "
        "array_min(transform(e.edges, k -> k.y1)) AS min_lat, array_max(transform(e.edges, k -> k.y1)) AS max_lat)")
    bands = "greatest(CAST(floor(sqrt(size(e.edges))) AS BIGINT), 1L)"
    ranged = (
        f"transform(z.edges, k -> struct(k AS edge, {_band('least(k.y1, k.y2)', 'z.box', 'z.n')} AS low, "
        f"{_band('greatest(k.y1, k.y2)', 'z.box', 'z.n')} AS high))")
    banded = (
        "transform(sequence(0, CAST(z.n AS INT) - 1), "
        "b -> transform(filter(r.edges, q -> q.low <= b AND b <= q.high), q -> q.edge))")
    index = _let("r", f"struct({ranged} AS edges)", f"struct(z.box AS box, {banded} AS bands)")
    boxed = _let("z", f"struct(e.edges AS edges, {box} AS box, {bands} AS n)", index)
    return F.expr(_let("e", f"struct({edges} AS edges)", boxed))


def zone_contains(index: str, lon: str, lat: str) -> Column:
    """Point-in-zone: box test first, then only the edges of the point's latitude band."""
    box = f"{index}.box"
    in_box = f"{lon} BETWEEN {box}.min_lon AND {box}.max_lon AND {lat} BETWEEN {box}.min_lat AND {box}.max_lat"
    edges = f"get({index}.bands, {_band(lat, box, f'size({index}.bands)')})"
    on_edge = (
        f"{lat} BETWEEN least(k.y1, k.y2) AND greatest(k.y1, k.y2) AND {lon} BETWEEN least(k.x1, k.x2) AND greatest(k.x1, k.x2) "
        f"AND (k.x2 - k.x1) * ({lat} - k.y1) - (k.y2 - k.y1) * ({lon} - k.x1) = 0")
    crossed = (
        f"(k.y1 > {lat}) != (k.y2 > {lat}) "
        f"AND {lon} < try_divide((k.x2 - k.x1) * ({lat} - k.y1), k.y2 - k.y1) + k.x1")
    # Parity of the crossings so far; -1 for good once the point lies on an edge.
    parity = (
        f"aggregate({edges}, 0, (acc, k) -> CASE WHEN acc < 0 OR ({on_edge}) THEN -1 "
        f"WHEN {crossed} THEN 1 - acc ELSE acc END)")
    return F.expr(f"({in_box}) AND {parity} = 1")
