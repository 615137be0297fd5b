"""Geometry on plain columns: segments, rings, edge arrays.

A ring is ARRAY<STRUCT<x,y>> (closed). A shape is given by its edge array
ARRAY<STRUCT<x1,y1,x2,y2>> over all rings; inside is even-odd, so holes and
multi-part shapes need no special case.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracast.functions.numbers import col


def point_array(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def ring_edges(ring) -> Column:
    """Edges between consecutive ring points."""
    ring = col(ring)
    a = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    b = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(a, b, lambda p, q: F.struct(p.x.alias("x1"), p.y.alias("y1"), q.x.alias("x2"), q.y.alias("y2")))


def shape_edges(polygons) -> Column:
    """Edges of ARRAY<polygon ARRAY<ring ARRAY<point ARRAY<DOUBLE>>>>."""
    rings = F.flatten(col(polygons))
    as_points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.flatten(F.transform(rings, lambda ring: ring_edges(as_points(ring))))


def box_of(edges) -> dict[str, Column]:
    e = col(edges)
    side = lambda fn, k: fn(F.array_union(F.transform(e, lambda s: s[f"{k}1"]), F.transform(e, lambda s: s[f"{k}2"])))
    return {"x1": side(F.array_min, "x"), "y1": side(F.array_min, "y"), "x2": side(F.array_max, "x"), "y2": side(F.array_max, "y")}


def inside(px, py, edges) -> Column:
    """Even-odd ray cast to the right."""
    px, py = col(px), col(py)
    crosses = lambda s: ((s.y1 > py) != (s.y2 > py)) & (px < (s.x2 - s.x1) * (py - s.y1) / F.nullif(s.y2 - s.y1, F.lit(0.0)) + s.x1)
    return F.size(F.filter(col(edges), crosses)) % 2 == 1


def on_edge(px, py, edges) -> Column:
    px, py = col(px), col(py)
    hit = lambda s: (
        ((s.x2 - s.x1) * (py - s.y1) - (s.y2 - s.y1) * (px - s.x1) == 0.0)
        & px.between(F.least(s.x1, s.x2), F.greatest(s.x1, s.x2))
        & py.between(F.least(s.y1, s.y2), F.greatest(s.y1, s.y2))
    )
    return F.exists(col(edges), hit)


def path_crossings(px, py, corner_x, corner_y, edges) -> Column:
    """Edges crossed on the way from a point right to x = corner_x and from there down to the corner.

    Both ways stay in the tile whose lower right corner it is, so the edges that touch the tile are enough: with the
    corner's own parity this is the even-odd test of `inside` without the rest of the ring.
    """
    px, py, cx, cy = (col(k) for k in (px, py, corner_x, corner_y))
    meet = lambda a, b, c, d, t: (d - b) * (t - a) / F.nullif(c - a, F.lit(0.0)) + b

    def right(s):
        x = meet(s.y1, s.x1, s.y2, s.x2, py)
        return ((s.y1 > py) != (s.y2 > py)) & (px < x) & (x <= cx)

    def down(s):
        y = meet(s.x1, s.y1, s.x2, s.y2, cx)
        return ((s.x1 > cx) != (s.x2 > cx)) & (cy < y) & (y <= py)

    e = col(edges)
    return F.size(F.filter(e, right)) + F.size(F.filter(e, down))


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a segment."""
    px, py, x1, y1, x2, y2 = (col(k) for k in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def signed_area(edges) -> Column:
    """Twice the signed area."""
    return F.aggregate(col(edges), F.lit(0.0), lambda acc, s: acc + (s.x1 * s.y2 - s.x2 * s.y1))


def area_centroid(edges) -> Column:
    """Centroid of the enclosed area as STRUCT<x,y>."""
    e = col(edges)
    cross = lambda s: s.x1 * s.y2 - s.x2 * s.y1
    sx = F.aggregate(e, F.lit(0.0), lambda acc, s: acc + (s.x1 + s.x2) * cross(s))
    sy = F.aggregate(e, F.lit(0.0), lambda acc, s: acc + (s.y1 + s.y2) * cross(s))
    area3 = F.nullif(signed_area(e) * 3.0, F.lit(0.0))
    return F.struct((sx / area3).alias("x"), (sy / area3).alias("y"))


def vertex_mean(edges) -> Column:
    """Mean of the ring's listed points; the closing point counts twice, as a ring lists it twice."""
    e = col(edges)
    n = F.size(e) + 1
    tot = lambda k: F.aggregate(e, F.lit(0.0), lambda acc, s: acc + s[f"{k}1"]) + F.element_at(e, -1)[f"{k}2"]
    return F.struct((tot("x") / n).alias("x"), (tot("y") / n).alias("y"))
