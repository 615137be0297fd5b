"""Quad cover of polygons and the scaled nearest walk, each against brute force."""
import math
import random

import pytest
from pyspark.sql import functions as F

from terracast.functions.shapes import inside, on_edge
from terracast.operators import spatial

SHAPES = "i int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def ring(cx, cy, radius, n, wobble=0.0, seed=0):
    rnd = random.Random(seed)
    radii = [radius * (1 + wobble * rnd.uniform(-1, 1)) for _ in range(n)]
    pts = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(radii)]
    return [(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1])]


def box(x1, y1, x2, y2):
    pts = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    return [(*map(float, a), *map(float, b)) for a, b in zip(pts, pts[1:])]


def layer(spark, shapes):
    return spark.createDataFrame(list(enumerate(shapes)), SHAPES)


def brute(points, shapes):
    hit = points.join(shapes, inside("x", "y", "edges") | on_edge("x", "y", "edges"))
    return {(r.x, r.y): r.i for r in hit.groupBy("x", "y").agg(F.min("i").alias("i")).collect()}


def found(points, shapes):
    return {(r.x, r.y): r.i for r in spatial.point_in_polygon(points, shapes, "x", "y", "i", ["i"]).collect()}


def test_large_wobbly_polygon_with_a_hole_among_small_ones(spark):
    rnd = random.Random(5)
    large = ring(50, 50, 45, 3000, 0.05, 1) + ring(50, 50, 20, 400, 0.2, 2)
    small = [ring(rnd.uniform(0, 100), rnd.uniform(0, 100), 0.4, 6) for _ in range(200)]
    shapes = layer(spark, small + [large])
    pts = [(rnd.uniform(0, 100), rnd.uniform(0, 100)) for _ in range(3000)] + [(x1, y1) for x1, y1, *_ in large[::7] + small[3]]
    points = spark.createDataFrame(pts, "x double, y double")
    assert found(points, shapes) == brute(points, shapes)


def test_lattice_boxes_touch_the_first_shape(spark):
    shapes = layer(spark, [box(x, y, x + 2, y + 2) for x in range(0, 8, 2) for y in range(0, 8, 2)] + [box(0, 0, 8, 8), []])
    points = spark.createDataFrame([(x / 2, y / 2) for x in range(-1, 18) for y in range(-1, 18)], "x double, y double")
    want = brute(points, shapes)
    assert found(points, shapes) == want
    assert len(want) == 17 * 17


def test_cover_of_a_large_ring_has_short_tiles_and_bare_ones_inside(spark):
    large = ring(500_000, 1_200_000, 40_000, 20_000, 0.0)
    cover = spatial.quad_cover(layer(spark, [large, ring(500_000, 1_200_000, 3, 8)]), "i", ["i"], (459_000.0, 1_159_000.0, 82_000.0), 20_000)
    rows = cover.select("i", "_level", F.size("_edges").alias("n"), "_odd").collect()
    mine = [r for r in rows if r.i == 0]
    assert max(r.n for r in mine) <= spatial.EDGES_PER_TILE
    assert any(r.n == 0 and r._odd for r in mine) and len({r._level for r in mine}) > 2
    assert sum(r.n for r in mine) < 4 * 20_000
    assert 1 <= sum(r.i == 1 for r in rows) <= 4


def test_no_shapes_and_no_points(spark):
    points, none = spark.createDataFrame([(0.5, 0.5)], "x double, y double"), layer(spark, [])
    assert spatial.point_in_polygon(points, none, "x", "y", "i", ["i"]).columns == ["x", "y", "i"]
    assert found(points, none) == {} and found(points, layer(spark, [[]])) == {}
    assert found(points.limit(0), layer(spark, [box(0, 0, 1, 1)])) == {}


@pytest.mark.parametrize("south,north", [(-60, 75), (8, 13)])
def test_nearest_station_against_brute_force(spark, south, north):
    rnd = random.Random(north)
    villages = [(f"v{k}", rnd.uniform(south, north), rnd.uniform(60, 90)) for k in range(300)]
    stations = [(f"s{k:03d}", rnd.uniform(south, north), rnd.uniform(60, 90)) for k in range(300)]
    got = spatial.nearest_station(
        spark.createDataFrame(villages, "panchayat_id string, latitude double, longitude double"),
        spark.createDataFrame(stations, "station_id string, latitude double, longitude double"),
    ).collect()
    assert len(got) == 300
    for r in got:
        km = lambda s: math.hypot((r.latitude - s[1]) * 111, (r.longitude - s[2]) * 111 * math.cos(math.radians(r.latitude)))
        best = min(stations, key=km)
        assert r.nearest_station_id == best[0] and abs(r.nearest_station_distance_km - km(best)) < 0.006
