"""Covers of polygons and the joins on them against plain even-odd tests, on long rings, holes and awkward points."""

import math
import random

import pytest
from pyspark.sql import functions as F
from siteline.operators import spatial

EDGE = "poly long, x1 double, y1 double, x2 double, y2 double, xmin double, xmax double, ymin double, ymax double"


def ring(points):
    return list(zip(points, points[1:] + points[:1]))


def rows(polys):
    out = []
    for key, rings in polys.items():
        edges = [e for r in rings for e in ring(r)]
        xs, ys = [p[0] for a, b in edges for p in (a, b)], [p[1] for a, b in edges for p in (a, b)]
        out += [(key, float(a[0]), float(a[1]), float(b[0]), float(b[1]), float(min(xs)), float(max(xs)), float(min(ys)), float(max(ys))) for a, b in edges]
    return out


def star(cx, cy, r, n, rng, depth=0.6):
    return [(cx + r * k * math.cos(a), cy + r * k * math.sin(a)) for i in range(n) for a, k in [(2 * math.pi * i / n, 1 - depth * rng.random())]]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    polys = {1: [star(145.0, -38.0, 0.5, 10_000, rng, 0.3)]}  # 10,000 edges over a degree
    polys[2] = [[(144.0, -38.5), (146.0, -38.5), (146.0, -37.5), (144.0, -37.5)], [(144.5, -38.2), (145.5, -38.2), (145.5, -37.8), (144.5, -37.8)]]  # a hole
    polys[3] = [[(144.9, -38.0), (144.95, -38.0), (144.95, -37.95), (144.925, -37.95), (144.925, -37.97), (144.9, -37.97)]]  # level edges on round values
    polys[4] = [[(145.001, -38.001), (145.002, -38.001), (145.0015, -38.0)]]  # smaller than a cell
    polys[5] = [[(145.0, -38.0), (145.0, -38.0), (145.0, -38.0)]]  # a point
    polys[6] = [star(145.1, -37.9, 0.2, 7, rng), star(145.15, -37.9, 0.2, 9, rng)]  # overlapping rings
    polys[7] = [[(100.0, -60.0), (160.0, -60.0), (160.0, -10.0), (100.0, -10.0)]]  # a box over everything
    points = [(144 + 2 * rng.random(), -38.6 + 1.2 * rng.random()) for _ in range(900)]
    points += [(144.9 + 0.06 * rng.random(), -38.01 + 0.07 * rng.random()) for _ in range(300)]
    points += [(round(144.88 + 0.005 * i, 3), round(-38.005 + 0.005 * j, 3)) for i in range(20) for j in range(16)]  # on vertices and level with edges
    points += [(145.0015, -38.0005), (99.0, -38.0), (145.0, -61.0)]
    props = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)] + [(99_999, None, 145.0)], "property_id long, lat double, lng double")
    return polys, points, props.cache(), spark.createDataFrame(rows(polys), EDGE).cache()


def plain_inside(lng, lat, edges):
    odd = False
    for _, x1, y1, x2, y2, *_ in edges:
        if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.05, 0.3])
def test_inside_is_the_even_odd_rule(world, cell):
    polys, points, props, edges = world
    got = {(r.property_id, r.poly) for r in spatial.inside(props, edges, "poly", [], cell).collect()}
    by = {k: rows({k: p}) for k, p in polys.items()}
    want = {(i, k) for i, (x, y) in enumerate(points) for k in polys if (k != 1 or i % 5 == 0) and plain_inside(x, y, by[k])}
    assert {p for p in got if p[1] != 1 or p[0] % 5 == 0} == want
    assert {k for _, k in want} == {1, 2, 3, 4, 6, 7}


def test_rows_are_bounded_by_crossings_and_cells(world, spark):
    polys, _, _, edges = world
    border, inner = spatial.polygon_cover(edges.where("poly = 1"), "poly", [])
    # an edge of this ring is some 0.1 degrees long at most: two or three cells of 0.05
    assert border.count() < 10_000 * 5
    assert inner.count() < (1.0 / 0.05 + 2) ** 2
    both = border.select("_fy", "_fx").distinct().join(inner, ["_fy", "_fx"])
    assert both.count() == 0
    # a long edge has a row for each cell on its way
    long = spark.createDataFrame([(1, 140.0, -40.0, 145.0, -35.0, 140.0, 145.0, -40.0, -35.0)], EDGE)
    assert 100 <= spatial.edge_cells(long, 0.05).count() <= 302


def test_cover_takes_columns_along_and_null_keys(world):
    _, _, props, edges = world
    some = edges.where("poly = 3").withColumn("name", F.lit("a")).withColumn("none", F.lit(None).cast("string"))
    got = spatial.inside(props, some, "poly", ["name", "none"])
    assert got.columns == ["property_id", "poly", "name", "none"] and got.count() == spatial.inside(props, some, "poly", []).count() > 0
    assert spatial.inside(props, edges.limit(0), "poly", []).count() == 0
    assert spatial.inside(props.limit(0), edges, "poly", []).count() == 0


def test_near_polygons_is_the_least_edge_distance(world):
    polys, points, props, edges = world
    radius = 3000.0
    some = {k: v for k, v in polys.items() if k not in (1, 7)}
    got = {(r.property_id, r.poly): round(r.dist_m, 6) for r in spatial.near_polygons(props, edges.where("poly not in (1, 7)"), "poly", radius, []).collect()}
    d, want = radius / 111_000 * 1.5, {}
    for k, p in some.items():
        own = rows({k: p})
        xmin, xmax, ymin, ymax = own[0][5:]
        for i, (x, y) in enumerate(points):
            if not (xmin <= x + d and xmax >= x - d and ymin <= y + d and ymax >= y - d):
                continue
            best = math.inf
            for _, x1, y1, x2, y2, *_ in own:
                dx, dy = x2 - x1, y2 - y1
                size = dx * dx + dy * dy
                t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / size)) if size else 0.0
                best = min(best, math.hypot(x1 + t * dx - x, y1 + t * dy - y) * 111_320 * math.cos(math.radians(y)))
            best = 0.0 if plain_inside(x, y, own) else best
            if best < radius:
                want[i, k] = round(best, 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want) and len(want) > 100
