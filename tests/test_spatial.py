"""Spatial joins against plain loops, and what must not change their result."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from siteline.operators import spatial
from siteline.plans import nearby, q_noise
from siteline.sources.views import view

R = 400.0


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    place = lambda: (-37.9 + rng.random() * 0.03, 144.9 + rng.random() * 0.03)
    props = [(i, *place()) for i in range(60)] + [(900, None, 144.9)]
    segs = []
    for i in range(150):
        (y1, x1), dx, dy = place(), rng.uniform(-0.004, 0.004), rng.uniform(-0.004, 0.004)
        segs.append((i, "road", "primary", 50.0, x1, y1, x1 + dx, y1 + dy, min(x1, x1 + dx), min(y1, y1 + dy)))
    return spark.createDataFrame(props, "property_id long, lat double, lng double"), spark.createDataFrame(segs, "road_id long, subtype string, class string, speed_kmh double, x1 double, y1 double, x2 double, y2 double, xmin double, ymin double")


def plain_pairs(props, segs):
    out = {}
    d = R / 111_000 * 1.5
    for p in props.where("lat is not null").collect():
        for s in segs.collect():
            if not (p.lng - d <= s.xmin <= p.lng + d and p.lat - d <= s.ymin <= p.lat + d):
                continue
            dx, dy = s.x2 - s.x1, s.y2 - s.y1
            t = max(0, min(1, ((p.lng - s.x1) * dx + (p.lat - s.y1) * dy) / (dx * dx + dy * dy)))
            m = math.hypot(s.x1 + t * dx - p.lng, s.y1 + t * dy - p.lat) * 111320 * math.cos(math.radians(p.lat))
            if m < R:
                out[p.property_id, s.road_id] = round(m, 6)
    return out


@pytest.mark.parametrize("cell", [0.3, 1.25, 7.0])
def test_segment_join_is_the_cross_join_whatever_the_cell(world, cell):
    props, segs = world
    before, spatial.CELL = spatial.CELL, cell
    try:
        rows = nearby.roads(props, segs, R).collect()
    finally:
        spatial.CELL = before
    got = {(r.property_id, r.road_id): round(r.dist_m, 6) for r in rows}
    assert len(rows) == len(got) and got == plain_pairs(props, segs) and got


def test_overlap_join_meets_each_pair_once(spark, world):
    props, _ = world
    rng = random.Random(9)
    boxes = [(i, x, x + w, y, y + h) for i in range(80) for x, y, w, h in [(144.88 + rng.random() * 0.06, -37.92 + rng.random() * 0.06, rng.random() * 0.02, rng.random() * 0.02)]] + [(999, 140.0, 150.0, -40.0, -30.0)]
    feats = spark.createDataFrame(boxes, "f long, xmin double, xmax double, ymin double, ymax double")
    d = R / 111_000 * 1.5
    want = {(p.property_id, f) for p in props.where("lat is not null").collect() for f, x1, x2, y1, y2 in boxes if x1 < p.lng + d and x2 > p.lng - d and y1 < p.lat + d and y2 > p.lat - d}
    for most in (4096, 10):
        rows = [(r.property_id, r.f) for r in spatial.overlapping(nearby.keyed(props), feats, R, most_cells=most).select("property_id", "f").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_far_feature_changes_nothing(spark, world):
    props, segs = world
    far = segs.limit(1).withColumn("road_id", F.lit(5000).cast("long"))
    for c in ("x1", "x2", "xmin"):
        far = far.withColumn(c, F.col(c) + 5)
    assert nearby.roads(props, segs.unionByName(far), R).count() == nearby.roads(props, segs, R).count()


def test_inside_counts_crossings(spark):
    ring = [(0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.1, 0.1), (0.0, 0.2)]
    edges = [(1, i, *a, *b, 0.0, 0.2, 0.0, 0.2) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    e = spark.createDataFrame(edges, "o long, i int, x1 double, y1 double, x2 double, y2 double, xmin double, xmax double, ymin double, ymax double")
    p = spark.createDataFrame([(1, 0.05, 0.1), (2, 0.15, 0.1), (3, 0.15, 0.02), (4, 0.5, 0.5)], "property_id long, lat double, lng double")
    assert sorted(r.property_id for r in spatial.inside(p, e, "o", []).collect()) == [1, 3]


def test_more_screening_never_adds_noise(spark):
    src = spark.createDataFrame([(1, "road", 2, 7, "primary", 70.0, 100.0, 145.0, -37.8, 1.0)], ", ".join(f"{c} {t}" for c, t in zip(q_noise.SOURCE, ["long", "string", "int", "long", "string", *["double"] * 5])))
    props = spark.createDataFrame([(1, -37.8009, 145.0)], "property_id long, lat double, lng double")
    levels = []
    for n in range(4):
        at = [-37.8002 - 0.0002 * i for i in range(n)]
        b = spark.createDataFrame([(8.0, 145.0, y, 144.9999, 145.0001, y - 0.0001, y + 0.0001) for y in at], "height double, clng double, clat double, xmin double, xmax double, ymin double, ymax double")
        levels.append(q_noise.screened(src, props, b, 500).first().level)
    assert levels == sorted(levels, reverse=True) and levels[0] == 70.0 and levels[3] < levels[0]


@pytest.mark.parametrize(("levels", "kept"), [([70, 65, 55], 2), ([50], 1), ([60, 58, 55, 52], 3), ([], 0)])
def test_adaptive_select(spark, levels, kept):
    df = spark.createDataFrame([(1, 2, i, float(v)) for i, v in enumerate(levels)], "property_id long, kind_no int, sid long, level double")
    assert q_noise.adaptive_select(df, 8).count() == kept


def test_noise_takes_sources_within_500_m(spark):
    d = "/root/testdata/sf0.001"
    props = [tuple(r) for r in view(spark, d, "v_properties").select("property_id", "lat", "lng").collect()]
    roads = [tuple(r) for r in view(spark, d, "v_roads").where("subtype = 'road'").select("road_id", "x1", "y1", "x2", "y2").collect()]
    got = {(r.property_id, r.road_id) for r in q_noise.parts_of(spark, d)["roads"].select("property_id", "road_id").collect()}
    ids, x1, y1, x2, y2 = (np.array(c) for c in zip(*roads))
    some = 0
    for p, lat, lng in props:
        a, b = np.stack((x1 - lng, y1 - lat), axis=1), np.stack((x2 - lng, y2 - lat), axis=1)
        t = np.clip(-(a * (b - a)).sum(axis=1) / np.maximum(((b - a) ** 2).sum(axis=1), 1e-18), 0, 1)
        dist = np.hypot(*(a + t[:, None] * (b - a)).T) * 111_320 * math.cos(math.radians(lat))
        window = (abs(np.minimum(x1, x2) - lng) < 500 / 111_000 * 1.5) & (abs(np.minimum(y1, y2) - lat) < 500 / 111_000 * 1.5)
        assert {q for q in got if q[0] == p} == {(p, int(i)) for i in ids[window & (dist < 500)]}
        some += int((window & (dist > 300) & (dist < 500)).sum())
    assert some > 0
    spark.catalog.clearCache()


@pytest.mark.parametrize("cell_m", [15.0, 100.0, 700.0])
def test_rays_meet_all_points_along_their_way(spark, cell_m):
    rng = random.Random(12)
    rays = [(i, 145 + 0.01 * rng.random(), -38 + 0.01 * rng.random(), 145 + 0.01 * rng.random(), -38 + 0.01 * rng.random()) for i in range(60)]
    rays += [(60, 145.0, -38.0, 145.01, -38.0), (61, 145.0, -38.0, 145.0, -37.99), (62, 145.002, -37.998, 145.002, -37.998)]  # level, upright, a point
    points = [(i, 145 + 0.01 * rng.random(), -38 + 0.01 * rng.random()) for i in range(400)]
    k = 111_320 * math.cos(math.radians(38))
    left = spark.createDataFrame(rays, "r long, x1 double, y1 double, x2 double, y2 double").withColumn("k", F.lit(k))
    right = spark.createDataFrame(points, "p long, px double, py double")
    dx, dy = (F.col("x2") - F.col("x1")) * k, (F.col("y2") - F.col("y1")) * 111_320
    bx, by = (F.col("px") - F.col("x1")) * k, (F.col("py") - F.col("y1")) * 111_320
    size = F.sqrt(dx * dx + dy * dy)
    near = (F.abs(bx * dy - by * dx) <= 30 * size) & (bx * dx + by * dy >= 0) & (bx * dx + by * dy <= size * size) & (size > 0)
    want = {(r.r, r.p) for r in left.crossJoin(right).where(near).collect()}
    got = [(r.r, r.p) for r in spatial.near_rays(left, right, "px", "py", 30.0, near, cell_m).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


@pytest.mark.parametrize("radius", [300.0, 500.0])
def test_candidates_of_rays_grow_with_their_way(spark, radius):
    """What a ray looks at: cells along its way, not all buildings of the window."""
    k = 111_320 * math.cos(math.radians(38))
    ray = spark.createDataFrame([(145.0, -38.0, 145.0 + radius / k * 0.7, -38.0 + radius / 111_320 * 0.7)], "x1 double, y1 double, x2 double, y2 double").withColumn("k", F.lit(k))
    step = 20.0  # a building each 20 m in the window of the radius
    n = int(2 * 1.5 * radius / step)
    grid = [(145.0 + (i - n / 2) * step / k, -38.0 + (j - n / 2) * step / 111_320) for i in range(n) for j in range(n)]
    met = spatial.near_rays(ray, spark.createDataFrame(grid, "px double, py double"), "px", "py", 30.0, F.lit(True), 50.0).count()
    assert radius / step * 3 < met < radius / step * 16 < len(grid) / 8


def test_rays_are_dealt_out_by_the_cells_that_they_cross(spark, monkeypatch):
    """The margin is the points' matter: a ray of 400 m meets at most a row of cells, not a strip around it."""
    k = 111_320 * math.cos(math.radians(38))
    dealt, edge_cells = [], spatial.edge_cells
    monkeypatch.setattr(spatial, "edge_cells", lambda *a, **b: dealt.append(edge_cells(*a, **b)) or dealt[-1])
    ray = spark.createDataFrame([(145.0, -38.0, 145.0 + 400 / k, -38.0)], "x1 double, y1 double, x2 double, y2 double").withColumn("k", F.lit(k))
    spatial.near_rays(ray, spark.createDataFrame([(145.0, -38.0)], "px double, py double"), "px", "py", 30.0, F.lit(True), 50.0)
    assert dealt[0].count() <= 400 / 50 / math.cos(math.radians(38)) + 2
