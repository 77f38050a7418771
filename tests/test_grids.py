"""Keeping a landed grid up to date: what is scored, which squares are written, and the same rows as a whole new grid."""

import pytest
from pyspark.sql import functions as F
from siteline.plans import q_grids, q_serve
from siteline.plans.nearby import roads

R = 500.0
SEGMENT = "road_id long, subtype string, class string, speed_kmh double, x1 double, y1 double, x2 double, y2 double, xmin double, ymin double"


@pytest.fixture(scope="module")
def town(spark):
    points = q_serve.grid_points(spark, -37.9, -37.7, 144.9, 145.1, 0.004)
    segs = []
    for i in range(60):
        x, y, dx, dy = 144.9 + i * 37 % 60 * 0.003, -37.9 + i * 0.003, (i % 5 - 2) * 0.002, (i % 3 - 1) * 0.002
        segs.append((i, "road", "primary", 50.0, x, y, x + dx, y + dy, min(x, x + dx), min(y, y + dy)))
    return points, spark.createDataFrame(segs, SEGMENT)


def scorer(segs, asked):
    """Points scored by the roads near them; every call notes how many points it was asked for."""

    def score(points):
        asked.append(points.count())
        near = roads(points, segs, R).groupBy("property_id").agg(F.count("*").alias("n"), F.round(F.min("dist_m"), 3).alias("d"))
        return points.join(near, "property_id", "left")

    return score


def rows(df):
    return sorted(tuple(r) for r in df.select("property_id", "lat", "lng", "n", "d").collect())


def files(spark, path):
    return {f for f in spark.read.parquet(path).inputFiles()}


@pytest.mark.parametrize("late", [[7], [3, 44]])
def test_only_what_is_in_reach_is_scored_and_written(spark, town, tmp_path, late):
    points, segs = town
    asked, path = [], f"{tmp_path}/grid"
    new = F.col("road_id").isin(late)
    q_grids.land_grid(scorer(segs.where(~new), asked)(points), path)
    before = files(spark, path)
    written = q_grids.refresh(spark, path, f"{tmp_path}/staging", points, segs.where(new), R, scorer(segs, asked))
    after = files(spark, path)
    squares = {f.split("square=")[1].split("/")[0] for f in before - after}
    assert set(written) == squares == {f.split("square=")[1].split("/")[0] for f in after - before}
    assert 0 < len(written) < len({f.split("square=")[1].split("/")[0] for f in before}) and asked[1] < asked[0] / 10
    assert rows(spark.read.parquet(path)) == rows(scorer(segs, [])(points))


def test_nothing_in_reach_writes_nothing(spark, town, tmp_path):
    points, segs = town
    path = f"{tmp_path}/grid"
    q_grids.land_grid(scorer(segs, [])(points), path)
    before = files(spark, path)
    far = segs.where("road_id = 1").select("road_id", "subtype", "class", "speed_kmh", *((F.col(c) + 5).alias(c) for c in ("x1", "y1", "x2", "y2", "xmin", "ymin")))
    assert q_grids.refresh(spark, path, f"{tmp_path}/staging", points, far, R, scorer(segs, [])) == []
    assert files(spark, path) == before


@pytest.mark.parametrize(("name", "n"), [("melbourne-inner", 20 * 24), ("melbourne", 50 * 90)])
def test_points_of_a_flood_region(spark, name, n):
    lat0, lat1, lng0, lng1, step = q_grids.FLOOD_REGIONS[name]
    points = q_serve.grid_points(spark, lat0, lat1, lng0, lng1, step)
    low = points.agg(F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng"), F.countDistinct("lat", "lng")).first()
    assert points.count() == n == low[4] and (low[0], low[2]) == (lat0, lng0)
    assert low[1] == pytest.approx(lat1 - step) and low[3] == pytest.approx(lng1 - step)
