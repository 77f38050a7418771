"""Cells that adapt to density: the pairs of the plain join, and how even the keys are."""

import math
import random

import pytest
from pyspark.sql import functions as F
from siteline.functions import geo
from siteline.operators import dense, spatial

R = 400.0


@pytest.fixture(scope="module")
def city(spark):
    """Nine in ten points within one square of the plain join, a tenth of these at one place."""
    rng = random.Random(8)
    core = [(i, 144.9051 + rng.random() * 0.01, -37.9049 + rng.random() * 0.01) for i in range(3240)]
    core += [(3240 + i, 144.91, -37.9) for i in range(360)]
    rest = [(3600 + i, 144.8 + rng.random() * 0.3, -38.0 + rng.random() * 0.3) for i in range(400)]
    props = [(i, -37.9 + rng.gauss(0, 0.01), 144.91 + rng.gauss(0, 0.01)) for i in range(80)] + [(90 + i, -38.0 + rng.random() * 0.3, 144.8 + rng.random() * 0.3) for i in range(40)] + [(999, None, 144.9)]
    points = core + rest + [(9999, None, -37.9), (0, *core[0][1:])]
    return spark.createDataFrame(props, "property_id long, lat double, lng double"), spark.createDataFrame(points, "poi long, px double, py double")


def pairs(df):
    return sorted((r.property_id, r.poi) for r in df.collect())


@pytest.mark.parametrize("most", [20, 150, 100_000])
def test_pairs_are_those_of_fixed_cells(city, tmp_path, most):
    props, points = city
    near = geo.dist_isotropic(F.col("lat"), F.col("lng"), F.col("py"), F.col("px")) < R
    want = pairs(spatial.corner_join(props, points, R, "px", "py", near))
    got = dense.dense_join(props, points, R, "px", "py", f"{tmp_path}/full", near, most)
    assert pairs(got) == want and len(want) > 10_000
    assert got.columns == ["property_id", "lat", "lng", "poi", "px", "py"]


def test_no_leaf_is_fuller_than_allowed(city, spark, tmp_path):
    props, points = city
    delta = geo.window_deg(R)
    size, most = spatial.CELL * 2 * delta, 150
    plain = points.groupBy(F.floor(F.col("py") / size), F.floor(F.col("px") / size)).count().agg(F.max("count")).first()[0]
    full = dense.crowded(points, "px", "py", size, most).cache()
    sizes = [r["count"] for r in dense.leaves(points, full, "px", "py", size, most).groupBy("_fl", "_fy", "_fx", "_fs").count().collect()]
    assert plain > 1000 and sum(sizes) == points.where("px is not null").count()
    # shares are drawn by hash, so they are even but for chance
    assert max(sizes) <= most * 1.3
    leaf = dense.windows(props, full, delta, size, most).groupBy("_cl", "_cy", "_cx").agg(F.countDistinct("_cs").alias("shares"))
    assert leaf.agg(F.max("shares")).first()[0] == math.ceil(360 / most)


def test_tasks_are_even(city, spark, tmp_path):
    """Points of the busiest of 16 partitions against the mean: the plain key against leaves and shares."""
    _, points = city
    size, most = spatial.CELL * 2 * geo.window_deg(R), 40
    full = dense.crowded(points, "px", "py", size, most).cache()

    def busiest(df, keys):
        sizes = [r["count"] for r in df.groupBy(F.pmod(F.hash(*keys), F.lit(16))).count().collect()]
        return max(sizes) / (sum(sizes) / 16)

    plain = points.where("px is not null").withColumn("_fy", F.floor(F.col("py") / size)).withColumn("_fx", F.floor(F.col("px") / size))
    assert busiest(plain, ["_fy", "_fx"]) > 5
    assert busiest(dense.leaves(points, full, "px", "py", size, most), ["_fl", "_fy", "_fx", "_fs"]) < 3


def test_empty_tables(city, tmp_path):
    props, points = city
    assert dense.dense_join(props, points.limit(0), R, "px", "py", f"{tmp_path}/a").count() == 0
    assert dense.dense_join(props.limit(0), points, R, "px", "py", f"{tmp_path}/b").count() == 0


def test_the_limit_of_a_leaf_grows_with_the_table(city, monkeypatch, tmp_path, spark):
    """So few squares may be cut that the limit is raised, and the pairs stay."""
    props, points = city
    monkeypatch.setattr(dense, "MOST_CUT", 4)
    got = dense.dense_join(props, points, R, "px", "py", f"{tmp_path}/full", None, 10)
    assert pairs(got) == pairs(spatial.corner_join(props, points, R, "px", "py"))
    assert spark.read.parquet(f"{tmp_path}/full").count() < (dense.LEVELS + 1) * 4
