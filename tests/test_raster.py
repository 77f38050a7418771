"""Raster tiles against plain look-ups, and what a scan of landed tiles reads."""

import math
import random

import pytest
from pyspark.sql import functions as F
from siteline.operators import raster

STEP, LAT, LNG = 0.001, -37.9, 144.9


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(6)
    cells = {(r, c): float((r * 17 + c * 31) % 101) for r in range(-3, 150) for c in range(60, 140) if rng.random() > 0.1}
    points = [(i, LAT + rng.uniform(-0.01, 0.16), LNG + rng.uniform(0.05, 0.15)) for i in range(400)]
    points += [(400 + i, LAT + i * STEP / 2, LNG + 0.064 + i * STEP / 2) for i in range(40)] + [(999, None, LNG), (1000, 10.0, 10.0)]
    made = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, value double")
    return cells, points, made, spark.createDataFrame(points, "property_id long, lat double, lng double")


@pytest.mark.parametrize(("size", "margin"), [(64, 6), (16, 6), (7, 6)])
def test_samples_are_those_of_the_cells(world, size, margin):
    cells, points, made, props = world
    offsets = [(a * STEP, b * STEP) for a in range(-5, 6) for b in range(-5, 6)]
    tiles = raster.tiles(made, size=size, margin=margin).cache()
    got = {r.property_id: r.samples for r in raster.around(props, tiles, offsets, LAT, LNG, STEP, size, margin).collect()}
    assert len(got) == len(points)
    place = lambda x, x0: math.floor((x - x0) / STEP + 0.5)
    for i, lat, lng in points:
        if lat is None:
            assert all(s.value is None for s in got[i])
            continue
        want = [cells.get((place(lat + a, LAT), place(lng + b, LNG))) for a, b in offsets]
        assert [s.value for s in got[i]] == want and [s.i for s in got[i]] == list(range(121))
    back = {(r.row, r.col): r.value for r in raster.cells_of(tiles, size, margin).collect()}
    assert back == cells


def test_offsets_beyond_the_margin_are_refused(world):
    _, _, made, props = world
    with pytest.raises(ValueError):
        raster.around(props, raster.tiles(made), [(0.006, 0.0)], LAT, LNG, STEP)


def test_one_join_row_for_a_property(world):
    _, _, made, props = world
    offsets = [(a * STEP, b * STEP) for a in range(-5, 6) for b in range(-5, 6)]
    plan = raster.around(props, raster.tiles(made), offsets, LAT, LNG, STEP)
    assert plan.count() == props.count() and "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_scans_read_the_named_dataset_and_rows(world, spark, tmp_path_factory):
    cells, _, made, _ = world
    path = str(tmp_path_factory.mktemp("landed"))
    both = made.withColumn("dataset", F.lit("water")).unionByName(made.withColumn("dataset", F.lit("cover")).withColumn("value", -F.col("value")))
    wide = both.unionByName(both.withColumn("row", F.col("row") + 64 * raster.BAND))
    raster.land(raster.tiles(wide, ["dataset"]), path)
    some = raster.landed(spark, path, "water", (0, 140))
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "dataset" in filters and "band" in filters
    read, every = len(some.inputFiles()), len(spark.read.parquet(path).inputFiles())
    files = {r[0] for r in some.select(F.input_file_name()).distinct().collect()}
    assert read <= every and all("dataset=water" in f and "band=0" in f for f in files)
    got = {(r.row, r.col): r.value for r in raster.cells_of(some).collect()}
    assert {k: v for k, v in got.items() if k[0] < 150} == {k: v for k, v in cells.items() if k[0] >= 0}
    assert raster.landed(spark, path, "none").count() == 0


def test_places_of_tiles_are_made_in_many_tasks(spark):
    cells = spark.range(20).select((F.col("id") * raster.SIZE).cast("int").alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("value"))
    plan = raster.tiles(cells)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # numbers that are asked for stay, others are made smaller as Spark sees fit
