"""Feature files along a Z curve: the rows of a window, what reaches the scan, and how much of a file it reads."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from siteline.plans.q_etl import overwrite_partitions
from siteline.sources import layout

BOX = (144.92, -37.88, 144.98, -37.82)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, x, x + rng.random() * 0.01, y, y + rng.random() * 0.01) for i in range(30_000) for x, y in [(140 + 10 * rng.random(), -40 + 6 * rng.random())]]
    rows += [(30_000 + i, x, x + 0.01, y, y + 0.01) for i in range(200) for x, y in [(144.9 + 0.1 * rng.random(), -37.9 + 0.1 * rng.random())]]
    rows += [(40_000, BOX[0], BOX[0], BOX[1], BOX[1]), (40_001, BOX[2], 150.0, BOX[3], -30.0), (40_002, 100.0, 160.0, -60.0, 0.0), (40_003, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, xmin double, xmax double, ymin double, ymax double")
    path = str(tmp_path_factory.mktemp("features"))
    layout.write_features(df, path, files=6, group_bytes=64 << 10)
    return rows, path


def scanned(df):
    """Rows that the file scan put out, after the query has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value(), plan.toString()


def test_windows_have_their_rows(written, spark):
    rows, path = written
    x1, y1, x2, y2 = BOX
    corner = {r[0] for r in rows if r[1] is not None and x1 <= r[1] <= x2 and y1 <= r[3] <= y2}
    over = {r[0] for r in rows if r[1] is not None and r[1] <= x2 and r[2] >= x1 and r[3] <= y2 and r[4] >= y1}
    assert {r.id for r in layout.features_from(spark, path, BOX).collect()} == corner >= {40_000, 40_001}
    assert {r.id for r in layout.features_over(spark, path, BOX).collect()} == over >= {40_002}
    assert spark.read.parquet(path).count() == len(rows)


@pytest.mark.parametrize("read", [layout.features_from, layout.features_over])
def test_filters_reach_the_scan_and_row_groups_are_skipped(written, spark, read):
    rows, path = written
    n, plan = scanned(read(spark, path, BOX).select("id"))
    assert "bbox.xmin" in plan.split("PushedFilters")[1] and "ReadSchema" in plan
    groups = sum(pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in spark.read.parquet(path).inputFiles())
    assert groups >= 6 and n < len(rows) / 3


def test_ranges_hold_every_key_of_a_window(spark):
    rng = random.Random(3)
    for _ in range(20):
        x, y = -180 + 359 * rng.random(), -90 + 179 * rng.random()
        box = (x, y, x + rng.random() ** 3, y + rng.random() ** 3)
        points = spark.createDataFrame([(box[0] + (box[2] - box[0]) * a, box[1] + (box[3] - box[1]) * b) for a in (0.0, 0.3, 1.0) for b in (0.0, 0.7, 1.0)], "x double, y double")
        ranges = layout.z_ranges(*box)
        assert len(ranges) <= 36 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        assert all(any(lo <= r.z <= hi for lo, hi in ranges) for r in points.select(layout.z_key(F.col("x"), F.col("y")).alias("z")).collect())


def test_only_the_named_partition_is_written_anew(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("states"))
    df = spark.createDataFrame([(1, "VIC"), (2, "WA"), (3, "WA"), (4, "NSW")], "id int, state string")
    df.write.mode("overwrite").partitionBy("state").parquet(path)
    before = set(spark.read.parquet(path).inputFiles())
    overwrite_partitions(spark.createDataFrame([(9, "WA")], "id int, state string"), path, ["state"])
    after = set(spark.read.parquet(path).inputFiles())
    assert {f for f in before if "state=WA" not in f} == {f for f in after if "state=WA" not in f} and not {f for f in before & after if "state=WA" in f}
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "state").collect()} == {(1, "VIC"), (9, "WA"), (4, "NSW")}
