"""Rasters as tiles: a row for each tile with the values of its cells and of a margin around them as one array.

A point's tile holds all cells that a small window around the point can touch, so a property meets one row and reads its
samples by their place in the array; nothing is joined by cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a tile's side and of the margin on each side of it.
SIZE, MARGIN = 64, 6
#: Rows of tiles that share a Parquet partition.
BAND = 16


def cell_of(x: Column, x0: float, step: float) -> Column:
    """The nearest cell along one axis."""
    return F.floor((x - x0) / step + 0.5).cast("int")


def tiles(cells: DataFrame, by: list[str] | None = None, size: int = SIZE, margin: int = MARGIN) -> DataFrame:
    """(by..., ty, tx, values) of cells (by..., row, col, value), which are unique; cells that are missing are null.

    ``values`` has (size + 2 margin) squared entries, row by row. Cells near a border go to the tiles on the other side too;
    tiles that have nothing but such a margin are there as well.
    """
    by, n = by or [], size + 2 * margin
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / size), F.floor((F.col(c) + margin) / size)))
    own = cells.select(*by, "row", "col", "value").withColumn("ty", reach("row")).withColumn("tx", reach("col"))
    place = (F.col("row") - F.col("ty") * size + margin) * n + F.col("col") - F.col("tx") * size + margin
    own = own.select(*by, "ty", "tx", place.cast("int").alias("place"), "value")
    # every place of a tile, so that a value's place is its index; rows of tiles are dealt out by number before their places are
    # made, as Spark takes the few tiles together in a task or two
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lines = own.select(*by, "ty", "tx").distinct().select("*", upto.alias("_r")).repartition(parts, *by, "ty", "tx", "_r")
    blank = lines.select(*by, "ty", "tx", "_r", upto.alias("_c")).select(*by, "ty", "tx", (F.col("_r") * n + F.col("_c")).alias("place"), F.lit(None).cast("double").alias("value"))
    full = own.unionByName(blank).groupBy(*by, "ty", "tx", "place").agg(F.max("value").alias("value"))
    return full.groupBy(*by, "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).getField("value").alias("values"))


def around(points: DataFrame, of: DataFrame, offsets: list[tuple[float, float]], lat0: float, lng0: float, step: float, size: int = SIZE, margin: int = MARGIN) -> DataFrame:
    """``points`` (lat, lng) with ``samples``, an array of (i, s_lat, s_lng, value) at offsets of (lat, lng) degrees: values of the
    nearest cells, null outside the raster. Offsets reach as far as ``margin`` less one cell at most."""
    if max((max(abs(a), abs(b)) for a, b in offsets), default=0.0) / step > margin - 1 + 1e-6:
        raise ValueError("offsets reach beyond the margin of the tiles")
    n = size + 2 * margin
    left = points.withColumn("_ty", F.floor(cell_of(F.col("lat"), lat0, step) / size)).withColumn("_tx", F.floor(cell_of(F.col("lng"), lng0, step) / size))
    met = left.join(of.select("ty", "tx", "values").hint("merge"), (F.col("_ty") == F.col("ty")) & (F.col("_tx") == F.col("tx")), "left")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("dy"), F.lit(float(b)).alias("dx")) for i, (a, b) in enumerate(offsets)])

    def sample(o: Column) -> Column:
        lat, lng = F.col("lat") + o["dy"], F.col("lng") + o["dx"]
        place = (cell_of(lat, lat0, step) - F.col("_ty") * size + margin) * n + cell_of(lng, lng0, step) - F.col("_tx") * size + margin
        return F.struct(o["i"].alias("i"), lat.alias("s_lat"), lng.alias("s_lng"), F.get(F.col("values"), place.cast("int")).alias("value"))

    return met.withColumn("samples", F.transform(steps, sample)).drop("_ty", "_tx", "ty", "tx", "values")


def land(of: DataFrame, path: str) -> None:
    """Write tiles (dataset, ty, tx, values) by dataset and band of rows, so that a scan reads what it names."""
    banded = of.withColumn("band", F.floor(F.col("ty") / BAND).cast("int"))
    banded.repartition("dataset", "band").sortWithinPartitions("ty", "tx").write.mode("overwrite").partitionBy("dataset", "band").parquet(path)


def landed(spark: SparkSession, path: str, dataset: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """Tiles of a dataset, of rows of cells ``rows`` (first, last) only if given; other files are not read."""
    out = spark.read.parquet(path).where(F.col("dataset") == dataset)
    if rows:
        first, last = (math.floor(r / SIZE) for r in rows)
        out = out.where(F.col("band").between(first // BAND, last // BAND) & F.col("ty").between(first, last))
    return out.select("ty", "tx", "values")


def cells_of(of: DataFrame, size: int = SIZE, margin: int = MARGIN) -> DataFrame:
    """(row, col, value) of the tiles' own cells that are not null: the raster that ``tiles`` was made of."""
    n = size + 2 * margin
    rows = of.select("ty", "tx", F.posexplode("values").alias("place", "value")).where("value is not null")
    y, x = F.floor(F.col("place") / n) - margin, F.col("place") % n - margin
    rows = rows.where((y >= 0) & (y < size) & (x >= 0) & (x < size))
    return rows.select((F.col("ty") * size + y).cast("int").alias("row"), (F.col("tx") * size + x).cast("int").alias("col"), "value")
