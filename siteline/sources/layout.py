"""Feature files laid out along a Z curve, so that a window reads few row groups.

Features are dealt out and sorted by the Z key of their least corner and carry their box as a struct, as open map data does.
A row group then spans a small area, and its statistics of the key and of the box tell whether a window needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key for each axis: cells of 0.0055 degrees of longitude and half of that of latitude.
BITS = 16
#: Cells of a window along each axis at most when it is covered by ranges of keys.
ACROSS = 4


def _axis(x: Column, lo: float, span: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((x - lo) / span * (1 << BITS)))).cast("long")


def z_key(lng: Column, lat: Column) -> Column:
    """Bits of the columns and rows of a world grid in turn, columns in the even places."""

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(_axis(lng, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(_axis(lat, -90.0, 180.0)), 1))


def z_ranges(xmin: float, ymin: float, xmax: float, ymax: float) -> list[tuple[int, int]]:
    """Ranges of keys (both ends included) that hold all of a window: those of the cells, at most ``ACROSS`` + 1 each way, of the
    finest grid that covers it with so many; adjoining ones are joined."""

    def at(v: float, lo: float, span: float) -> int:
        return max(0, min((1 << BITS) - 1, int((v - lo) // (span / (1 << BITS)))))

    # one cell more on each side, for the rounding of the division
    x = max(0, at(xmin, -180, 360) - 1), min((1 << BITS) - 1, at(xmax, -180, 360) + 1)
    y = max(0, at(ymin, -90, 180) - 1), min((1 << BITS) - 1, at(ymax, -90, 180) + 1)
    coarse = 0
    while max(x[1] - x[0], y[1] - y[0]) >> coarse > ACROSS:
        coarse += 1
    spread = lambda v: sum((v >> b & 1) << 2 * b for b in range(BITS))
    cells = sorted(spread(i) | spread(j) << 1 for i in range(x[0] >> coarse, (x[1] >> coarse) + 1) for j in range(y[0] >> coarse, (y[1] >> coarse) + 1))
    out: list[tuple[int, int]] = []
    for z in cells:
        lo, hi = z << 2 * coarse, ((z + 1) << 2 * coarse) - 1
        if out and out[-1][1] + 1 == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def write_features(features: DataFrame, path: str, files: int | None = None, group_bytes: int = 16 << 20) -> None:
    """Write features (xmin, xmax, ymin, ymax and others) as Parquet in the order of their keys, the box as struct ``bbox``.

    Features without a corner get no key and come last.
    """
    boxed = features.withColumn("bbox", F.struct("xmin", "xmax", "ymin", "ymax")).withColumn("z", z_key(F.col("xmin"), F.col("ymin"))).drop("xmin", "xmax", "ymin", "ymax")
    dealt = boxed.repartitionByRange(files, F.asc_nulls_last("z")) if files else boxed.repartitionByRange(F.asc_nulls_last("z"))
    dealt.sortWithinPartitions(F.asc_nulls_last("z")).write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def features_from(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Features whose least corner lies in a window (xmin, ymin, xmax, ymax), its ends included."""
    xmin, ymin, xmax, ymax = box
    keys = F.lit(False)
    for lo, hi in z_ranges(*box):
        keys = keys | F.col("z").between(lo, hi)
    return spark.read.parquet(path).where(keys).where(F.col("bbox.xmin").between(xmin, xmax) & F.col("bbox.ymin").between(ymin, ymax)).drop("z")


def features_over(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Features whose box overlaps or touches a window; row groups are told by their boxes alone, as a feature may begin far
    away."""
    xmin, ymin, xmax, ymax = box
    meets = (F.col("bbox.xmin") <= xmax) & (F.col("bbox.xmax") >= xmin) & (F.col("bbox.ymin") <= ymax) & (F.col("bbox.ymax") >= ymin)
    return spark.read.parquet(path).where(meets).drop("z")
