"""A join of properties with points near them by cells that adapt to how many points there are.

Fixed squares put a city's core under one key. Here a square that holds too many points is cut into 4 x 4 squares, these
again, three times; what is too full even then (points at one place) is dealt over numbered shares. Points lie in one leaf
and share, properties go to all leaves and shares that their window touches, so a pair meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteline.functions import geo
from siteline.operators.spatial import CELL

#: Cuts of a square, and the bits by which a cut shortens a cell's number.
LEVELS, BITS = 3, 2
#: Squares of a level that may be cut at most; the limit of a leaf is raised to all points by this number if need be.
MOST_CUT = 4096


def _fine(x: Column, size: float) -> Column:
    """The number of the smallest square along one axis; those of larger ones are its leading bits."""
    return F.floor(x / (size / (1 << BITS * LEVELS)))


def _at(fine: Column, level: int) -> Column:
    return F.shiftright(fine, BITS * (LEVELS - level))


def crowded(points: DataFrame, x: str, y: str, size: float, most: int) -> DataFrame:
    """(_l, _y, _x, _n): squares of each level with more than ``most`` points. ``points`` has fewer than ``most`` times
    MOST_CUT rows, so there are fewer than (LEVELS + 1) x MOST_CUT of them."""
    counts = points.groupBy(_fine(F.col(y), size).alias("fy"), _fine(F.col(x), size).alias("fx")).agg(F.count("*").alias("n")).where("fy is not null and fx is not null")
    levels = [F.struct(F.lit(i).alias("_l"), _at(F.col("fy"), i).alias("_y"), _at(F.col("fx"), i).alias("_x")) for i in range(LEVELS + 1)]
    return counts.select(F.inline(F.array(*levels)), "n").groupBy("_l", "_y", "_x").agg(F.sum("n").alias("_n")).where(F.col("_n") > most)


def _descend(rows: DataFrame, full: DataFrame, children) -> DataFrame:
    """Rows with a square (_cl, _cy, _cx) moved to the leaves: full squares give way to those of ``children(level)``, which are
    expressions of arrays of (_cy, _cx). ``_shares`` is the number of shares of the leaf."""
    on = (F.col("_cl") == F.col("_l")) & (F.col("_cy") == F.col("_y")) & (F.col("_cx") == F.col("_x"))
    rest = [c for c in rows.columns if c not in ("_cl", "_cy", "_cx")]
    for level in range(LEVELS):
        met = rows.join(F.broadcast(full), on, "left")
        cut = F.col("_n").isNotNull()
        ys, xs = children(level + 1)
        rows = met.select(*rest, (F.col("_cl") + cut.cast("int")).alias("_cl"), F.explode(F.when(cut, ys).otherwise(F.array("_cy"))).alias("_cy"), F.when(cut, xs).otherwise(F.array("_cx")).alias("_xs")).select(*rest, "_cl", "_cy", F.explode("_xs").alias("_cx"))
    return rows.join(F.broadcast(full), on, "left").select(*rest, "_cl", "_cy", "_cx", F.coalesce("_n", F.lit(0)).alias("_n"))


def leaves(points: DataFrame, full: DataFrame, x: str, y: str, size: float, most: int) -> DataFrame:
    """``points`` with the leaf (_fl, _fy, _fx) and the share (_fs) that each lies in; points without a place have none and go."""
    placed = points.withColumn("_py", _fine(F.col(y), size)).withColumn("_px", _fine(F.col(x), size)).where("_py is not null and _px is not null")
    first = placed.select("*", F.lit(0).alias("_cl"), _at(F.col("_py"), 0).alias("_cy"), _at(F.col("_px"), 0).alias("_cx"))
    out = _descend(first, full, lambda i: (F.array(_at(F.col("_py"), i)), F.array(_at(F.col("_px"), i))))
    share = F.pmod(F.xxhash64(*points.columns), F.greatest(F.ceil(F.col("_n") / most), F.lit(1)))
    return out.select(*points.columns, F.col("_cl").alias("_fl"), F.col("_cy").alias("_fy"), F.col("_cx").alias("_fx"), share.alias("_fs"))


def windows(props: DataFrame, full: DataFrame, delta: float, size: float, most: int) -> DataFrame:
    """Properties (lat, lng) in all leaves and shares (_cl, _cy, _cx, _cs) that their window touches."""
    ends = {"_y0": F.col("lat") - delta, "_y1": F.col("lat") + delta, "_x0": F.col("lng") - delta, "_x1": F.col("lng") + delta}
    rows = props.withColumns({c: _fine(v, size) for c, v in ends.items()})
    rows = rows.withColumn("_cl", F.lit(0)).withColumn("_cy", F.explode(F.sequence(_at(F.col("_y0"), 0), _at(F.col("_y1"), 0)))).withColumn("_cx", F.explode(F.sequence(_at(F.col("_x0"), 0), _at(F.col("_x1"), 0))))

    def touched(c: str, lo: str, hi: str, level: int) -> Column:
        first = F.shiftleft(c, BITS)
        return F.sequence(F.greatest(first, _at(F.col(lo), level)), F.least(first + ((1 << BITS) - 1), _at(F.col(hi), level)))

    out = _descend(rows, full, lambda i: (touched("_cy", "_y0", "_y1", i), touched("_cx", "_x0", "_x1", i)))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / most), F.lit(1)) - 1)).alias("_cs")
    return out.select(*props.columns, "_cl", "_cy", "_cx", shares)


def dense_join(props: DataFrame, points: DataFrame, radius_m: float, x: str, y: str, folder: str, exact: Column | None = None, most: int = 50_000) -> DataFrame:
    """The rows of ``spatial.corner_join``: properties (lat, lng) with the points (x, y) in the window of the radius that pass
    ``exact``, where no key holds more than ``most`` points but for whole rows that repeat.

    The counts of full squares are written to ``folder``, which all executors reach; they are few by construction and are
    broadcast. A leaf that many properties touch is left to Spark's splitting of skewed partitions. Rows without a
    place meet nothing; empty tables give no rows. Column names of the two must differ.
    """
    delta = geo.window_deg(radius_m)
    size = CELL * 2 * delta
    most = max(most, -(-points.count() // MOST_CUT))
    crowded(points, x, y, size, most).write.mode("overwrite").parquet(folder)
    full = props.sparkSession.read.parquet(folder)
    left, right = windows(props, full, delta, size, most), leaves(points, full, x, y, size, most)
    same = (F.col("_cl") == F.col("_fl")) & (F.col("_cy") == F.col("_fy")) & (F.col("_cx") == F.col("_fx")) & (F.col("_cs") == F.col("_fs"))
    on = same & F.col(x).between(F.col("lng") - delta, F.col("lng") + delta) & F.col(y).between(F.col("lat") - delta, F.col("lat") + delta)
    return left.join(right, on if exact is None else on & exact).drop("_cl", "_cy", "_cx", "_cs", "_fl", "_fy", "_fx", "_fs")
