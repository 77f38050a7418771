"""Spatial joins: a table of properties against tables of points, segments, boxes, polygons and grids.

Every join deals both sides out by square cells. A feature has one home cell, that of its least corner; a property goes to
all cells that its window touches. So a pair meets once, nothing has to be made distinct, and the exact test is a
condition of the join. Spark splits cells that are too full. Properties by cell are joined by shuffle: Spark doesn't count
the rows that ``explode`` makes, so it would broadcast them by the size of the table before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteline.functions import geo

#: Cell side in windows.
CELL = 1.25


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are worked out once for each row. A plain column is written out at each of its uses, in filters and
    conditions of joins before it too; what uses a few of them many times gets code of a length that the JVM doesn't compile."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def _span(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(lo, size), _cell(hi, size)))


def _windowed(props: DataFrame, delta: float, size: float) -> DataFrame:
    """Properties in all cells that their window touches."""
    out = props.withColumn("_cy", _span(F.col("lat") - delta, F.col("lat") + delta, size))
    return out.withColumn("_cx", _span(F.col("lng") - delta, F.col("lng") + delta, size)).hint("merge")


def corner_join(props: DataFrame, feats: DataFrame, radius_m: float, x: str, y: str, exact: Column | None = None) -> DataFrame:
    """Properties (lat, lng) with the features whose least corner (x, y) lies in the window of the radius, ends included,
    and that pass ``exact``. Column names of the two must differ."""
    delta = geo.window_deg(radius_m)
    size = CELL * 2 * delta
    left = _windowed(props, delta, size)
    right = feats.withColumn("_fy", _cell(F.col(y), size)).withColumn("_fx", _cell(F.col(x), size))
    on = (F.col("_cy") == F.col("_fy")) & (F.col("_cx") == F.col("_fx")) & F.col(x).between(F.col("lng") - delta, F.col("lng") + delta) & F.col(y).between(F.col("lat") - delta, F.col("lat") + delta)
    return left.join(right, on if exact is None else on & exact).drop("_cy", "_cx", "_fy", "_fx")


def near_points(props: DataFrame, points: DataFrame, radius_m: float, x: str, y: str, metric: str = "isotropic") -> DataFrame:
    """Pairs closer than the radius, with ``dist_m``."""
    dist = (geo.dist_isotropic if metric == "isotropic" else geo.dist_anisotropic)(F.col("lat"), F.col("lng"), F.col(y), F.col(x))
    return corner_join(props, points, radius_m, x, y, dist < radius_m).withColumn("dist_m", dist)


def near_segments(props: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of a property and a segment (x1, y1, x2, y2, least corner xmin, ymin) closer than the radius, with
    ``dist_m`` and the nearest point (near_lng, near_lat)."""
    lat, lng, x1, y1, x2, y2 = map(F.col, ("lat", "lng", "x1", "y1", "x2", "y2"))
    pairs = corner_join(props, segments, radius_m, "xmin", "ymin")
    t = F.col("_t")
    pairs = worked_out(pairs, _t=geo.along_segment(lat, lng, x1, y1, x2, y2))
    px, py = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
    out = pairs.withColumn("near_lng", px).withColumn("near_lat", py).withColumn("dist_m", geo.dist_isotropic(lat, lng, py, px))
    return out.where(F.col("dist_m") < radius_m).drop("_t")


def overlapping(props: DataFrame, feats: DataFrame, radius_m: float, strict: bool = True, most_cells: int = 4096) -> DataFrame:
    """Pairs whose feature box (xmin, xmax, ymin, ymax) overlaps the window of the radius.

    Features go to all cells that they touch, and a pair counts only in the cell that holds the least corner of the
    overlap. A feature over more than ``most_cells`` cells (an ocean) goes to coarser cells, so its rows stay bounded.
    """
    delta = geo.window_deg(radius_m)
    lat, lng = F.col("lat"), F.col("lng")
    meets = (F.col("xmin") < lng + delta) & (F.col("xmax") > lng - delta) & (F.col("ymin") < lat + delta) & (F.col("ymax") > lat - delta)
    if not strict:
        meets = (F.col("xmin") <= lng + delta) & (F.col("xmax") >= lng - delta) & (F.col("ymin") <= lat + delta) & (F.col("ymax") >= lat - delta)
    size = CELL * 2 * delta
    coarse = size * 64
    cells = (F.floor((F.col("xmax") - F.col("xmin")) / size) + 2) * (F.floor((F.col("ymax") - F.col("ymin")) / size) + 2)
    parts = []
    for step, some in ((size, cells <= most_cells), (coarse, cells > most_cells)):
        left = _windowed(props, delta, step)
        right = feats.where(some).withColumn("_fy", _span(F.col("ymin"), F.col("ymax"), step)).withColumn("_fx", _span(F.col("xmin"), F.col("xmax"), step))
        home = (F.col("_cx") == _cell(F.greatest(F.col("xmin"), lng - delta), step)) & (F.col("_cy") == _cell(F.greatest(F.col("ymin"), lat - delta), step))
        parts.append(left.join(right, (F.col("_cy") == F.col("_fy")) & (F.col("_cx") == F.col("_fx")) & home & meets).drop("_cy", "_cx", "_fy", "_fx"))
    return parts[0].unionByName(parts[1])


#: Cells of polygon covers are shifted by this many degrees, so that no round coordinate lies on a border.
SHIFT = 0.0031415926535


def _cover_cell(x: Column, cell: float) -> Column:
    return F.floor((x + SHIFT) / cell)


def _east(cx: Column, cell: float) -> Column:
    """The eastern border of a column of cells; of a row, the northern one."""
    return (cx + 1) * cell - SHIFT


def edge_cells(edges: DataFrame, cell: float, margin_y: Column | float = 0.0, margin_x: Column | float = 0.0) -> DataFrame:
    """Edges (x1, y1, x2, y2) in each cell (_fy, _fx) that they cross or come near to, within margins in degrees.

    An edge is cut by rows of cells first and goes to the columns of its part in a row, so a long one has as many rows as
    cells on its way, not as cells of its box.
    """
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    my, mx = (m if isinstance(m, Column) else F.lit(m) for m in (margin_y, margin_x))
    out = edges.withColumn("_fy", F.explode(F.sequence(_cover_cell(F.least(y1, y2) - my, cell), _cover_cell(F.greatest(y1, y2) + my, cell))))
    lo, hi = F.greatest(F.least(y1, y2), _east(F.col("_fy") - 1, cell) - my), F.least(F.greatest(y1, y2), _east(F.col("_fy"), cell) + my)
    at = lambda y: F.when(y1 == y2, x1).otherwise(x1 + (x2 - x1) * (y - y1) / F.when(y1 == y2, F.lit(1.0)).otherwise(y2 - y1))
    ends = [at(lo), F.when(y1 == y2, x2).otherwise(at(hi))]
    slack = 1e-9  # degrees, for the rounding of the cut
    west, east = F.greatest(F.least(*ends) - slack, F.least(x1, x2)) - mx, F.least(F.greatest(*ends) + slack, F.greatest(x1, x2)) + mx
    return out.withColumn("_fx", F.explode(F.sequence(_cover_cell(west, cell), _cover_cell(F.greatest(west, east), cell))))


def near_rays(rays: DataFrame, points: DataFrame, x: str, y: str, margin_m: float, exact: Column, cell_m: float = 200.0) -> DataFrame:
    """Rays (x1, y1, x2, y2, and k: metres of a degree of longitude) with the points (x, y) up to ``margin_m`` off their way
    that pass ``exact``, which may use the ray's and the point's way from the ray's start in metres (_dx, _dy and _bx, _by; they are
    returned). A ray walks over the cells that it crosses and a point, of which there are far fewer, goes to the cells
    within the margin; a pair counts in the cell of the ray's place nearest to the point, so pairs meet once and only points
    along the way are looked at. Column names of the two must differ."""
    cell = cell_m / geo.M_PER_DEG
    wide = (margin_m + 2.0) / geo.M_PER_DEG  # two metres more: k is taken at one latitude
    reach = lambda c, m: F.explode(F.sequence(_cover_cell(c - m, cell), _cover_cell(c + m, cell)))
    left = edge_cells(rays, cell)
    right = points.withColumn("_py", reach(F.col(y), F.lit(wide))).withColumn("_px", reach(F.col(x), wide / F.cos(F.radians(y))))
    # a cell holds what stands on some hundred metres square, so the points' side can be hashed; the many rays aren't sorted
    right = right.hint("shuffle_hash")
    x1, y1, x2, y2, dx, dy, bx, by = map(F.col, ("x1", "y1", "x2", "y2", "_dx", "_dy", "_bx", "_by"))
    pairs = left.join(right, (F.col("_fy") == F.col("_py")) & (F.col("_fx") == F.col("_px")))
    pairs = worked_out(pairs, _dx=(x2 - x1) * F.col("k"), _dy=(y2 - y1) * geo.M_PER_DEG, _bx=(F.col(x) - x1) * F.col("k"), _by=(F.col(y) - y1) * geo.M_PER_DEG)
    length = dx * dx + dy * dy
    t = (bx * dx + by * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length)
    found = worked_out(pairs.where(exact), _t=F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))
    at = lambda a, b: F.least(F.greatest(a + F.col("_t") * (b - a), F.least(a, b)), F.greatest(a, b))
    home = (F.col("_fy") == _cover_cell(at(y1, y2), cell)) & (F.col("_fx") == _cover_cell(at(x1, x2), cell))
    return found.where(home).drop("_fy", "_fx", "_py", "_px", "_t")


def polygon_cover(edges: DataFrame, key: str, keep: list[str], cell: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Cells of polygons given by the edges of their rings: (edges by crossed cell, inner cells).

    The first has the edges in each cell that they cross, with ``_odd``: whether the cell's north-eastern corner is inside.
    The second has the cells that are inside as a whole. Corners are told by a scan along the northern border of each row of
    cells: a corner is inside if an odd number of edges crosses the border east of it. There are as many rows as
    edges cross cells, and as cells are covered.
    """
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    by = [key, *keep]
    crossed = edge_cells(edges.select(*by, "x1", "y1", "x2", "y2"), cell)
    north = _east(F.col("_fy"), cell)
    # an edge crosses a row's northern border once, in the column of that place, whatever other cells of the row it crosses
    meets = (y1 > north) != (y2 > north)
    place = _cover_cell((x2 - x1) * (north - y1) / F.when(y1 == y2, F.lit(1.0)).otherwise(y2 - y1) + x1, cell)
    borders = edges.select(*by, "x1", "y1", "x2", "y2").withColumn("_fy", F.explode(F.sequence(_cover_cell(F.least(y1, y2), cell) - 1, _cover_cell(F.greatest(y1, y2), cell)))).where(meets)
    cells = crossed.select(*by, "_fy", "_fx", F.lit(0).alias("n")).unionByName(borders.select(*by, "_fy", place.alias("_fx"), F.lit(1).alias("n")))
    cells = cells.groupBy(*by, "_fy", "_fx").agg(F.sum("n").alias("n"))
    row = Window.partitionBy(*by, "_fy").orderBy(F.desc("_fx"))
    cells = cells.withColumn("_odd", F.coalesce(F.sum("n").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1).withColumn("_next", F.lead("_fx").over(row))
    inner = cells.where((F.col("_odd") != (F.col("n") % 2 == 1)) & (F.col("_next") < F.col("_fx") - 1))
    inner = inner.select(*by, "_fy", F.explode(F.sequence(F.col("_next") + 1, F.col("_fx") - 1)).alias("_fx"))
    of = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_fy") == F.col("_ry"), F.col("_fx") == F.col("_rx")]
    corners = cells.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_fy").alias("_ry"), F.col("_fx").alias("_rx"), "_odd")
    return crossed.join(corners, of).drop("_ry", "_rx", *(f"_k_{c}" for c in by)), inner


def inside(props: DataFrame, edges: DataFrame, key: str, keep: list[str], cell: float = 0.05) -> DataFrame:
    """(property_id, key, keep...) of the polygons that hold a property, given by the edges of their rings; of overlapping
    rings, what an odd number of them holds.

    A property in an inner cell is inside. In a crossed cell its way to the cell's north-eastern corner, east and then north,
    meets edges of that cell only; each changes sides.
    """
    lat, lng, x1, y1, x2, y2 = map(F.col, ("lat", "lng", "x1", "y1", "x2", "y2"))
    border, inner = polygon_cover(edges, key, keep, cell)
    left = props.withColumn("_cy", _cover_cell(lat, cell)).withColumn("_cx", _cover_cell(lng, cell)).hint("merge")
    here = (F.col("_cy") == F.col("_fy")) & (F.col("_cx") == F.col("_fx"))
    east, north = _east(F.col("_cx"), cell), _east(F.col("_cy"), cell)
    eastward = geo.crosses_ray(lat, lng, x1, y1, x2, y2) & ~geo.crosses_ray(lat, east, x1, y1, x2, y2)
    at = (y2 - y1) * (east - x1) / F.when(x1 == x2, F.lit(1.0)).otherwise(x2 - x1) + y1
    northward = ((x1 > east) != (x2 > east)) & ((lat < at) != (north < at))
    by = ["property_id", key, *keep]
    met = left.join(border, here).groupBy(*by, "_odd").agg(F.sum(eastward.cast("int") + northward.cast("int")).alias("_n"))
    found = met.where((F.col("_n") % 2 == 1) != F.col("_odd")).select(*by)
    return found.unionByName(left.join(inner, here).select(*by))


def near_polygons(props: DataFrame, edges: DataFrame, key: str, radius_m: float, keep: list[str], cell: float = 0.05) -> DataFrame:
    """(property_id, key, keep..., dist_m) of polygons closer than the radius whose box (xmin, xmax, ymin, ymax) overlaps the
    window, given by the edges of their rings; the distance is 0 inside. Up to 60 degrees of latitude."""
    delta = geo.window_deg(radius_m)
    lat, lng, x1, y1, x2, y2 = map(F.col, ("lat", "lng", "x1", "y1", "x2", "y2"))
    t = geo.along_segment(lat, lng, x1, y1, x2, y2)
    dist = geo.dist_isotropic(lat, lng, y1 + t * (y2 - y1), x1 + t * (x2 - x1))
    boxes = ["xmin", "xmax", "ymin", "ymax"]
    meets = (F.col("_xmin") <= lng + delta) & (F.col("_xmax") >= lng - delta) & (F.col("_ymin") <= lat + delta) & (F.col("_ymax") >= lat - delta)
    own = edges.select(key, *keep, "x1", "y1", "x2", "y2", *(F.col(c).alias(f"_{c}") for c in boxes))
    own = own.withColumns({"xmin": F.least(x1, x2), "xmax": F.greatest(x1, x2), "ymin": F.least(y1, y2), "ymax": F.greatest(y1, y2)})
    # a degree of longitude at 60 degrees is half as long, so edges are looked for in a wider window than the polygon's box
    pairs = overlapping(props, own, radius_m * 1.35, strict=False).where(meets).withColumn("dist_m", dist).where(F.col("dist_m") < radius_m)
    near = pairs.select("property_id", key, *keep, "dist_m").unionByName(inside(props, edges, key, keep, cell).withColumn("dist_m", F.lit(0.0)))
    return near.groupBy("property_id", key, *keep).agg(F.min("dist_m").alias("dist_m"))


def nearest_cell(props: DataFrame, grid: DataFrame, max_dist_m: float, corrected: bool, keep: list[str], order: list[str]) -> DataFrame:
    """Each property's nearest grid point (g_lat, g_lng) closer than the limit, with ``keep`` and ``dist_m``; properties
    without one are left out. ``corrected`` scales longitude by the cosine; ties go by ``order``."""
    limit = max_dist_m / geo.M_PER_DEG
    size = limit * 1.5
    lat, lng = F.col("lat"), F.col("lng")
    dlat, dlng = F.abs(F.col("g_lat") - lat), F.abs(F.col("g_lng") - lng)
    scale = F.cos(F.radians(lat)) if corrected else F.lit(1.0)
    dist = F.sqrt(dlat * dlat + dlng * scale * (dlng * scale))
    right = grid.withColumn("_fy", _cell(F.col("g_lat"), size)).withColumn("_fx", _cell(F.col("g_lng"), size))
    on = (F.col("_cy") == F.col("_fy")) & (F.col("_cx") == F.col("_fx")) & (dlat <= limit) & (dlng <= limit * 1.5) & (dist < limit)
    pairs = _windowed(props, size, size).join(right, on).withColumn("_d", dist)
    first = F.min_by(F.struct(*keep, "_d"), F.struct("_d", *order)).alias("_row")
    out = pairs.groupBy("property_id").agg(first)
    return out.select("property_id", *[F.col(f"_row.{k}").alias(k) for k in keep], (F.col("_row._d") * geo.M_PER_DEG).alias("dist_m"))


def sample_cells(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """Sample points (row, col) with the raster's value; outside the raster it is null."""
    return samples.join(cells.select("row", "col", "value").hint("merge"), ["row", "col"], "left")


def nearest_by_group(pairs: DataFrame, by: list[str], dist: str, keep: list[str], radius_m: float, tie: list[str]) -> DataFrame:
    """The nearest row of each group, if closer than the radius, ties by ``tie``."""
    best = pairs.groupBy(*by).agg(F.min_by(F.struct(dist, *keep), F.struct(dist, *tie)).alias("_row"))
    return best.select(*by, "_row.*").where(F.col(dist) < radius_m)
