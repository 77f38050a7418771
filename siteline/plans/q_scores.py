"""Walkability, solar, flood, bushfire, heat, view and contamination scores, and the aggregates they are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.functions import geo, ladders, places
from siteline.operators import raster, spatial
from siteline.plans import nearby
from siteline.plans.q_nearby import (
    CONTOUR_SQL, FIRE_ORDER, FIRE_RANK, FLOOD_ORDER, FLOOD_RANK, MDEG, R4, epa_sql, inside_sql, near_buildings_sql, near_pois_sql,
    near_segments_sql, near_water_sql, overlay_hits, register_sites, state_sql, worst_contour, worst_overlay, worst_sql,
)
from siteline.registry import query
from siteline.sources.views import duckdb_ctes, view


def sql_any(c: str, words: list[str]) -> str:
    return f"coalesce(regexp_matches(lower({c}), '{'|'.join(words)}'), false)"


GROUP_SQL = "CASE " + " ".join(f"WHEN regexp_matches(replace(lower(category), ' ', '_'), '{'|'.join(w)}') THEN '{g}'" for g, w in places.WALK_GROUPS.items()) + " END"


def label_sql(kind: str, c: str = "score") -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} >= {b} THEN {q(t)}" for b, t in ladders.LABELS[kind] if b is not None) + f" ELSE {q(ladders.LABELS[kind][-1][1])} END"


def ladder_sql(c: str, below: list[tuple[float, object]], rest: object) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} < {b} THEN {v}" for b, v in below) + f" ELSE {rest} END"


def _props(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_properties")


# -- raster samples -------------------------------------------------------------------------------------------------

#: The derived raster covers 0.001 degree cells from this corner.
RASTER_LAT, RASTER_LNG, RASTER_STEP = -37.9, 144.9, 0.001


def offset_samples(props: DataFrame, offsets: list[tuple[float, float]]) -> DataFrame:
    """Each property with its sample points: i, s_lat, s_lng for offsets of (lat, lng) degrees."""
    points = F.posexplode(F.array(*[F.struct(F.lit(float(a)).alias("dy"), F.lit(float(b)).alias("dx")) for a, b in offsets])).alias("i", "o")
    return props.select("property_id", "lat", "lng", points).select("property_id", "lat", "lng", "i", (F.col("lat") + F.col("o.dy")).alias("s_lat"), (F.col("lng") + F.col("o.dx")).alias("s_lng"))


def raster_at(samples: DataFrame, raster: DataFrame, lat0: float = RASTER_LAT, lng0: float = RASTER_LNG, step: float = RASTER_STEP) -> DataFrame:
    """``samples`` with the value of the cell nearest to each; null outside the raster."""
    cell = lambda x, x0: F.floor((x - x0) / step + 0.5).cast("int")
    return spatial.sample_cells(samples.withColumn("row", cell(F.col("s_lat"), lat0)).withColumn("col", cell(F.col("s_lng"), lng0)), raster)


def offsets_sql(name: str, offsets: list[tuple[float, float]]) -> str:
    """CTE: samples of all properties with the raster's values."""
    rows = ", ".join(f"({i}, {a!r}::double, {b!r}::double)" for i, (a, b) in enumerate(offsets))
    return f"""{name} AS (SELECT s.*, r.value FROM (SELECT property_id, lat, lng, i, cast(floor((lat + dy - -37.9::double) / 0.001::double + 0.5::double) AS INT) AS row, cast(floor((lng + dx - 144.9::double) / 0.001::double + 0.5::double) AS INT) AS col
  FROM v_properties CROSS JOIN (VALUES {rows}) o(i, dy, dx)) s LEFT JOIN v_raster r ON s.row = r.row AND s.col = r.col)"""


WATER_GRID = [(dy * 0.001, dx * 0.001) for dy in range(-5, 6) for dx in range(-5, 6)]
COVER_GRID = [(dy * 0.001, dx * 0.001) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
CROSS = [(0.0, 0.0), (0.0045, 0.0), (-0.0045, 0.0), (0.0, 0.0045), (0.0, -0.0045)]
RINGS = [(0.0, 0.0)] + [(a * off, b * off) for off in (0.0045, 0.018) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))]
NEIGHBOURS5 = [(dy * 0.009, dx * 0.009) for dy in range(-2, 3) for dx in range(-2, 3)]


@query("neighbourhood_offsets", duckdb_ctes("v_properties") + ", o AS (SELECT row_number() OVER () - 1 AS i, * FROM (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) ORDER BY dy, dx)) SELECT property_id, cast(i AS INT) AS i, round_even(lat + dy * 0.001::double, 7) AS s_lat, round_even(lng + dx * 0.001::double, 7) AS s_lng FROM v_properties, o")
def neighbourhood_offsets(spark: SparkSession, d: str) -> DataFrame:
    return offset_samples(_props(spark, d), COVER_GRID).select("property_id", "i", R4("s_lat", 7), R4("s_lng", 7))


@query("join_raster_samples", duckdb_ctes("v_properties", "v_raster") + ",\n" + offsets_sql("s", CROSS) + "\nSELECT property_id, cast(i AS INT) AS i, value FROM s")
def join_raster_samples(spark: SparkSession, d: str) -> DataFrame:
    return raster_at(offset_samples(_props(spark, d), CROSS), view(spark, d, "v_raster")).select("property_id", "i", "value")


def tile_samples(props: DataFrame, raster_tiles: DataFrame, offsets: list[tuple[float, float]]) -> DataFrame:
    """(property_id, lat, lng, samples): each property with an array of samples, from the one tile that it lies in."""
    return raster.around(props.select("property_id", "lat", "lng"), raster_tiles, offsets, RASTER_LAT, RASTER_LNG, RASTER_STEP)


def water_cells(sampled: DataFrame) -> DataFrame:
    """(property_id, max_occ, mean_occ, nearest_m, wet, flood) of arrays of 11 x 11 occurrence samples; 1 to 100 counts as
    wet."""
    rows = sampled.withColumn("_wet", F.filter("samples", lambda x: x["value"].between(1, 100)))
    scale = geo.lng_scale(F.col("lat"))

    def metres(x: F.Column) -> F.Column:
        dy, dx = (x["s_lat"] - F.col("lat")) * geo.M_PER_DEG, (x["s_lng"] - F.col("lng")) * scale
        return F.sqrt(dx * dx + dy * dy)

    wet, n = F.col("_wet"), F.size("_wet")
    return rows.select(
        "property_id",
        F.coalesce(F.array_max(F.transform(wet, lambda x: x["value"])), F.lit(0.0)).alias("max_occ"),
        F.coalesce(F.bround(F.aggregate(wet, F.lit(0.0), lambda s, x: s + x["value"]) / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("mean_occ"),
        F.bround(F.array_min(F.transform(wet, metres))).alias("nearest_m"),
        n.cast("long").alias("wet"),
        F.size(F.filter(wet, lambda x: x["value"] <= 90)).cast("long").alias("flood"),
    )


WATER_CELLS_SQL = offsets_sql("ws", WATER_GRID) + f""",
wc AS (SELECT property_id, coalesce(max(CASE WHEN value BETWEEN 1 AND 100 THEN value END), 0.0::double) AS max_occ, coalesce(round_even(avg(CASE WHEN value BETWEEN 1 AND 100 THEN value END), 1), 0.0::double) AS mean_occ,
  round_even(min(CASE WHEN value BETWEEN 1 AND 100 THEN sqrt(((i // 11 - 5) * 0.001::double * 111320.0::double) ** 2 + ((i % 11 - 5) * 0.001::double * {MDEG.replace('p.', '')}) ** 2) END), 0) AS nearest_m,
  count(*) FILTER (value BETWEEN 1 AND 100) AS wet, count(*) FILTER (value BETWEEN 1 AND 90) AS flood FROM ws GROUP BY property_id)"""


@query("water_cells", duckdb_ctes("v_properties", "v_raster") + ",\n" + WATER_CELLS_SQL + "\nSELECT * FROM wc")
def q_water_cells(spark: SparkSession, d: str) -> DataFrame:
    return water_cells(tile_samples(_props(spark, d), _tiles(spark, d), WATER_GRID))


def dominant_class(sampled: DataFrame, classes: Callable[[F.Column], F.Column]) -> DataFrame:
    """(property_id, cover, has_trees): the most frequent of the samples' ``classes``, the first in scan order at a tie."""
    rows = sampled.select("property_id", F.filter(F.transform("samples", lambda x: classes(x["value"])), lambda v: v.isNotNull()).alias("v")).where(F.size("v") > 0)
    counts = F.transform(F.array_distinct("v"), lambda v: F.struct(F.size(F.filter("v", lambda w: w == v)).alias("n"), (-F.array_position("v", v)).alias("first"), v.alias("v")))
    return rows.select("property_id", F.array_max(counts)["v"].cast("int").alias("cover"), F.array_contains("v", 10).alias("has_trees"))


#: Classes of land cover from the derived raster: its values in steps of ten.
COVER_SQL = offsets_sql("cs", COVER_GRID) + """,
cc AS (SELECT property_id, floor(value / 10) * 10 AS v, count(*) AS n, min(i) AS first FROM cs WHERE value IS NOT NULL GROUP BY 1, 2),
dc AS (SELECT property_id, cast(arg_max(v, n * 100 - first) AS INT) AS cover, bool_or(v = 10) AS has_trees FROM cc GROUP BY property_id)"""


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return raster.tiles(view(spark, d, "v_raster"))


def _cover(spark: SparkSession, d: str) -> DataFrame:
    return dominant_class(tile_samples(_props(spark, d), _tiles(spark, d), COVER_GRID), lambda v: F.floor(v / 10) * 10)


@query("dominant_class", duckdb_ctes("v_properties", "v_raster") + ",\n" + COVER_SQL + "\nSELECT * FROM dc")
def q_dominant_class(spark: SparkSession, d: str) -> DataFrame:
    return _cover(spark, d)


def slope_grid(cells: DataFrame, res_y: float, res_x: float) -> DataFrame:
    """``cells`` (grid_id, row, col, value) with the slope in degrees: central differences, one-sided at the edges."""
    def along(by: str, across: str, res: float) -> F.Column:
        w = Window.partitionBy("grid_id", across).orderBy(by)
        prev, nxt = F.lag("value").over(w), F.lead("value").over(w)
        steps = F.when(prev.isNotNull(), 1).otherwise(0) + F.when(nxt.isNotNull(), 1).otherwise(0)
        return (F.coalesce(nxt, F.col("value")) - F.coalesce(prev, F.col("value"))) / F.when(steps > 0, steps * res)
    gy, gx = along("row", "col", res_y), along("col", "row", res_x)
    return cells.withColumn("gy", gy).withColumn("gx", gx).withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))))


SLOPE_SQL = """sl AS (SELECT row, col, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM (
  SELECT *, (coalesce(lead(value) OVER y, value) - coalesce(lag(value) OVER y, value)) / ((CASE WHEN lag(value) OVER y IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(value) OVER y IS NULL THEN 0 ELSE 1 END) * 111.32::double) AS gy,
    (coalesce(lead(value) OVER x, value) - coalesce(lag(value) OVER x, value)) / ((CASE WHEN lag(value) OVER x IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(value) OVER x IS NULL THEN 0 ELSE 1 END) * 87.8::double) AS gx
  FROM v_raster WINDOW y AS (PARTITION BY row // 250, col ORDER BY row), x AS (PARTITION BY col // 250, row ORDER BY col)))"""


def _slopes(spark: SparkSession, d: str) -> DataFrame:
    box = F.expr("row div 250 * 1000000 + col div 250")  # boxes lie 250 cells apart
    return slope_grid(view(spark, d, "v_raster").withColumn("grid_id", box), 111.32, 87.8)


@query("slope_grid", duckdb_ctes("v_raster") + ",\n" + SLOPE_SQL + "\nSELECT row, col, round_even(slope, 4) AS slope FROM sl")
def q_slope_grid(spark: SparkSession, d: str) -> DataFrame:
    return _slopes(spark, d).select("row", "col", R4("slope", 4))


# -- walkability ----------------------------------------------------------------------------------------------------


def category_nearest(pois: DataFrame) -> DataFrame:
    """(property_id, grp, dist_m, n): nearest distance and number of places of each group."""
    rows = pois.withColumn("grp", places.match_group(F.col("category"))).where("grp is not null")
    return rows.groupBy("property_id", "grp").agg(F.min("dist_m").alias("dist_m"), F.count("*").alias("n"))


NEAREST_SQL = near_pois_sql("np", 1500) + f",\ncn AS (SELECT property_id, grp, min(dist_m) AS dist_m, count(*) AS n FROM (SELECT *, {GROUP_SQL} AS grp FROM np) WHERE grp IS NOT NULL GROUP BY 1, 2)"


@query("category_nearest_count", duckdb_ctes("v_properties", "v_pois") + ",\n" + NEAREST_SQL + "\nSELECT property_id, grp, round_even(dist_m, 3) AS dist_m, n FROM cn")
def category_nearest_count(spark: SparkSession, d: str) -> DataFrame:
    return category_nearest(nearby.places(_props(spark, d), view(spark, d, "v_pois"))).select("property_id", "grp", R4("dist_m"), "n")


def crossed(nearest: DataFrame, barriers: DataFrame, penalty: float = 2.5) -> DataFrame:
    """``nearest`` with eff_m: the distance times the penalty where a barrier's distance lies within 15 to 85 % of it."""
    b = barriers.select(F.col("property_id").alias("b_id"), F.col("dist_m").alias("b_m"))
    on = (F.col("property_id") == F.col("b_id")) & (F.col("b_m") > F.col("dist_m") * 0.15) & (F.col("b_m") < F.col("dist_m") * 0.85) & (F.col("dist_m") >= 100)
    hit = nearest.join(b, on, "left_semi").select("property_id", "grp", F.lit(True).alias("crossed"))
    out = nearest.join(hit, ["property_id", "grp"], "left")
    return out.withColumn("crossed", F.coalesce("crossed", F.lit(False))).withColumn("eff_m", F.when(F.col("crossed"), F.col("dist_m") * penalty).otherwise(F.col("dist_m")))


BARRIER_SQL = near_segments_sql("nb", 1500, "(SELECT * FROM v_roads WHERE subtype = 'road' AND class IN ('motorway', 'trunk'))", "class") + """,
cr AS (SELECT cn.*, coalesce(x.c, false) AS crossed, CASE WHEN coalesce(x.c, false) THEN cn.dist_m * 2.5::double ELSE cn.dist_m END AS eff_m
  FROM cn LEFT JOIN (SELECT DISTINCT cn.property_id, cn.grp, true AS c FROM cn JOIN nb ON cn.property_id = nb.property_id AND cn.dist_m >= 100 AND nb.dist_m > cn.dist_m * 0.15::double AND nb.dist_m < cn.dist_m * 0.85::double) x ON cn.property_id = x.property_id AND cn.grp = x.grp)"""


def _crossed(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    barriers = nearby.roads(props, view(spark, d, "v_roads").where(F.col("class").isin("motorway", "trunk")), 1500)
    return crossed(category_nearest(nearby.places(props, view(spark, d, "v_pois"))), barriers)


@query("barrier_penalty", duckdb_ctes("v_properties", "v_pois", "v_roads") + ",\n" + NEAREST_SQL + ",\n" + BARRIER_SQL + "\nSELECT property_id, grp, crossed, round_even(eff_m, 3) AS eff_m FROM cr")
def barrier_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _crossed(spark, d).select("property_id", "grp", "crossed", R4("eff_m"))


def mean_rise(samples: DataFrame) -> DataFrame:
    """(property_id, rise): mean absolute rise from the centre (i = 0) to the other samples."""
    centre = F.max(F.when(F.col("i") == 0, F.col("value")))
    others = F.collect_list(F.when(F.col("i") > 0, F.col("value")))
    out = samples.groupBy("property_id").agg(centre.alias("c"), others.alias("o"))
    total = F.aggregate("o", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("c")))
    return out.select("property_id", F.when((F.size("o") > 0) & F.col("c").isNotNull(), total / F.size("o")).alias("rise"))


RISE_SQL = offsets_sql("rs", CROSS) + ",\nmr AS (SELECT s.property_id, avg(abs(s.value - c.value)) AS rise FROM (SELECT * FROM rs WHERE i > 0) s JOIN (SELECT * FROM rs WHERE i = 0) c ON s.property_id = c.property_id GROUP BY 1)"


@query("slope_multiplier", duckdb_ctes("v_properties", "v_raster") + ",\n" + RISE_SQL + "\nSELECT property_id, round_even(rise, 3) AS rise, coalesce(" + ladder_sql("rise / 500 * 100", [(3, "1.0::double"), (6, "0.9::double"), (10, "0.75::double")], "0.6::double") + ", 1.0::double) AS mult FROM mr")
def slope_multiplier(spark: SparkSession, d: str) -> DataFrame:
    r = mean_rise(raster_at(offset_samples(_props(spark, d), CROSS), view(spark, d, "v_raster")))
    return r.select("property_id", R4("rise"), ladders.slope_multiplier(F.col("rise")).alias("mult"))


def score_walkability(props: DataFrame, pois: DataFrame, roads: DataFrame, elevation: DataFrame | None = None, radius_m: float = 1500) -> DataFrame:
    """(property_id, score, label, raw_score, slope_mult, poi_count, groups, barriers_crossed) of every property.

    ``elevation`` holds samples (property_id, i, value) around the properties; without it all ground counts as flat.
    """
    near = nearby.places(props, pois, radius_m)
    barriers = nearby.roads(props, roads.where(F.col("class").isin("motorway", "trunk")), radius_m)
    rows = crossed(category_nearest(near), barriers).withColumn("w", F.element_at(F.create_map(*[F.lit(x) for k, v in places.WALK_WEIGHTS.items() for x in (k, v)]), F.col("grp")))
    total = sum(places.WALK_WEIGHTS.values())
    by = rows.groupBy("property_id").agg(F.sum(F.col("w") * ladders.walk_decay(F.col("eff_m"), F.col("n"))).alias("s"), F.count("*").alias("groups"), F.count_if("crossed").alias("barriers_crossed"))
    out = nearby.beside(nearby.keyed(props).select("property_id"), by, near.groupBy("property_id").agg(F.count("*").alias("poi_count")))
    rise = mean_rise(elevation) if elevation is not None else props.select("property_id", F.lit(None).cast("double").alias("rise"))
    out = nearby.beside(out, rise).withColumn("slope_mult", ladders.slope_multiplier(F.col("rise")))
    out = out.withColumn("raw_score", F.bround(F.bround(F.coalesce("s", F.lit(0.0)) / total * 100, 9)).cast("int"))
    out = out.withColumn("score", ladders.clamp(F.bround(F.col("raw_score") * F.col("slope_mult"), 9)))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("property_id", "score", ladders.label("walkability", F.col("score")).alias("label"), "raw_score", "slope_mult", n("poi_count"), n("groups"), n("barriers_crossed"))


WEIGHT_SQL = "CASE grp " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in places.WALK_WEIGHTS.items()) + " END"
DECAY_SQL = "CASE WHEN eff_m < 1500 THEN 1 - eff_m / 1500.0::double ELSE 0.0::double END * CASE WHEN n <= 1 THEN 0.7::double WHEN n <= 2 THEN 0.85::double ELSE 1.0::double END"
WALK_SQL = f"""{NEAREST_SQL},\n{BARRIER_SQL},\n{RISE_SQL},
wk AS (SELECT p.property_id, cast(round_even(round_even(coalesce(s, 0.0::double) / {sum(places.WALK_WEIGHTS.values())}::double * 100, 9), 0) AS INT) AS raw_score,
  coalesce({ladder_sql('rise / 500 * 100', [(3, '1.0::double'), (6, '0.9::double'), (10, '0.75::double')], '0.6::double')}, 1.0::double) AS slope_mult, coalesce(c.poi_count, 0) AS poi_count, coalesce(g, 0) AS groups, coalesce(b, 0) AS barriers_crossed
  FROM v_properties p LEFT JOIN (SELECT property_id, sum({WEIGHT_SQL} * {DECAY_SQL}) AS s, count(*) AS g, count(*) FILTER (crossed) AS b FROM cr GROUP BY 1) q ON p.property_id = q.property_id
  LEFT JOIN (SELECT property_id, count(*) AS poi_count FROM np GROUP BY 1) c ON p.property_id = c.property_id LEFT JOIN mr ON p.property_id = mr.property_id),
walk AS (SELECT *, cast(greatest(0, least(100, round_even(round_even(raw_score * slope_mult, 9), 0))) AS INT) AS score FROM wk)"""


def walk(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    return score_walkability(props, view(spark, d, "v_pois"), view(spark, d, "v_roads"), raster_at(offset_samples(props, CROSS), view(spark, d, "v_raster")))


@query("score_walkability", duckdb_ctes("v_properties", "v_pois", "v_roads", "v_raster") + ",\n" + WALK_SQL + f"\nSELECT property_id, score, {label_sql('walkability')} AS label, raw_score, slope_mult, poi_count, groups, barriers_crossed FROM walk")
def q_score_walkability(spark: SparkSession, d: str) -> DataFrame:
    return walk(spark, d)


@query("walk_decay", duckdb_ctes("v_properties", "v_pois", "v_roads") + ",\n" + NEAREST_SQL + ",\n" + BARRIER_SQL + f"\nSELECT property_id, grp, n, round_even({DECAY_SQL}, 4) AS decay FROM cr")
def walk_decay(spark: SparkSession, d: str) -> DataFrame:
    return _crossed(spark, d).select("property_id", "grp", "n", F.bround(ladders.walk_decay(F.col("eff_m"), F.col("n")), 4).alias("decay"))


# -- solar ----------------------------------------------------------------------------------------------------------

ORIENTATION = {"optimal": 1.0, "east": 0.85, "west": 0.85, "suboptimal": 0.65}


def solar_lookup(props: DataFrame, grid: DataFrame, step: float = 0.002) -> DataFrame:
    """``props`` with the solar attributes of their rounded cell (keys r, c from the grid's corner); null outside."""
    cell = lambda x, x0: F.floor((x - x0) / step + 0.5).cast("long")
    return props.withColumn("r", cell(F.col("lat"), RASTER_LAT)).withColumn("c", cell(F.col("lng"), RASTER_LNG)).join(grid, ["r", "c"], "left").drop("r", "c")


def score_solar(props: DataFrame) -> DataFrame:
    """``props`` (property_id, pvout, ghi, roof_area_m2, orientation) to score, label and yearly kWh; no pvout, no score."""
    factor = F.lit(0.85)
    for k, v in ORIENTATION.items():
        factor = F.when(F.col("orientation") == k, F.lit(v)).otherwise(factor)
    ok = F.coalesce(F.col("pvout") != 0, F.lit(False))
    score = F.when(ok, ladders.clamp((F.col("pvout") - 600) / 1800 * 100 * factor))
    kwh = F.when(ok & (F.col("roof_area_m2") > 0), F.bround(F.col("roof_area_m2") * 0.20 * F.col("pvout") * factor * 0.80)).cast("long")
    return props.select("property_id", score.alias("score"), F.coalesce(ladders.label("solar", score), F.lit("Data unavailable")).alias("label"), F.when(ok, factor).alias("orientation_factor"), kwh.alias("estimated_annual_kwh"), F.when(ok, F.bround("pvout", 1)).alias("pvout"), F.when(ok, F.bround("ghi", 1)).alias("ghi"))


def _solar_props(spark: SparkSession, d: str) -> DataFrame:
    grid = view(spark, d, "v_grid").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), (F.lit(900.0) + F.col("score") * 15).alias("pvout"), (F.lit(1200.0) + F.col("score") * 11).alias("ghi"))
    return solar_lookup(_props(spark, d), grid)


SOLAR_CTE = ", sp AS (SELECT p.*, 900.0::double + g.score * 15 AS pvout, 1200.0::double + g.score * 11 AS ghi, CASE orientation WHEN 'optimal' THEN 1.0::double WHEN 'east' THEN 0.85::double WHEN 'west' THEN 0.85::double WHEN 'suboptimal' THEN 0.65::double ELSE 0.85::double END AS f FROM v_properties p LEFT JOIN v_grid g ON g.r = floor((p.lat - -37.9::double) / 0.002::double + 0.5::double) AND g.c = floor((p.lng - 144.9::double) / 0.002::double + 0.5::double)),\nsolar AS (SELECT *, CASE WHEN pvout IS NOT NULL THEN cast(greatest(0, least(100, round_even((pvout - 600) / 1800 * 100 * f, 0))) AS INT) END AS score FROM sp)"


@query("score_solar", duckdb_ctes("v_properties", "v_grid") + SOLAR_CTE + f"\nSELECT property_id, score, coalesce({label_sql('solar')}, 'Data unavailable') AS label, CASE WHEN pvout IS NOT NULL THEN f END AS orientation_factor, cast(round_even(roof_area_m2 * 0.2::double * pvout * f * 0.8::double, 0) AS BIGINT) AS estimated_annual_kwh, round_even(pvout, 1) AS pvout, round_even(ghi, 1) AS ghi FROM solar")
def q_score_solar(spark: SparkSession, d: str) -> DataFrame:
    return score_solar(_solar_props(spark, d))


@query("solar_grid_lookup", duckdb_ctes("v_properties", "v_grid") + SOLAR_CTE + "\nSELECT property_id, pvout, ghi FROM sp")
def solar_grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _solar_props(spark, d).select("property_id", "pvout", "ghi")


# -- flood ----------------------------------------------------------------------------------------------------------


def score_flood(props: DataFrame, overlays: DataFrame, layers: DataFrame, cells: DataFrame, terrain: DataFrame) -> DataFrame:
    """Flood score: the lower of overlays and water cells, changed by height above drainage and extreme rain.

    overlays: (property_id, worst, zones, n_zones); layers: (state, layers, unreachable); cells: ``water_cells``;
    terrain: (property_id, hand_m, p95). Outside all states the score is null.
    """
    rows = nearby.keyed(props).withColumn("state", geo.state_of(F.col("lat"), F.col("lng"), geo.HAZARD_STATE_BOXES))
    rows = nearby.beside(rows.join(F.broadcast(layers), "state", "left"), overlays, cells, terrain)
    overlay = ladders.flood_overlay(F.col("worst"), F.coalesce("n_zones", F.lit(0)), F.coalesce("layers", F.lit(0)), F.coalesce("unreachable", F.lit(0)))
    water = F.when(F.col("wet").isNotNull(), ladders.water_component(F.col("wet"), F.col("flood"), F.col("nearest_m")))
    rows = rows.withColumn("overlay_score", overlay).withColumn("water_score", water).withColumn("base", F.least("overlay_score", "water_score"))
    modified = ladders.drainage_rain_modifier(F.coalesce("base", F.lit(85)), F.col("hand_m"), F.col("p95"), F.coalesce(F.col("base") < 80, F.lit(False)))
    rows = rows.withColumn("score", F.when(F.col("state").isNotNull(), modified))
    return rows.select("property_id", "state", "score", F.coalesce(ladders.label("flood", F.col("score")), F.lit("Outside Australia")).alias("label"), "zones", F.coalesce("n_zones", F.lit(0)).cast("long").alias("zone_count"), "water_score", "overlay_score")


def _layers(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "state string, layers int, unreachable int")


FLOOD_LAYERS = [("VIC", 4, 0), ("NSW", 1, 0), ("SA", 3, 0), ("TAS", 1, 0), ("ACT", 1, 0)]
FIRE_LAYERS = [("VIC", 1, 0), ("NSW", 1, 0), ("WA", 1, 0), ("SA", 6, 0), ("TAS", 1, 0)]
STATE_SQL = state_sql(geo.HAZARD_STATE_BOXES)


def layers_sql(rows: list[tuple[str, int, int]]) -> str:
    return "CASE state " + " ".join(f"WHEN '{s}' THEN {n}" for s, n, _ in rows) + " ELSE 0 END"



def _terrain(spark: SparkSession, d: str) -> DataFrame:
    """Height above drainage and rain from the raster under each property."""
    s = raster_at(offset_samples(_props(spark, d), [(0.0, 0.0)]), view(spark, d, "v_raster"))
    return s.select("property_id", F.when(F.col("value") < 90, F.col("value") / 4).alias("hand_m"), (F.col("value") / 2).alias("p95"))


def flood_water_sql() -> str:
    near = lambda m: f"coalesce(nearest_m < {m}, false)"
    return f"CASE WHEN wet IS NULL THEN NULL WHEN wet = 0 THEN 95 WHEN flood = 0 AND {near(200)} THEN 70 WHEN flood = 0 THEN 85 WHEN flood >= 10 AND {near(200)} THEN 15 WHEN flood >= 10 THEN 30 WHEN flood >= 5 AND flood / greatest(wet, 1) > 0.5 AND {near(250)} THEN 25 WHEN flood >= 5 AND flood / greatest(wet, 1) > 0.5 THEN 40 WHEN flood >= 5 THEN 55 WHEN flood / greatest(wet, 1) > 0.7 AND {near(200)} THEN 55 ELSE 75 END"


FLOOD_OVERLAY_SQL = "CASE WHEN worst IS NOT NULL THEN greatest(CASE worst WHEN 'floodway' THEN 10 WHEN 'flood' THEN 20 ELSE 40 END, CASE worst WHEN 'floodway' THEN 20 WHEN 'flood' THEN 40 ELSE 60 END - least(n_zones - 1, 3) * 3) ELSE 90 END"
FLOOD_STATE_SQL = FLOOD_OVERLAY_SQL.replace("ELSE 90", f"WHEN {layers_sql(FLOOD_LAYERS)} = 0 THEN NULL ELSE 90")
MODIFIER_SQL = """CASE WHEN hand_m IS NULL THEN b WHEN hand_m < 2 AND ev THEN least(b, 55) - greatest(0, cast(trunc((2 - hand_m) * 10) AS INT)) WHEN hand_m < 2 THEN least(b, 70) WHEN hand_m < 5 AND ev THEN least(b, 65) WHEN hand_m < 5 THEN least(b, 80) WHEN hand_m > 20 THEN greatest(b, least(b + 10, 95)) ELSE b END"""
FLOOD_SQL = f"""{inside_sql('h', 'flood')},\n{worst_sql('w', FLOOD_RANK, FLOOD_ORDER)},\n{WATER_CELLS_SQL},
ts AS (SELECT p.property_id, CASE WHEN r.value < 90 THEN r.value / 4 END AS hand_m, r.value / 2 AS p95 FROM v_properties p LEFT JOIN v_raster r ON r.row = floor((p.lat - -37.9::double) / 0.001::double + 0.5::double) AND r.col = floor((p.lng - 144.9::double) / 0.001::double + 0.5::double)),
f1 AS (SELECT p.property_id, p.state, w.zones, coalesce(w.n_zones, 0) AS zone_count, cast({FLOOD_STATE_SQL} AS INT) AS overlay_score, cast({flood_water_sql()} AS INT) AS water_score, hand_m, p95
  FROM (SELECT *, {STATE_SQL} AS state FROM v_properties) p LEFT JOIN w ON p.property_id = w.property_id LEFT JOIN wc ON p.property_id = wc.property_id LEFT JOIN ts ON p.property_id = ts.property_id),
f2 AS (SELECT *, coalesce(least(overlay_score, water_score), 85) AS b, coalesce(least(overlay_score, water_score) < 80, false) AS ev FROM f1),
f3 AS (SELECT *, {MODIFIER_SQL} AS m FROM f2),
fl AS (SELECT *, CASE WHEN state IS NOT NULL THEN cast(greatest(0, least(100, CASE WHEN ev AND coalesce(p95 > 25, false) THEN greatest(0, m - 5) ELSE m END)) AS INT) END AS score FROM f3)"""


def flood(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    cells = water_cells(tile_samples(props, _tiles(spark, d), WATER_GRID))
    return score_flood(props, worst_overlay(overlay_hits(spark, d, "flood"), FLOOD_ORDER), _layers(spark, FLOOD_LAYERS), cells, _terrain(spark, d))


@query("score_flood", duckdb_ctes("v_properties", "v_overlays", "v_raster") + ",\n" + FLOOD_SQL + f"\nSELECT property_id, state, score, coalesce({label_sql('flood')}, 'Outside Australia') AS label, zones, zone_count, water_score, overlay_score FROM fl")
def q_score_flood(spark: SparkSession, d: str) -> DataFrame:
    return flood(spark, d)


@query("jrc_component", duckdb_ctes("v_properties", "v_raster") + ",\n" + WATER_CELLS_SQL + f"\nSELECT property_id, cast({flood_water_sql()} AS INT) AS component FROM wc")
def jrc_component(spark: SparkSession, d: str) -> DataFrame:
    return q_water_cells(spark, d).select("property_id", ladders.water_component(F.col("wet"), F.col("flood"), F.col("nearest_m")).alias("component"))


@query("hand_component", duckdb_ctes("v_raster") + "\nSELECT row, col, " + ladder_sql("value / 4", [(1, 15), (3, 30), (5, 50), (10, 70), (20, 85)], 95) + " AS component FROM v_raster")
def hand_component(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_raster").select("row", "col", ladders.drainage_component(F.col("value") / 4).alias("component"))


@query("hand_rain_modifier", duckdb_ctes("v_raster") + f"\nSELECT row, col, cast(greatest(0, least(100, CASE WHEN ev AND p95 > 25 THEN greatest(0, {MODIFIER_SQL} - 5) ELSE {MODIFIER_SQL} END)) AS INT) AS score FROM (SELECT row, col, value / 4 AS hand_m, col / 4 AS p95, 15 + row % 80 AS b, 15 + row % 80 < 80 AS ev FROM v_raster)")
def hand_rain_modifier(spark: SparkSession, d: str) -> DataFrame:
    b = 15 + F.col("row") % 80
    return view(spark, d, "v_raster").select("row", "col", ladders.drainage_rain_modifier(b, F.col("value") / 4, F.col("col") / 4, b < 80).alias("score"))


# -- bushfire -------------------------------------------------------------------------------------------------------


def burn_seasons(pixels: DataFrame) -> DataFrame:
    """(property_id, seasons_with_fire, total_burned, seasons_checked) of (property_id, season, value); 1 to 366 is burned."""
    by = pixels.groupBy("property_id", "season").agg(F.count_if((F.col("value") > 0) & (F.col("value") < 367)).alias("burned"))
    return by.groupBy("property_id").agg(F.count_if(F.col("burned") > 0).alias("seasons_with_fire"), F.sum("burned").alias("total_burned"), F.count("*").alias("seasons_checked"))


FIRE_GRID = [(a * 0.01, b * 0.01) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)]
BURN_SQL = offsets_sql("bs", FIRE_GRID) + """,
bn AS (SELECT property_id, count(*) FILTER (b > 0) AS seasons_with_fire, cast(sum(b) AS BIGINT) AS total_burned, count(*) AS seasons_checked FROM (
  SELECT property_id, season, count(*) FILTER (v > 0 AND v < 367) AS b FROM (SELECT property_id, season, CASE WHEN value % 7 = season AND value > 85 THEN value ELSE 0 END AS v FROM bs CROSS JOIN (VALUES (0), (1), (2)) t(season)) GROUP BY 1, 2) GROUP BY 1)"""


def _burns(spark: SparkSession, d: str, props: DataFrame) -> DataFrame:
    s = raster_at(offset_samples(props, FIRE_GRID), view(spark, d, "v_raster")).withColumn("season", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return burn_seasons(s.withColumn("value", F.when((F.col("value") % 7 == F.col("season")) & (F.col("value") > 85), F.col("value")).otherwise(F.lit(0.0))))


@query("burn_seasons", duckdb_ctes("v_properties", "v_raster") + ",\n" + BURN_SQL + "\nSELECT * FROM bn")
def q_burn_seasons(spark: SparkSession, d: str) -> DataFrame:
    return _burns(spark, d, _props(spark, d))


def score_bushfire(props: DataFrame, overlays: DataFrame, layers: DataFrame, cover: DataFrame, slope: DataFrame, fire: DataFrame) -> DataFrame:
    """Bushfire score: the lower of overlays and land cover with slope and, where there is fuel, past fires; else 85."""
    rows = nearby.keyed(props).withColumn("state", geo.state_of(F.col("lat"), F.col("lng"), geo.HAZARD_STATE_BOXES)).join(F.broadcast(layers), "state", "left")
    rows = nearby.beside(rows, overlays, cover, slope, fire)
    fuel, name = ladders.fuel_of(F.col("cover"))
    fuel = F.when(F.col("cover").isNotNull(), fuel)
    rows = rows.withColumn("fuel", fuel).withColumn("overlay_score", ladders.fire_overlay(F.col("worst"), F.coalesce("layers", F.lit(0))))
    satellite = ladders.satellite_component(F.col("fuel"), F.col("mean_slope"), F.when(F.col("fuel") >= 0.4, F.col("seasons_with_fire")))
    rows = rows.withColumn("satellite_score", satellite.cast("int"))
    rows = rows.withColumn("score", F.when(F.col("state").isNotNull(), F.coalesce(F.least("overlay_score", "satellite_score"), F.lit(85))))
    return rows.select("property_id", "state", "score", F.coalesce(ladders.label("bushfire", F.col("score")), F.lit("Outside Australia")).alias("label"), "zones", "cover", F.when(F.col("cover").isNotNull(), name).alias("cover_label"), "overlay_score", "satellite_score")


FUEL_SQL = "CASE WHEN cover IS NULL THEN NULL " + " ".join(f"WHEN cover = {k} THEN {f}::double" for k, (f, _) in ladders.FUEL.items()) + " ELSE 0.3::double END"
COVER_LABEL_SQL = "CASE WHEN cover IS NULL THEN NULL " + " ".join(f"WHEN cover = {k} THEN '{n}'" for k, (_, n) in ladders.FUEL.items()) + " ELSE 'Unknown' END"
SLOPE_FACTOR_SQL = "CASE WHEN s >= 25 THEN 1.0::double WHEN s >= 15 THEN 0.7::double WHEN s >= 8 THEN 0.4::double WHEN s >= 3 THEN 0.2::double ELSE 0.1::double END"


def satellite_sql(fuel: str, slope: str, fire: str) -> str:
    c = f"cast(greatest(0, least(100, round_even((1 - (coalesce({fuel}, 0.3::double) * 0.7::double + {SLOPE_FACTOR_SQL.replace('s >=', f'coalesce({slope}, 5.0::double) >=')} * 0.3::double)) * 100, 0))) AS INT)"
    return f"CASE WHEN {fuel} IS NULL AND {slope} IS NULL THEN NULL WHEN coalesce({fire}, 0) >= 3 THEN least({c}, 15) WHEN coalesce({fire}, 0) >= 2 THEN least({c}, 25) WHEN coalesce({fire}, 0) >= 1 THEN least({c}, greatest({c} - 15, 20)) ELSE {c} END"


FIRE_SQL = f"""{inside_sql('bh', 'bushfire')},\n{worst_sql('bw', FIRE_RANK, FIRE_ORDER, 'bh')},\n{COVER_SQL},\n{BURN_SQL},\n{SLOPE_SQL},
ps AS (SELECT p.property_id, avg(sl.slope) AS mean_slope FROM v_properties p JOIN sl ON abs(sl.row - floor((p.lat - -37.9::double) / 0.001::double + 0.5::double)) <= 1 AND abs(sl.col - floor((p.lng - 144.9::double) / 0.001::double + 0.5::double)) <= 1 GROUP BY 1),
b1 AS (SELECT p.property_id, p.state, bw.zones, dc.cover, {FUEL_SQL} AS fuel, ps.mean_slope, bn.seasons_with_fire, CASE WHEN worst IS NOT NULL THEN CASE worst WHEN 'extreme' THEN 10 WHEN 'high' THEN 22 WHEN 'moderate' THEN 40 ELSE 58 END WHEN {layers_sql(FIRE_LAYERS)} > 0 THEN 90 END AS overlay_score
  FROM (SELECT *, {STATE_SQL} AS state FROM v_properties) p LEFT JOIN bw ON p.property_id = bw.property_id LEFT JOIN dc ON p.property_id = dc.property_id LEFT JOIN ps ON p.property_id = ps.property_id LEFT JOIN bn ON p.property_id = bn.property_id),
fire AS (SELECT *, cast({satellite_sql('fuel', 'mean_slope', 'CASE WHEN fuel >= 0.4::double THEN seasons_with_fire END')} AS INT) AS satellite_score FROM b1),
bf AS (SELECT *, CASE WHEN state IS NOT NULL THEN cast(coalesce(least(overlay_score, satellite_score), 85) AS INT) END AS score FROM fire)"""


def bushfire(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    around = raster_at(offset_samples(props, COVER_GRID), _slopes(spark, d).select("row", "col", F.col("slope").alias("value")))
    slope = around.groupBy("property_id").agg(F.avg("value").alias("mean_slope"))
    return score_bushfire(props, worst_overlay(overlay_hits(spark, d, "bushfire"), FIRE_ORDER), _layers(spark, FIRE_LAYERS), _cover(spark, d), slope, _burns(spark, d, props))


@query("score_bushfire", duckdb_ctes("v_properties", "v_overlays", "v_raster") + ",\n" + FIRE_SQL + f"\nSELECT property_id, state, score, coalesce({label_sql('bushfire')}, 'Outside Australia') AS label, zones, cover, {COVER_LABEL_SQL} AS cover_label, overlay_score, satellite_score FROM bf")
def q_score_bushfire(spark: SparkSession, d: str) -> DataFrame:
    return bushfire(spark, d)


@query("fuel_class", duckdb_ctes("v_raster") + f"\nSELECT row, col, {FUEL_SQL} AS fuel, {COVER_LABEL_SQL} AS name FROM (SELECT row, col, cast(value AS INT) AS cover FROM v_raster)")
def fuel_class(spark: SparkSession, d: str) -> DataFrame:
    fuel, name = ladders.fuel_of(F.col("value").cast("int"))
    return view(spark, d, "v_raster").select("row", "col", fuel.alias("fuel"), name.alias("name"))


@query("satellite_component", duckdb_ctes("v_raster") + f"\nSELECT row, col, cast({satellite_sql('fuel', 'slope', 'fire')} AS INT) AS score FROM (SELECT row, col, CASE WHEN row % 5 = 0 THEN NULL ELSE (row % 20) / 20.0::double END AS fuel, CASE WHEN col % 5 = 0 THEN NULL ELSE (col % 30) * 1.0::double END AS slope, cast(value % 4 AS INT) AS fire FROM v_raster)")
def satellite_component(spark: SparkSession, d: str) -> DataFrame:
    fuel = F.when(F.col("row") % 5 != 0, (F.col("row") % 20) / F.lit(20.0))
    slope = F.when(F.col("col") % 5 != 0, (F.col("col") % 30) * F.lit(1.0))
    return view(spark, d, "v_raster").select("row", "col", ladders.satellite_component(fuel, slope, (F.col("value") % 4).cast("int")).cast("int").alias("score"))


@query("overlay_component", duckdb_ctes("v_overlays") + f"\nSELECT overlay_id, i, CASE WHEN theme = 'flood' THEN cast({FLOOD_OVERLAY_SQL.replace('ELSE 90', 'WHEN i % 2 = 0 THEN 80 ELSE 90')} AS INT) END AS flood, CASE WHEN theme = 'bushfire' THEN CASE worst WHEN 'extreme' THEN 10 WHEN 'high' THEN 22 WHEN 'moderate' THEN 40 WHEN 'low' THEN 58 ELSE 90 END END AS fire FROM (SELECT overlay_id, i, theme, CASE WHEN i < 6 THEN severity END AS worst, i AS n_zones FROM v_overlays)")
def overlay_component(spark: SparkSession, d: str) -> DataFrame:
    worst = F.when(F.col("i") < 6, F.col("severity"))
    flood_ = ladders.flood_overlay(worst, F.col("i"), F.lit(4), F.when(F.col("i") % 2 == 0, 1).otherwise(0))
    return view(spark, d, "v_overlays").select("overlay_id", "i", F.when(F.col("theme") == "flood", flood_).alias("flood"), F.when(F.col("theme") == "bushfire", ladders.fire_overlay(worst, F.lit(1))).alias("fire"))


# -- heat -----------------------------------------------------------------------------------------------------------


def lst_delta(samples: DataFrame) -> DataFrame:
    """(property_id, lst, area, delta, night): surface temperatures of (i, band, value) with i = 12 the centre of 5 x 5;
    raw values times 0.02 K, those of 0 and less left out; without a centre value there is none."""
    c = F.when(F.col("value") > 0, F.col("value") * 0.02 - 273.15)
    day, mid = F.col("band") == "day", F.col("i") == 12
    out = samples.groupBy("property_id").agg(F.avg(F.when(day & mid, c)).alias("p"), F.avg(F.when(day & ~mid, c)).alias("a"), F.avg(F.when(~day & mid, c)).alias("n")).where("p is not null")
    area = F.coalesce("a", "p")
    return out.select("property_id", F.bround("p", 1).alias("lst"), F.bround(area, 1).alias("area"), F.bround(F.col("p") - area, 1).alias("delta"), F.bround("n", 1).alias("night"))


LST_SQL = offsets_sql("ls", NEIGHBOURS5) + """,
lt AS (SELECT property_id, avg(CASE WHEN band = 'day' AND i = 12 THEN c END) AS p, avg(CASE WHEN band = 'day' AND i <> 12 THEN c END) AS a, avg(CASE WHEN band = 'night' AND i = 12 THEN c END) AS n
  FROM (SELECT *, CASE WHEN v > 0 THEN v * 0.02::double - 273.15::double END AS c FROM (SELECT property_id, i, band, CASE WHEN band = 'day' THEN 14700 + value * 11 ELSE 14500 + value * 3 END AS v FROM ls CROSS JOIN (VALUES ('day'), ('night')) t(band))) GROUP BY property_id HAVING p IS NOT NULL),
ld AS (SELECT property_id, round_even(p, 1) AS lst, round_even(coalesce(a, p), 1) AS area, round_even(p - coalesce(a, p), 1) AS delta, round_even(n, 1) AS night FROM lt)"""


def _lst(spark: SparkSession, d: str) -> DataFrame:
    s = raster_at(offset_samples(_props(spark, d), NEIGHBOURS5), view(spark, d, "v_raster")).withColumn("band", F.explode(F.array(F.lit("day"), F.lit("night"))))
    return lst_delta(s.withColumn("value", F.when(F.col("band") == "day", 14700 + F.col("value") * 11).otherwise(14500 + F.col("value") * 3)))


@query("lst_delta", duckdb_ctes("v_properties", "v_raster") + ",\n" + LST_SQL + "\nSELECT * FROM ld")
def q_lst_delta(spark: SparkSession, d: str) -> DataFrame:
    return _lst(spark, d)


def at_share(values: str, share: float) -> F.Column:
    """The value at index int(n * share), n - 1 at most, of a sorted array."""
    return F.get(F.col(values), F.least((F.size(values) * share).cast("int"), F.size(values) - 1))


def summer_stats(daily: DataFrame) -> DataFrame:
    """(cell_id, mean, p90) of daily maxima of December to February; a cell holds some years of days, so its list is short.

    The mean is that of values to six decimals, summed as decimals, so it does not depend on the order of rows.
    """
    rows = daily.where(F.month("day").isin(12, 1, 2) & F.col("temperature_2m_max").isNotNull())
    out = rows.groupBy("cell_id").agg((F.sum(F.round("temperature_2m_max", 6).cast("decimal(18,6)")).cast("double") / F.count("*")).alias("mean"), F.sort_array(F.collect_list("temperature_2m_max")).alias("s"))
    return out.select("cell_id", "mean", at_share("s", 0.9).alias("p90"))


SUMMER_SQL = "su AS (SELECT cell_id, cast(sum(cast(round(temperature_2m_max, 6) AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS mean, list_sort(list(temperature_2m_max))[cast(least(trunc(count(*) * 0.9::double), count(*) - 1) AS INT) + 1] AS p90 FROM v_climate WHERE month(day) IN (12, 1, 2) GROUP BY cell_id)"


@query("summer_stats", duckdb_ctes("v_climate") + ",\n" + SUMMER_SQL + "\nSELECT cell_id, round_even(mean, 4) AS mean, round_even(p90, 4) AS p90 FROM su")
def q_summer_stats(spark: SparkSession, d: str) -> DataFrame:
    return summer_stats(view(spark, d, "v_climate")).select("cell_id", R4("mean", 4), R4("p90", 4))


def building_density(near: DataFrame) -> DataFrame:
    return near.groupBy("property_id").agg(F.least(F.count("*") / 500.0, F.lit(1.0)).alias("density"))


def greenspace(near: DataFrame) -> DataFrame:
    return near.groupBy("property_id").agg(F.least(F.count_if(places.is_green(F.col("category"))) / 20.0, F.lit(1.0)).alias("green"))


DENSITY_SQL = near_buildings_sql("hb", 500) + ",\nbd AS (SELECT property_id, least(count(*) / 500.0::double, 1.0::double) AS density FROM hb GROUP BY 1)"
GREEN_SQL = near_pois_sql("hp", 1000) + f",\ngs AS (SELECT property_id, least(count(*) FILTER ({sql_any('category', places.GREEN)}) / 20.0::double, 1.0::double) AS green FROM hp GROUP BY 1)"


@query("building_density", duckdb_ctes("v_properties", "v_buildings") + ",\n" + DENSITY_SQL + "\nSELECT property_id, round_even(density, 4) AS density FROM bd")
def q_building_density(spark: SparkSession, d: str) -> DataFrame:
    return building_density(nearby.buildings(_props(spark, d), view(spark, d, "v_buildings"), 500)).select("property_id", R4("density", 4))


@query("greenspace_factor", duckdb_ctes("v_properties", "v_pois") + ",\n" + GREEN_SQL + "\nSELECT property_id, round_even(green, 4) AS green FROM gs")
def q_greenspace(spark: SparkSession, d: str) -> DataFrame:
    return greenspace(nearby.places(_props(spark, d), view(spark, d, "v_pois"), 1000)).select("property_id", R4("green", 4))


def score_heat(props: DataFrame, lst: DataFrame, summer: DataFrame, density: DataFrame, green: DataFrame) -> DataFrame:
    """Heat score from surface or air temperatures, building density and green space; no temperature, no score."""
    rows = nearby.beside(nearby.keyed(props).select("property_id"), lst, summer, density, green)
    part, penalty = ladders.heat_components(F.col("lst"), F.col("delta"), F.col("night"), F.col("mean"), F.col("p90"))
    score = ladders.clamp(F.bround(part - penalty - F.coalesce("density", F.lit(0.0)) * 12 + F.coalesce("green", F.lit(0.0)) * 5, 9))
    return rows.select("property_id", F.when(part.isNotNull(), score).alias("score"), F.coalesce(ladders.label("heat", F.when(part.isNotNull(), score)), F.lit("Data unavailable")).alias("label"), "lst", "delta", "night", R4("mean", 1), R4("p90", 1))


PART_SQL = lambda t: f"greatest(0.0::double, least(100.0::double, (42.0::double - {t}) / 20.0::double * 100))"
HEAT_SQL = f"""{LST_SQL},\n{SUMMER_SQL},\n{DENSITY_SQL},\n{GREEN_SQL},
h1 AS (SELECT p.property_id, lst, delta, night, mean, p90, density, green, CASE WHEN coalesce(lst > 0, false) THEN {PART_SQL('lst')} WHEN mean IS NOT NULL THEN {PART_SQL('(mean * 0.4::double + p90 * 0.6::double)')} END AS part,
  CASE WHEN coalesce(lst > 0, false) THEN greatest(0.0::double, delta) * 3 + CASE WHEN night > 18 THEN least((night - 18) * 1.5::double, 10.0::double) ELSE 0.0::double END ELSE 0.0::double END AS pen
  FROM v_properties p LEFT JOIN ld ON p.property_id = ld.property_id LEFT JOIN su ON p.property_id % 150 = su.cell_id LEFT JOIN bd ON p.property_id = bd.property_id LEFT JOIN gs ON p.property_id = gs.property_id),
heat AS (SELECT *, CASE WHEN part IS NOT NULL THEN cast(greatest(0, least(100, round_even(round_even(part - pen - coalesce(density, 0.0::double) * 12 + coalesce(green, 0.0::double) * 5, 9), 0))) AS INT) END AS score FROM h1)"""


def _summer(spark: SparkSession, d: str) -> DataFrame:
    """Summer values by property: its climate cell is property_id modulo 150."""
    s = summer_stats(view(spark, d, "v_climate"))
    return _props(spark, d).select("property_id", (F.col("property_id") % 150).alias("cell_id")).join(s, "cell_id").drop("cell_id")


def heat(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    return score_heat(props, _lst(spark, d), _summer(spark, d), building_density(nearby.buildings(props, view(spark, d, "v_buildings"), 500)), greenspace(nearby.places(props, view(spark, d, "v_pois"), 1000)))


@query("score_heat", duckdb_ctes("v_properties", "v_raster", "v_climate", "v_buildings", "v_pois") + ",\n" + HEAT_SQL + f"\nSELECT property_id, score, coalesce({label_sql('heat')}, 'Data unavailable') AS label, lst, delta, night, round_even(mean, 1) AS mean, round_even(p90, 1) AS p90 FROM heat")
def q_score_heat(spark: SparkSession, d: str) -> DataFrame:
    return heat(spark, d)


@query("heat_components", duckdb_ctes("v_raster") + f"\nSELECT row, col, round_even(CASE WHEN row % 7 <> 0 THEN {PART_SQL('(20 + value / 4)')} ELSE {PART_SQL('(25 * 0.4::double + (25 + col / 20) * 0.6::double)')} END, 4) AS part, round_even(CASE WHEN row % 7 <> 0 THEN greatest(0.0::double, col / 50 - 2) * 3 + CASE WHEN 10 + col / 10 > 18 THEN least((10 + col / 10 - 18) * 1.5::double, 10.0::double) ELSE 0.0::double END ELSE 0.0::double END, 4) AS penalty FROM v_raster")
def heat_components(spark: SparkSession, d: str) -> DataFrame:
    lst = F.when(F.col("row") % 7 != 0, 20 + F.col("value") / 4)
    part, pen = ladders.heat_components(lst, F.col("col") / 50 - 2, 10 + F.col("col") / 10, F.lit(25.0), 25 + F.col("col") / 20)
    return view(spark, d, "v_raster").select("row", "col", F.bround(part, 4).alias("part"), F.bround(pen, 4).alias("penalty"))


# -- view -----------------------------------------------------------------------------------------------------------

#: The horizon's eight directions as (lat, lng) steps, and the distances looked at.
HORIZON_DIRS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
HORIZON_M = [100, 300, 600, 1000, 2000]
HORIZON = [(0.0, 0.0)] + [(a * m / 111320, b * m / 111320) for a, b in HORIZON_DIRS for m in HORIZON_M]


def horizon_samples(props: DataFrame) -> DataFrame:
    """Centre and 8 x 5 points; longitude steps are scaled by the cosine of latitude."""
    s = offset_samples(props, HORIZON)
    return s.withColumn("s_lng", F.col("lng") + (F.col("s_lng") - F.col("lng")) * F.cos(F.radians(F.col("lat"))))


def horizon_angles(samples: DataFrame) -> DataFrame:
    """(property_id, open_dirs, downhill): directions whose highest angle of sight is below 3 and below -2 degrees; no
    heights at all in a direction count as open."""
    centre = samples.where("i = 0 and value is not null").select("property_id", F.col("value").alias("c"))
    m = F.get(F.array(*[F.lit(float(x)) for x in HORIZON_M]), (F.col("i") - 1) % 5)
    rows = samples.where("i > 0").join(centre.hint("merge"), "property_id")
    by = rows.groupBy("property_id", F.floor((F.col("i") - 1) / 5).alias("dir")).agg(F.coalesce(F.max(F.degrees(F.atan2(F.col("value") - F.col("c"), m))), F.lit(-90.0)).alias("a"))
    return by.groupBy("property_id").agg(F.count_if(F.col("a") < 3).alias("open_dirs"), F.count_if(F.col("a") < -2).alias("downhill"))


HORIZON_SQL = f"""zs AS (SELECT s.property_id, s.i, r.value FROM (SELECT property_id, i, cast(floor((lat + dy - -37.9::double) / 0.001::double + 0.5::double) AS INT) AS row, cast(floor((lng + ((lng + dx) - lng) * cos(radians(lat)) - 144.9::double) / 0.001::double + 0.5::double) AS INT) AS col
  FROM v_properties CROSS JOIN (VALUES {', '.join(f'({i}, {a!r}::double, {b!r}::double)' for i, (a, b) in enumerate(HORIZON))}) o(i, dy, dx)) s LEFT JOIN v_raster r ON s.row = r.row AND s.col = r.col),
ha AS (SELECT property_id, count(*) FILTER (a < 3) AS open_dirs, count(*) FILTER (a < -2) AS downhill FROM (
  SELECT z.property_id, (i - 1) // 5 AS dir, coalesce(max(degrees(atan2(z.value - c.value, [100.0::double, 300.0::double, 600.0::double, 1000.0::double, 2000.0::double][(i - 1) % 5 + 1]))), -90.0::double) AS a
  FROM (SELECT * FROM zs WHERE i > 0) z JOIN (SELECT property_id, value FROM zs WHERE i = 0 AND value IS NOT NULL) c ON z.property_id = c.property_id GROUP BY 1, 2) GROUP BY 1)"""


def _horizon(spark: SparkSession, d: str) -> DataFrame:
    return horizon_angles(raster_at(horizon_samples(_props(spark, d)), view(spark, d, "v_raster")))


@query("horizon_angles", duckdb_ctes("v_properties", "v_raster") + ",\n" + HORIZON_SQL + "\nSELECT * FROM ha")
def q_horizon(spark: SparkSession, d: str) -> DataFrame:
    return _horizon(spark, d)


def ring_medians(samples: DataFrame) -> DataFrame:
    """(property_id, elevation, near_median, far_median): upper medians of the rings 1 to 8 and 9 to 16; all three must
    be there."""
    upper = lambda c: F.get(F.col(c), F.floor(F.size(c) / 2).cast("int"))
    out = samples.groupBy("property_id").agg(F.max(F.when(F.col("i") == 0, F.col("value"))).alias("elevation"), F.sort_array(F.collect_list(F.when(F.col("i").between(1, 8), F.col("value")))).alias("n"), F.sort_array(F.collect_list(F.when(F.col("i") > 8, F.col("value")))).alias("f"))
    return out.where("elevation is not null and size(n) > 0 and size(f) > 0").select("property_id", "elevation", upper("n").alias("near_median"), upper("f").alias("far_median"))


RINGS_SQL = offsets_sql("gs1", RINGS) + """,
rm AS (SELECT property_id, e AS elevation, n[len(n) // 2 + 1] AS near_median, f[len(f) // 2 + 1] AS far_median FROM (SELECT property_id, max(CASE WHEN i = 0 THEN value END) AS e, list_sort(list(value) FILTER (i BETWEEN 1 AND 8 AND value IS NOT NULL)) AS n, list_sort(list(value) FILTER (i > 8 AND value IS NOT NULL)) AS f FROM gs1 GROUP BY 1) WHERE e IS NOT NULL AND len(n) > 0 AND len(f) > 0)"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    return ring_medians(raster_at(offset_samples(_props(spark, d), RINGS), view(spark, d, "v_raster")))


@query("ring_medians", duckdb_ctes("v_properties", "v_raster") + ",\n" + RINGS_SQL + "\nSELECT * FROM rm")
def q_rings(spark: SparkSession, d: str) -> DataFrame:
    return _rings(spark, d)


def nearest_water_by_class(near: DataFrame) -> DataFrame:
    """(property_id, ocean_m, inland_m): nearest ocean-like water and, within 3 km, nearest inland water."""
    c = F.lower("class")
    inland = c.isin(places.INLAND) & (F.col("dist_m") < 3000)
    return near.groupBy("property_id").agg(F.min(F.when(c.isin(places.OCEAN), F.col("dist_m"))).alias("ocean_m"), F.min(F.when(inland, F.col("dist_m"))).alias("inland_m"))


quoted = lambda words: ", ".join(f"'{w}'" for w in words)
WATER_CLASS_SQL = near_water_sql("nw", 10000) + f",\nwb AS (SELECT property_id, min(CASE WHEN lower(class) IN ({quoted(places.OCEAN)}) THEN dist_m END) AS ocean_m, min(CASE WHEN lower(class) IN ({quoted(places.INLAND)}) AND dist_m < 3000 THEN dist_m END) AS inland_m FROM nw GROUP BY 1)"


@query("nearest_water_by_class", duckdb_ctes("v_properties", "v_water") + ",\n" + WATER_CLASS_SQL + "\nSELECT property_id, round_even(ocean_m, 3) AS ocean_m, round_even(inland_m, 3) AS inland_m FROM wb")
def q_water_by_class(spark: SparkSession, d: str) -> DataFrame:
    return nearest_water_by_class(nearby.water(_props(spark, d), view(spark, d, "v_water"), 10_000)).select("property_id", R4("ocean_m"), R4("inland_m"))


def green_space(near: DataFrame) -> DataFrame:
    """(property_id, n_green, green_m, green_value) of places within 1 km."""
    g = places.is_green(F.col("category"))
    out = near.groupBy("property_id").agg(F.count_if(g).alias("n_green"), F.min(F.when(g, F.col("dist_m"))).alias("green_m"))
    return out.withColumn("green_value", ladders.green_factor(F.col("green_m"), F.col("n_green")))


GREEN_VALUE_SQL = near_pois_sql("gp", 1000) + f",\ngv AS (SELECT *, CASE WHEN n_green > 0 THEN round_even(greatest(0.0::double, 1.0::double - green_m / 1000) * 0.6::double + least(n_green / 15.0::double, 1.0::double) * 0.4::double, 3) ELSE 0.0::double END AS green_value FROM (SELECT property_id, count(*) FILTER ({sql_any('category', places.GREEN)}) AS n_green, min(CASE WHEN {sql_any('category', places.GREEN)} THEN dist_m END) AS green_m FROM gp GROUP BY 1))"


@query("green_space", duckdb_ctes("v_properties", "v_pois") + ",\n" + GREEN_VALUE_SQL + "\nSELECT property_id, n_green, round_even(green_m, 3) AS green_m, green_value FROM gv")
def q_green_space(spark: SparkSession, d: str) -> DataFrame:
    return green_space(nearby.places(_props(spark, d), view(spark, d, "v_pois"), 1000)).select("property_id", "n_green", R4("green_m"), "green_value")


def openness_counts(near: DataFrame) -> DataFrame:
    return near.groupBy("property_id").agg(F.count("*").alias("n_buildings"), F.count_if(F.coalesce(F.col("height") > 10, F.lit(False))).alias("tall"))


OPEN_SQL = near_buildings_sql("ob", 300) + ",\noc AS (SELECT property_id, count(*) AS n_buildings, count(*) FILTER (height > 10) AS tall FROM ob GROUP BY 1)"
OPEN_VALUE_SQL = "round_even(greatest(0.0::double, CASE WHEN n_buildings = 0 THEN 1.0::double WHEN n_buildings <= 10 THEN 0.95::double WHEN n_buildings <= 40 THEN 0.8::double WHEN n_buildings <= 100 THEN 0.65::double WHEN n_buildings <= 200 THEN 0.45::double WHEN n_buildings <= 350 THEN 0.25::double ELSE 0.1::double END - CASE WHEN tall > 5 THEN least((tall - 5) * 0.04::double, 0.3::double) ELSE 0.0::double END), 3)"


@query("openness_counts", duckdb_ctes("v_properties", "v_buildings") + ",\n" + OPEN_SQL + "\nSELECT * FROM oc")
def q_openness(spark: SparkSession, d: str) -> DataFrame:
    return openness_counts(nearby.buildings(_props(spark, d), view(spark, d, "v_buildings"), 300))


VIEW_WEIGHTS = {"ocean": 3.0, "inland": 1.5, "elevation": 2.5, "green": 2.0, "open": 2.0, "horizon": 2.5}


def view_factors(props: DataFrame, water: DataFrame, rings: DataFrame, green: DataFrame, openness: DataFrame, horizon: DataFrame) -> DataFrame:
    """(property_id, six factors from 0 to 1); water, elevation and horizon are null without data."""
    rows = nearby.beside(nearby.keyed(props).select("property_id"), water, rings, green, openness, horizon)
    zero = lambda c: F.coalesce(c, F.lit(0))
    advantage = F.greatest(F.col("elevation") - F.col("near_median"), F.col("elevation") - F.col("far_median"))
    return rows.select(
        "property_id",
        ladders.ocean_factor(F.col("ocean_m")).alias("ocean"),
        ladders.inland_factor(F.col("inland_m")).alias("inland"),
        ladders.elevation_factor(advantage, F.col("elevation")).alias("elevation"),
        F.coalesce("green_value", F.lit(0.0)).alias("green"),
        ladders.openness_factor(zero("n_buildings"), zero("tall")).alias("open"),
        ladders.horizon_factor(F.col("open_dirs"), F.col("downhill")).alias("horizon"),
    )


VIEW_FACTORS_SQL = f"""{WATER_CLASS_SQL},\n{RINGS_SQL},\n{GREEN_VALUE_SQL},\n{OPEN_SQL},\n{HORIZON_SQL},
v0 AS (SELECT p.property_id, ocean_m, inland_m, elevation AS ev, greatest(elevation - near_median, elevation - far_median) AS adv, green_value, coalesce(n_buildings, 0) AS n_buildings, coalesce(tall, 0) AS tall, open_dirs, downhill
  FROM v_properties p LEFT JOIN wb ON p.property_id = wb.property_id LEFT JOIN rm ON p.property_id = rm.property_id LEFT JOIN gv ON p.property_id = gv.property_id LEFT JOIN oc ON p.property_id = oc.property_id LEFT JOIN ha ON p.property_id = ha.property_id),
vf AS (SELECT property_id, CASE WHEN ocean_m < 5000 THEN {ladder_sql('ocean_m', [(200, '1.0::double'), (500, '0.9::double'), (1000, '0.75::double'), (2000, '0.55::double')], '0.3::double')} WHEN ocean_m IS NOT NULL THEN greatest(0.0::double, 0.15::double * (1 - (ocean_m - 5000) / 5000)) END AS ocean,
  {ladder_sql('inland_m', [(100, '1.0::double'), (300, '0.8::double'), (500, '0.6::double'), (1000, '0.35::double'), (2000, '0.15::double')], '0.0::double')} AS inland,
  least(1.0::double, CASE WHEN adv >= 50 THEN 1.0::double WHEN adv >= 30 THEN 0.85::double WHEN adv >= 15 THEN 0.65::double WHEN adv >= 5 THEN 0.45::double WHEN adv >= 0 THEN 0.25::double WHEN adv IS NOT NULL THEN greatest(0.0::double, 0.15::double + adv / 80) END + CASE WHEN ev > 50 THEN least(ev / 600.0::double, 0.15::double) ELSE 0.0::double END) AS e0, adv,
  coalesce(green_value, 0.0::double) AS green, {OPEN_VALUE_SQL} AS open, round_even(least(1.0::double, open_dirs / 8 + least(downhill * 0.05::double, 0.15::double)), 3) AS h0, open_dirs FROM v0),
vx AS (SELECT property_id, ocean, inland, CASE WHEN adv IS NOT NULL THEN e0 END AS elevation, green, open, CASE WHEN open_dirs IS NOT NULL THEN h0 END AS horizon FROM vf)"""


def _factors(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    return view_factors(props, nearest_water_by_class(nearby.water(props, view(spark, d, "v_water"), 10_000)), _rings(spark, d), green_space(nearby.places(props, view(spark, d, "v_pois"), 1000)), openness_counts(nearby.buildings(props, view(spark, d, "v_buildings"), 300)), _horizon(spark, d))


@query("view_factors", duckdb_ctes("v_properties", "v_water", "v_raster", "v_pois", "v_buildings") + ",\n" + VIEW_FACTORS_SQL + "\nSELECT property_id, " + ", ".join(f"round_even({c}, 4) AS {c}" for c in VIEW_WEIGHTS) + " FROM vx")
def q_view_factors(spark: SparkSession, d: str) -> DataFrame:
    return _factors(spark, d).select("property_id", *[R4(c, 4) for c in VIEW_WEIGHTS])


def score_view(factors: DataFrame) -> DataFrame:
    """(property_id, score, label, active_factors): weighted mean over the factors that there are."""
    total, weight, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for c, w in VIEW_WEIGHTS.items():
        total, weight, n = total + F.coalesce(F.col(c) * w, F.lit(0.0)), weight + F.when(F.col(c).isNotNull(), w).otherwise(0.0), n + F.col(c).isNotNull().cast("int")
    score = F.when(weight > 0, ladders.clamp(F.bround(total / weight * 100, 9)))
    return factors.select("property_id", score.alias("score"), F.coalesce(ladders.label("view", score), F.lit("Data unavailable")).alias("label"), n.alias("active_factors"))


VIEW_SCORE_SQL = f"""{VIEW_FACTORS_SQL},
vs AS (SELECT property_id, cast(greatest(0, least(100, round_even(round_even(({' + '.join(f'coalesce({c} * {w}::double, 0.0::double)' for c, w in VIEW_WEIGHTS.items())}) / ({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN {w}::double ELSE 0.0::double END' for c, w in VIEW_WEIGHTS.items())}) * 100, 9), 0))) AS INT) AS score, {' + '.join(f'cast({c} IS NOT NULL AS INT)' for c in VIEW_WEIGHTS)} AS active_factors FROM vx)"""


def view_score(spark: SparkSession, d: str) -> DataFrame:
    return score_view(_factors(spark, d))


@query("score_view", duckdb_ctes("v_properties", "v_water", "v_raster", "v_pois", "v_buildings") + ",\n" + VIEW_SCORE_SQL + f"\nSELECT property_id, score, {label_sql('view')} AS label, active_factors FROM vs")
def q_score_view(spark: SparkSession, d: str) -> DataFrame:
    return view_score(spark, d)


# -- contamination and aircraft -------------------------------------------------------------------------------------


def industrial_proximity(near: DataFrame) -> DataFrame:
    """(property_id, n_industrial, industrial_m, industrial_type) of places within 500 m."""
    rows = near.where(places.is_industrial(F.col("category")))
    best = F.min_by(F.struct("dist_m", "category"), F.struct("dist_m", "poi_id")).alias("b")
    return rows.groupBy("property_id").agg(F.count("*").alias("n_industrial"), best).select("property_id", "n_industrial", F.bround("b.dist_m").cast("long").alias("industrial_m"), F.col("b.category").alias("industrial_type"))


INDUSTRIAL_SQL = near_pois_sql("ip", 500) + f",\nid AS (SELECT property_id, n AS n_industrial, cast(round_even(dist_m, 0) AS BIGINT) AS industrial_m, category AS industrial_type FROM (SELECT *, count(*) OVER (PARTITION BY property_id) AS n, row_number() OVER (PARTITION BY property_id ORDER BY dist_m, poi_id) AS rn FROM ip WHERE {sql_any('category', places.INDUSTRIAL)} AND NOT {sql_any('category', places.INDUSTRIAL_EXCLUDE)}) WHERE rn = 1)"


@query("industrial_proximity", duckdb_ctes("v_properties", "v_pois") + ",\n" + INDUSTRIAL_SQL + "\nSELECT * FROM id")
def q_industrial(spark: SparkSession, d: str) -> DataFrame:
    return industrial_proximity(nearby.places(_props(spark, d), view(spark, d, "v_pois"), 500))


def score_contamination(props: DataFrame, epa: DataFrame, pois: DataFrame) -> DataFrame:
    """Contamination score: the lower of registered sites (where the state has a register) and industrial places."""
    sites = register_sites(props, epa).groupBy("property_id").agg(F.count("*").alias("n_sites"), F.min("dist_m").alias("site_m"), F.min_by("name", F.struct("dist_m", "site_id")).alias("site_name"))
    rows = nearby.keyed(props).withColumn("state", geo.state_of(F.col("lat"), F.col("lng"), geo.HAZARD_STATE_BOXES))
    rows = nearby.beside(rows, sites, industrial_proximity(nearby.places(props, pois, 500)))
    n = F.coalesce("n_sites", F.lit(0))
    register = F.when(F.col("state").isin("VIC", "NSW", "WA"), ladders.register_component(F.col("site_m"), n))
    industrial = ladders.industrial_component(F.col("industrial_m"), F.coalesce("n_industrial", F.lit(0)))
    score = F.when(F.col("state").isNotNull(), F.least(register, industrial))
    return rows.select("property_id", "state", score.alias("score"), F.coalesce(ladders.label("contamination", score), F.lit("Outside Australia")).alias("label"), n.cast("long").alias("n_sites"), "site_m", "site_name", F.coalesce("n_industrial", F.lit(0)).cast("long").alias("n_industrial"), "industrial_m", "industrial_type")


REGISTER_SQL = "CASE WHEN n_sites = 0 THEN 95 WHEN site_m < 100 THEN 10 WHEN site_m < 250 THEN 25 WHEN site_m < 500 AND n_sites > 2 THEN 30 WHEN site_m < 500 THEN 45 WHEN site_m < 1000 AND n_sites > 3 THEN 50 WHEN site_m < 1000 THEN 65 WHEN site_m < 2000 THEN 80 ELSE 90 END"
INDUSTRY_SQL = "CASE WHEN n_industrial = 0 THEN 95 WHEN coalesce(industrial_m < 100, false) AND n_industrial > 3 THEN 30 WHEN coalesce(industrial_m < 100, false) THEN 45 WHEN n_industrial > 5 THEN 40 WHEN n_industrial > 3 THEN 55 WHEN n_industrial > 1 THEN 70 ELSE 80 END"
CONTAMINATION_SQL = f"""{epa_sql('es')},\n{INDUSTRIAL_SQL},
sg AS (SELECT property_id, count(*) AS n_sites, min(dist_m) AS site_m, arg_min(name, dist_m * 1000000 + site_id) AS site_name FROM es GROUP BY 1),
c1 AS (SELECT p.property_id, p.state, coalesce(n_sites, 0) AS n_sites, site_m, site_name, coalesce(n_industrial, 0) AS n_industrial, industrial_m, industrial_type FROM (SELECT *, {STATE_SQL} AS state FROM v_properties) p LEFT JOIN sg ON p.property_id = sg.property_id LEFT JOIN id ON p.property_id = id.property_id),
ct AS (SELECT *, CASE WHEN state IS NOT NULL THEN cast(least(CASE WHEN state IN ('VIC', 'NSW', 'WA') THEN {REGISTER_SQL} END, {INDUSTRY_SQL}) AS INT) END AS score FROM c1)"""


def contamination(spark: SparkSession, d: str) -> DataFrame:
    return score_contamination(_props(spark, d), view(spark, d, "v_epa"), view(spark, d, "v_pois"))


@query("score_contamination", duckdb_ctes("v_properties", "v_epa", "v_pois") + ",\n" + CONTAMINATION_SQL + f"\nSELECT property_id, state, score, coalesce({label_sql('contamination')}, 'Outside Australia') AS label, n_sites, site_m, site_name, n_industrial, industrial_m, industrial_type FROM ct")
def q_score_contamination(spark: SparkSession, d: str) -> DataFrame:
    return contamination(spark, d)


@query("epa_component", f"SELECT o_orderkey, cast({REGISTER_SQL} AS INT) AS epa, cast({INDUSTRY_SQL} AS INT) AS industrial FROM (SELECT o_orderkey, o_orderkey % 6 AS n_sites, o_orderkey * 7 % 2500 AS site_m, o_orderkey % 8 AS n_industrial, o_orderkey * 3 % 500 AS industrial_m FROM orders)")
def epa_component(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k, ladders.register_component(k * 7 % 2500, k % 6).alias("epa"), ladders.industrial_component(k * 3 % 500, k % 8).alias("industrial"))


def aircraft_exposure(props: DataFrame, contours: DataFrame) -> DataFrame:
    """(property_id, penalty_db, anef, zone_desc, impact, source) of every property; no contour, no penalty."""
    rows = nearby.beside(nearby.keyed(props).select("property_id"), contours)
    desc = F.coalesce(F.concat("airfield", F.lit(" - ANEF "), F.col("anef").cast("string"), F.lit("+")), F.lit("Outside airport noise overlay"))
    return rows.select("property_id", ladders.anef_penalty(F.col("anef")).alias("penalty_db"), "anef", desc.alias("zone_desc"), ladders.anef_impact(F.col("anef")).alias("impact"), F.coalesce("source", F.lit("national")).alias("source"))


PENALTY_SQL = "CASE WHEN anef >= 40 THEN 15.0::double WHEN anef >= 35 THEN 12.0::double WHEN anef >= 30 THEN 10.0::double WHEN anef >= 25 THEN 7.0::double WHEN anef >= 20 THEN 5.0::double WHEN anef >= 15 THEN 3.0::double ELSE 0.0::double END"
IMPACT_SQL = "CASE WHEN anef IS NULL THEN 'No aircraft noise overlay applies to this location.' WHEN anef >= 30 THEN 'Severe aircraft noise. Only commercial/industrial recommended.' WHEN anef >= 25 THEN 'Significant aircraft noise. Residential not recommended.' WHEN anef >= 20 THEN 'Moderate aircraft noise. Acoustic treatment required for dwellings.' WHEN anef >= 15 THEN 'Noticeable aircraft noise.' ELSE 'Minimal aircraft noise impact.' END"


def aircraft(spark: SparkSession, d: str) -> DataFrame:
    return aircraft_exposure(_props(spark, d), worst_contour(overlay_hits(spark, d, "aircraft")))


@query("aircraft_exposure", duckdb_ctes("v_properties", "v_overlays") + ",\n" + inside_sql("h", "aircraft") + ",\n" + CONTOUR_SQL + f"\nSELECT p.property_id, {PENALTY_SQL} AS penalty_db, anef, coalesce(airfield || ' - ANEF ' || anef || '+', 'Outside airport noise overlay') AS zone_desc, {IMPACT_SQL} AS impact, coalesce(source, 'national') AS source FROM v_properties p LEFT JOIN c ON p.property_id = c.property_id")
def q_aircraft(spark: SparkSession, d: str) -> DataFrame:
    return aircraft(spark, d)


@query("anef_penalty", f"SELECT o_orderkey, {PENALTY_SQL} AS penalty_db, {IMPACT_SQL} AS impact FROM (SELECT o_orderkey, o_orderkey % 50 AS anef FROM orders)")
def anef_penalty(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k, ladders.anef_penalty(k % 50).alias("penalty_db"), ladders.anef_impact(k % 50).alias("impact"))


@query("label_ladder", "SELECT o_orderkey, " + ", ".join(f"{label_sql(k, 'o_orderkey % 101')} AS {k}" for k in ladders.LABELS) + " FROM orders")
def label_ladder(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderkey") % 101
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *[ladders.label(k, s).alias(k) for k in ladders.LABELS])


