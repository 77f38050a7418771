"""Queries of the spatial joins, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.functions import geo, ladders
from siteline.operators import spatial
from siteline.plans import nearby
from siteline.registry import query
from siteline.sources.views import duckdb_ctes, view

R4 = lambda c, k=3: F.bround(F.col(c), k).alias(c)


def delta(r: float) -> str:
    return repr(geo.window_deg(r))


MDEG = "(111320.0::double * cos(radians(p.lat)))"


def in_window(r: float, x: str, y: str) -> str:
    d = delta(r)
    return f"{x} BETWEEN p.lng - {d}::double AND p.lng + {d}::double AND {y} BETWEEN p.lat - {d}::double AND p.lat + {d}::double"


def iso(x: str, y: str) -> str:
    return f"(sqrt(({x} - p.lng) * ({x} - p.lng) + ({y} - p.lat) * ({y} - p.lat)) * {MDEG})"


def aniso(x: str, y: str) -> str:
    return f"sqrt((({x} - p.lng) * {MDEG}) ** 2 + (({y} - p.lat) * 111320.0::double) ** 2)"


def near_segments_sql(name: str, r: float, source: str, cols: str) -> str:
    """CTE ``name``: properties with segments within r, with dist_m, near_lng and near_lat."""
    return f"""{name} AS (SELECT * FROM (
  SELECT property_id, {cols}, lat, lng, x1 + t * (x2 - x1) AS near_lng, y1 + t * (y2 - y1) AS near_lat,
    sqrt((x1 + t * (x2 - x1) - lng) ** 2 + (y1 + t * (y2 - y1) - lat) ** 2) * 111320.0::double * cos(radians(lat)) AS dist_m
  FROM (SELECT p.property_id, p.lat, p.lng, s.*, CASE WHEN (s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2 = 0 THEN 0.0::double ELSE
      greatest(0.0::double, least(1.0::double, ((p.lng - s.x1) * (s.x2 - s.x1) + (p.lat - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2))) END AS t
    FROM v_properties p JOIN {source} s ON {in_window(r, 's.xmin', 's.ymin')})) WHERE dist_m < {r})"""


def near_pois_sql(name: str, r: float) -> str:
    return f"{name} AS (SELECT * FROM (SELECT p.property_id, o.poi_id, o.category, {iso('o.lng', 'o.lat')} AS dist_m FROM v_properties p JOIN v_pois o ON {in_window(r, 'o.lng', 'o.lat')}) WHERE dist_m < {r})"


def near_buildings_sql(name: str, r: float) -> str:
    return f"{name} AS (SELECT * FROM (SELECT p.property_id, b.id, b.height, b.floors, sqrt(greatest(b.xmin - p.lng, 0.0::double, p.lng - b.xmax) ** 2 + greatest(b.ymin - p.lat, 0.0::double, p.lat - b.ymax) ** 2) * {MDEG} AS dist_m FROM v_properties p JOIN v_buildings b ON {in_window(r, 'b.xmin', 'b.ymin')}) WHERE dist_m < {r})"


def centres_sql(name: str, r: float) -> str:
    d = delta(r)
    return f"{name} AS (SELECT p.property_id, b.id, coalesce(b.height, 6.0::double) AS h, b.clng, b.clat FROM v_properties p JOIN v_buildings b ON b.xmin < p.lng + {d}::double AND b.xmax > p.lng - {d}::double AND b.ymin < p.lat + {d}::double AND b.ymax > p.lat - {d}::double)"


STATION_AGG = "st AS (SELECT station_id, road_name, lon, lat AS slat, cast(coalesce(max(CASE WHEN direction IS NULL THEN aadt END), sum(CASE WHEN direction IS NOT NULL THEN aadt END)) AS BIGINT) AS aadt, max(heavy_vehicle_pct) AS hv_pct FROM v_stations GROUP BY ALL)"


def near_stations_sql(name: str, r: float) -> str:
    return f"{STATION_AGG},\n{name} AS (SELECT * FROM (SELECT p.property_id, st.*, {aniso('st.lon', 'st.slat')} AS dist_m FROM v_properties p JOIN st ON st.aadt IS NOT NULL AND {in_window(r, 'st.lon', 'st.slat')}) WHERE dist_m < {r})"


def near_rail_sql(name: str, r: float) -> str:
    return f"""{name}_pts AS (SELECT *, row_number() OVER (PARTITION BY property_id, shape_id, route_type ORDER BY dist_m, seq) AS rn FROM (
  SELECT p.property_id, s.shape_id, s.route_type, s.sequence AS seq, s.lng AS near_lng, s.lat AS near_lat, {aniso('s.lng', 's.lat')} AS dist_m
  FROM v_properties p JOIN v_rail_shapes s ON {in_window(r, 's.lng', 's.lat')})),
{name} AS (SELECT n.property_id, n.shape_id, n.route_type, f.route_name, n.dist_m, f.peak, f.offpeak, n.near_lng, n.near_lat FROM {name}_pts n JOIN v_rail_frequency f ON n.shape_id = f.shape_id WHERE rn = 1 AND dist_m < {r})"""


def near_water_sql(name: str, r: float) -> str:
    d = delta(r)
    t = "CASE WHEN (w.x2 - w.x1) ** 2 + (w.y2 - w.y1) ** 2 = 0 THEN 0.0::double ELSE greatest(0.0::double, least(1.0::double, ((p.lng - w.x1) * (w.x2 - w.x1) + (p.lat - w.y1) * (w.y2 - w.y1)) / ((w.x2 - w.x1) ** 2 + (w.y2 - w.y1) ** 2))) END"
    return f"""{name} AS (SELECT property_id, water_id, class, subtype, dist_m FROM (
  SELECT property_id, water_id, class, subtype, CASE WHEN sum(c) % 2 = 1 THEN 0.0::double ELSE min(sqrt((x1 + t * (x2 - x1) - lng) ** 2 + (y1 + t * (y2 - y1) - lat) ** 2) * 111320.0::double * cos(radians(lat))) END AS dist_m
  FROM (SELECT p.property_id, p.lat, p.lng, w.*, {t} AS t,
          CASE WHEN (w.y1 > p.lat) <> (w.y2 > p.lat) AND p.lng < (w.x2 - w.x1) * (p.lat - w.y1) / CASE WHEN w.y2 = w.y1 THEN 1.0::double ELSE w.y2 - w.y1 END + w.x1 THEN 1 ELSE 0 END AS c
        FROM v_properties p JOIN v_water w ON w.xmin <= p.lng + {d}::double AND w.xmax >= p.lng - {d}::double AND w.ymin <= p.lat + {d}::double AND w.ymax >= p.lat - {d}::double)
  GROUP BY property_id, water_id, class, subtype) WHERE dist_m < {r})"""


def inside_sql(name: str, theme: str) -> str:
    return f"""{name} AS (SELECT property_id, overlay_id, layer_name, layer_no, severity, code, airfield, defence FROM (
  SELECT p.property_id, o.*, CASE WHEN (o.y1 > p.lat) <> (o.y2 > p.lat) AND p.lng < (o.x2 - o.x1) * (p.lat - o.y1) / CASE WHEN o.y2 = o.y1 THEN 1.0::double ELSE o.y2 - o.y1 END + o.x1 THEN 1 ELSE 0 END AS c
  FROM v_properties p JOIN v_overlays o ON o.theme = '{theme}' AND p.lng BETWEEN o.xmin AND o.xmax AND p.lat BETWEEN o.ymin AND o.ymax)
  GROUP BY ALL HAVING sum(c) % 2 = 1)"""


def _props(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_properties")


@query("join_within_roads", duckdb_ctes("v_properties", "v_roads") + ",\nsub AS (SELECT * FROM v_roads WHERE subtype = 'road'),\n" + near_segments_sql("n", 500, "sub", "road_id, class, speed_kmh") + "\nSELECT property_id, road_id, class, round_even(dist_m, 3) AS dist_m, speed_kmh, round_even(near_lng, 7) AS near_lng, round_even(near_lat, 7) AS near_lat FROM n")
def join_within_roads(spark: SparkSession, d: str) -> DataFrame:
    return nearby.roads(_props(spark, d), view(spark, d, "v_roads"), 500).select("property_id", "road_id", "class", R4("dist_m"), "speed_kmh", R4("near_lng", 7), R4("near_lat", 7))


@query("join_within_rail", duckdb_ctes("v_properties", "v_roads") + ",\nsub AS (SELECT * FROM v_roads WHERE subtype = 'rail'),\n" + near_segments_sql("n", 1000, "sub", "road_id, class") + "\nSELECT property_id, road_id, class, round_even(dist_m, 3) AS dist_m FROM n")
def join_within_rail(spark: SparkSession, d: str) -> DataFrame:
    return nearby.roads(_props(spark, d), view(spark, d, "v_roads"), 1000, "rail").select("property_id", "road_id", "class", R4("dist_m"))


@query("join_within_aadt", duckdb_ctes("v_properties", "v_aadt") + ",\n" + near_segments_sql("n", 500, "v_aadt", "seg_id, aadt, hv, road_name") + "\nSELECT property_id, seg_id, aadt, hv, road_name, round_even(dist_m, 3) AS dist_m FROM n")
def join_within_aadt(spark: SparkSession, d: str) -> DataFrame:
    return nearby.counted(_props(spark, d), view(spark, d, "v_aadt")).select("property_id", "seg_id", "aadt", "hv", "road_name", R4("dist_m"))


@query("join_within_stations", duckdb_ctes("v_properties", "v_stations") + ",\n" + near_stations_sql("n", 1000) + "\nSELECT property_id, station_id, aadt, hv_pct, road_name, round_even(dist_m, 3) AS dist_m FROM n")
def join_within_stations(spark: SparkSession, d: str) -> DataFrame:
    return nearby.stations(_props(spark, d), view(spark, d, "v_stations")).select("property_id", "station_id", "aadt", "hv_pct", "road_name", R4("dist_m"))


@query("join_within_pois", duckdb_ctes("v_properties", "v_pois") + ",\n" + near_pois_sql("n", 1500) + "\nSELECT property_id, poi_id, category, round_even(dist_m, 3) AS dist_m FROM n")
def join_within_pois(spark: SparkSession, d: str) -> DataFrame:
    return nearby.places(_props(spark, d), view(spark, d, "v_pois")).select("property_id", "poi_id", "category", R4("dist_m"))


@query("join_within_buildings", duckdb_ctes("v_properties", "v_buildings") + ",\n" + near_buildings_sql("n", 300) + "\nSELECT property_id, id, height, round_even(dist_m, 3) AS dist_m, floors FROM n")
def join_within_buildings(spark: SparkSession, d: str) -> DataFrame:
    return nearby.buildings(_props(spark, d), view(spark, d, "v_buildings"), 300).select("property_id", "id", "height", R4("dist_m"), "floors")


@query("join_overlap_buildings", duckdb_ctes("v_properties", "v_buildings") + ",\n" + centres_sql("n", 200) + "\nSELECT property_id, id, h, round_even(clng, 7) AS clng, round_even(clat, 7) AS clat FROM n")
def join_overlap_buildings(spark: SparkSession, d: str) -> DataFrame:
    return nearby.building_centres(_props(spark, d), view(spark, d, "v_buildings"), 200).select("property_id", "id", "h", R4("clng", 7), R4("clat", 7))


@query("join_within_water", duckdb_ctes("v_properties", "v_water") + ",\n" + near_water_sql("n", 5000) + "\nSELECT property_id, water_id, class, subtype, round_even(dist_m, 3) AS dist_m FROM n")
def join_within_water(spark: SparkSession, d: str) -> DataFrame:
    return nearby.water(_props(spark, d), view(spark, d, "v_water")).select("property_id", "water_id", "class", "subtype", R4("dist_m"))


@query("join_nearest_rail", duckdb_ctes("v_properties", "v_rail_shapes", "v_rail_frequency") + ",\n" + near_rail_sql("n", 1000) + "\nSELECT property_id, shape_id, route_type, route_name, round_even(dist_m, 3) AS dist_m, peak, offpeak FROM n")
def join_nearest_rail(spark: SparkSession, d: str) -> DataFrame:
    return nearby.rail(_props(spark, d), view(spark, d, "v_rail_shapes"), view(spark, d, "v_rail_frequency")).select("property_id", "shape_id", "route_type", "route_name", R4("dist_m"), "peak", "offpeak")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_grid").select(F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng"), "score", "r", "c")


def nearest_grid_sql(limit_m: float, corrected: bool) -> str:
    lim = limit_m / 111320.0
    scale = "cos(radians(p.lat))" if corrected else "1.0::double"
    return duckdb_ctes("v_properties", "v_grid") + f""", m AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY dd, r, c) AS rn FROM (
 SELECT p.property_id, g.score, g.r, g.c, sqrt((g.lat - p.lat) ** 2 + ((g.lng - p.lng) * {scale}) ** 2) AS dd
 FROM v_properties p JOIN v_grid g ON abs(g.lat - p.lat) <= {lim!r}::double AND abs(g.lng - p.lng) <= {lim!r}::double * 1.5::double) WHERE dd < {lim!r}::double)
SELECT property_id, score, r, c, round_even(dd * 111320.0::double, 3) AS dist_m FROM m WHERE rn = 1"""


@query("join_nearest_grid_noise", nearest_grid_sql(150, True))
def join_nearest_grid_noise(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_cell(nearby.keyed(_props(spark, d)), _grid(spark, d), 150, True, ["score", "r", "c"], ["r", "c"]).select("property_id", "score", "r", "c", R4("dist_m"))


@query("join_nearest_grid_flood", nearest_grid_sql(350, False))
def join_nearest_grid_flood(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_cell(nearby.keyed(_props(spark, d)), _grid(spark, d), 350, False, ["score", "r", "c"], ["r", "c"]).select("property_id", "score", "r", "c", R4("dist_m"))


def overlay_hits(spark: SparkSession, d: str, theme: str) -> DataFrame:
    edges = view(spark, d, "v_overlays").where(F.col("theme") == theme)
    return spatial.inside(nearby.keyed(_props(spark, d)), edges, "overlay_id", ["layer_name", "layer_no", "severity", "code", "airfield", "defence"])


FLOOD_RANK = "CASE severity WHEN 'floodway' THEN 0 WHEN 'flood' THEN 1 WHEN 'moderate' THEN 2 END"
FIRE_RANK = "CASE severity WHEN 'extreme' THEN 0 WHEN 'high' THEN 1 WHEN 'moderate' THEN 2 WHEN 'low' THEN 3 END"


def worst_overlay(hits: DataFrame, order: list[str]) -> DataFrame:
    """(property_id, worst, zones, n_zones): the worst severity hit and the names of hit layers in layer order, each layer
    once."""
    layers = hits.groupBy("property_id", "layer_no", "layer_name").agg(F.min(ladders.ranked(F.col("severity"), order)).alias("rank"))
    out = layers.groupBy("property_id").agg(F.min("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("layer_no", "layer_name"))).alias("z"))
    return out.select("property_id", F.get(F.array(*map(F.lit, order)), F.col("rank")).alias("worst"), F.array_join(F.col("z.layer_name"), ",").alias("zones"), F.size("z").cast("long").alias("n_zones"))


def worst_sql(name: str, rank: str, order: list[str], hits: str = "h") -> str:
    return f"{name} AS (SELECT property_id, [{', '.join(repr(x) for x in order)}][min(rank) + 1] AS worst, string_agg(layer_name, ',' ORDER BY layer_no, layer_name) AS zones, count(*) AS n_zones FROM (SELECT property_id, layer_no, layer_name, min({rank}) AS rank FROM {hits} GROUP BY ALL) GROUP BY property_id)"


FLOOD_ORDER, FIRE_ORDER = ["floodway", "flood", "moderate"], ["extreme", "high", "moderate", "low"]


@query("join_overlay_flood", duckdb_ctes("v_properties", "v_overlays") + ",\n" + inside_sql("h", "flood") + ",\n" + worst_sql("w", FLOOD_RANK, FLOOD_ORDER) + "\nSELECT * FROM w")
def join_overlay_flood(spark: SparkSession, d: str) -> DataFrame:
    return worst_overlay(overlay_hits(spark, d, "flood"), FLOOD_ORDER)


@query("join_overlay_bushfire", duckdb_ctes("v_properties", "v_overlays") + ",\n" + inside_sql("h", "bushfire") + ",\n" + worst_sql("w", FIRE_RANK, FIRE_ORDER) + "\nSELECT * FROM w")
def join_overlay_bushfire(spark: SparkSession, d: str) -> DataFrame:
    return worst_overlay(overlay_hits(spark, d, "bushfire"), FIRE_ORDER)


def first_int(text: Column, default: int = 20) -> Column:
    """The first integer in a text, else the default."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(default))


def worst_contour(hits: DataFrame) -> DataFrame:
    """(property_id, anef, airfield, source) of the loudest contour; civilian before defence at a tie, then by overlay."""
    rows = hits.withColumn("anef", first_int(F.col("code")))
    best = F.max_by(F.struct("anef", "airfield", "defence"), F.struct("anef", -F.col("defence"), -F.col("overlay_id"))).alias("b")
    return rows.groupBy("property_id").agg(best).select("property_id", "b.anef", "b.airfield", F.when(F.col("b.defence") == 1, "defence").otherwise("civilian").alias("source"))


CONTOUR_SQL = "c AS (SELECT property_id, anef, airfield, CASE WHEN defence = 1 THEN 'defence' ELSE 'civilian' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY anef DESC, defence, overlay_id) AS rn FROM (SELECT *, coalesce(try_cast(nullif(regexp_extract(code, '(\\d+)', 1), '') AS INT), 20) AS anef FROM h)) WHERE rn = 1)"


@query("join_overlay_aircraft", duckdb_ctes("v_properties", "v_overlays") + ",\n" + inside_sql("h", "aircraft") + ",\n" + CONTOUR_SQL + "\nSELECT * FROM c")
def join_overlay_aircraft(spark: SparkSession, d: str) -> DataFrame:
    return worst_contour(overlay_hits(spark, d, "aircraft"))


def register_sites(props: DataFrame, epa: DataFrame, radius_m: float = 2000) -> DataFrame:
    """(property_id, site_id, name, issue, dist_m) of registered sites of the property's state: a square window in VIC and
    NSW, a circle in WA; distances are rounded to metres."""
    half = radius_m / 111_000
    sites = epa.select("site_id", "name", "issue", F.col("state").alias("s_state"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    dist = geo.dist_anisotropic(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))
    square = (F.abs(F.col("s_lat") - F.col("lat")) <= half) & (F.abs(F.col("s_lng") - F.col("lng")) <= half)
    ok = (F.col("s_state") == F.col("state")) & F.when(F.col("state") == "WA", dist <= radius_m).otherwise(square & F.col("state").isin("VIC", "NSW"))
    with_state = nearby.keyed(props).withColumn("state", geo.state_of(F.col("lat"), F.col("lng"), geo.HAZARD_STATE_BOXES))
    return spatial.corner_join(with_state, sites, radius_m, "s_lng", "s_lat", ok).select("property_id", "site_id", "name", "issue", F.bround(dist).cast("long").alias("dist_m"))


def state_sql(boxes: list) -> str:
    return "CASE " + " ".join(f"WHEN lng BETWEEN {a}::double AND {c}::double AND lat BETWEEN {b}::double AND {e}::double THEN '{s}'" for s, a, b, c, e in boxes) + " END"


def epa_sql(name: str) -> str:
    h, dist = repr(2000 / 111_000), aniso("e.lng", "e.lat")
    square = f"abs(e.lat - p.lat) <= {h}::double AND abs(e.lng - p.lng) <= {h}::double"
    return f"""{name} AS (SELECT p.property_id, e.site_id, e.name, e.issue, cast(round_even({dist}, 0) AS BIGINT) AS dist_m FROM (SELECT *, {state_sql(geo.HAZARD_STATE_BOXES)} AS state FROM v_properties) p
  JOIN v_epa e ON e.state = p.state AND abs(e.lat - p.lat) <= 0.1::double WHERE (p.state IN ('VIC', 'NSW') AND {square}) OR (p.state = 'WA' AND {dist} <= 2000))"""


@query("join_epa_sites", duckdb_ctes("v_properties", "v_epa") + ",\n" + epa_sql("e") + "\nSELECT * FROM e")
def join_epa_sites(spark: SparkSession, d: str) -> DataFrame:
    return register_sites(_props(spark, d), view(spark, d, "v_epa"))


@query(
    "shapes_near",
    duckdb_ctes("v_properties", "v_rail_shapes")
    + f""", w AS (SELECT p.property_id, s.shape_id, s.route_type, s.sequence AS seq, s.lat AS s_lat, s.lng AS s_lng, {aniso('s.lng', 's.lat')} AS dm FROM v_properties p JOIN v_rail_shapes s ON {in_window(1000 * 2.0 / 1.5, 's.lng', 's.lat')})
SELECT property_id, shape_id, route_type, seq, round_even(s_lat, 4) AS s_lat, round_even(s_lng, 4) AS s_lng FROM w WHERE (property_id, shape_id) IN (SELECT (property_id, shape_id) FROM w GROUP BY property_id, shape_id HAVING min(dm) < 1000)""",
)
def shapes_near(spark: SparkSession, d: str) -> DataFrame:
    return nearby.shapes_near(_props(spark, d), view(spark, d, "v_rail_shapes")).select("property_id", "shape_id", "route_type", "seq", R4("s_lat", 4), R4("s_lng", 4))


@query(
    "join_nearest_rain",
    duckdb_ctes("v_properties", "v_grid")
    + """, g AS (SELECT lat, lng, cast(score AS double) AS p95, score * 2.0::double AS p99, r, c FROM v_grid WHERE r % 20 = 0 AND c % 20 = 0)
SELECT property_id, p95, p99, round_even(dd, 4) AS dist_deg FROM (SELECT p.property_id, g.*, sqrt((g.lat - p.lat) ** 2 + (g.lng - p.lng) ** 2) AS dd, row_number() OVER (PARTITION BY p.property_id ORDER BY sqrt((g.lat - p.lat) ** 2 + (g.lng - p.lng) ** 2), r, c) AS rn FROM v_properties p JOIN g ON abs(g.lat - p.lat) <= 2 AND abs(g.lng - p.lng) <= 2) WHERE rn = 1 AND dd <= 2""",
)
def join_nearest_rain(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d).where("r % 20 = 0 and c % 20 = 0").select("g_lat", "g_lng", F.col("score").cast("double").alias("p95"), (F.col("score") * F.lit(2.0)).alias("p99"), "r", "c")
    return nearest_rain(nearby.keyed(_props(spark, d)), grid).select("property_id", "p95", "p99", R4("dist_deg", 4))


def nearest_rain(props: DataFrame, grid: DataFrame, limit_deg: float = 2.0) -> DataFrame:
    """(property_id, p95, p99, dist_deg) of the nearest rain cell within the limit, in plain degrees.

    A window of the whole limit can hold thousands of cells, so a property looks within a small radius first; a cell found
    there is the nearest of all. Only properties that have none go on to the next radius.
    """
    found = []
    for share in (64, 8, 1):
        most = limit_deg * geo.M_PER_DEG * (1 + 1e-12) / share
        found.append(spatial.nearest_cell(props, grid, most, False, ["p95", "p99"], ["r", "c"]))
        props = props.join(found[-1].select("property_id").hint("merge"), "property_id", "left_anti")
    out = reduce(DataFrame.unionByName, found)
    return out.select("property_id", "p95", "p99", (F.col("dist_m") / geo.M_PER_DEG).alias("dist_deg"))
