"""Queries of sources, predicates, spatial and scalar functions, and of what the noise levels are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.functions import acoustics as ac
from siteline.functions import geo, ladders, places
from siteline.operators import raster, spatial
from siteline.plans import nearby
from siteline.plans.q_etl import overwrite_partitions, shared_folder
from siteline.plans.q_nearby import R4, aniso, centres_sql, first_int, in_window, iso, near_pois_sql, near_rail_sql, near_segments_sql, state_sql
from siteline.plans.q_noise import CLASS_AADT_SQL, LDEN_SQL, crtn_sql, path_samples, period_sql, rail_sql, track_sql
from siteline.plans.q_scores import GROUP_SQL, ladder_sql, sql_any
from siteline.registry import query
from siteline.sources import layout
from siteline.sources.views import duckdb_ctes, view

K = "o_orderkey"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


# -- sources ---------------------------------------------------------------------------------------------------------

BOX = BOX_CORNERS = (144.92, -37.88, 144.98, -37.82)


@query("scan_features", duckdb_ctes("v_roads") + f"\nSELECT road_id, class FROM v_roads WHERE xmin BETWEEN {BOX[0]}::double AND {BOX[2]}::double AND ymin BETWEEN {BOX[1]}::double AND {BOX[3]}::double")
def scan_features(spark: SparkSession, d: str) -> DataFrame:
    """Roads whose least corner lies in a window, from a file laid out for it."""
    path = shared_folder(spark)
    layout.write_features(view(spark, d, "v_roads"), path)
    return layout.features_from(spark, path, BOX_CORNERS).select("road_id", "class")


@query("extract_region", duckdb_ctes("v_roads") + f"\nSELECT road_id, class, subtype FROM v_roads WHERE xmin <= {BOX[2]}::double AND xmax >= {BOX[0]}::double AND ymin <= {BOX[3]}::double AND ymax >= {BOX[1]}::double")
def extract_region(spark: SparkSession, d: str) -> DataFrame:
    """Roads whose box overlaps a window, from a file laid out for it."""
    path = shared_folder(spark)
    layout.write_features(view(spark, d, "v_roads"), path)
    return layout.features_over(spark, path, BOX_CORNERS).select("road_id", "class", "subtype")


@query("raster_cell_source", duckdb_ctes("v_raster") + "\nSELECT row // 50 AS tile_y, col // 50 AS tile_x, count(*) AS n, cast(sum(value) AS BIGINT) AS total FROM v_raster GROUP BY ALL")
def raster_cell_source(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a dataset from landed tiles, counted by squares of 50."""
    path = shared_folder(spark)
    raster.land(raster.tiles(view(spark, d, "v_raster").withColumn("dataset", F.lit("water")), ["dataset"]), path)
    tile = lambda c: F.expr(f"cast({c} div 50 as int)")
    cells = raster.cells_of(raster.landed(spark, path, "water"))
    return cells.groupBy(tile("row").alias("tile_y"), tile("col").alias("tile_x")).agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


@query("explode_daily_series", duckdb_ctes("v_climate") + "\nSELECT cell_id, day, temperature_2m_max AS t, precipitation AS p FROM v_climate")
def explode_daily_series(spark: SparkSession, d: str) -> DataFrame:
    """One row per day from a cell's parallel arrays of days and values."""
    s = F.sort_array(F.collect_list(F.struct("day", "temperature_2m_max", "precipitation")))
    cells = view(spark, d, "v_climate").groupBy("cell_id").agg(s.alias("s"))
    arrays = cells.select("cell_id", F.col("s.day").alias("time"), F.col("s.temperature_2m_max").alias("t"), F.col("s.precipitation").alias("p"))
    return arrays.select("cell_id", F.explode(F.arrays_zip("time", "t", "p")).alias("z")).select("cell_id", F.col("z.time").alias("day"), "z.t", "z.p")


@query("replace_partition", duckdb_ctes("v_stations") + "\nSELECT station_id, state, aadt, direction FROM v_stations WHERE state <> 'WA' UNION ALL SELECT station_id, state, aadt + 1, direction FROM v_stations WHERE state = 'WA'")
def replace_partition(spark: SparkSession, d: str) -> DataFrame:
    """A table by state of which one state is written anew; the other partitions' files stay."""
    path, s = shared_folder(spark), view(spark, d, "v_stations").select("station_id", "state", "aadt", "direction")
    s.write.partitionBy("state").parquet(path)
    overwrite_partitions(s.where("state = 'WA'").withColumn("aadt", F.col("aadt") + 1), path, ["state"])
    return spark.read.parquet(path).select("station_id", "state", "aadt", "direction")


@query("union_states", duckdb_ctes("v_stations") + "\nSELECT state, count(*) AS n FROM (SELECT station_id, 'VIC' AS state FROM v_stations WHERE state = 'VIC' UNION ALL SELECT station_id, 'NSW' FROM v_stations WHERE state = 'NSW') GROUP BY state")
def union_states(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "v_stations")
    parts = [s.where(F.col("state") == k).select("station_id").withColumn("state", F.lit(k)) for k in ("VIC", "NSW")]
    return parts[0].unionByName(parts[1]).groupBy("state").agg(F.count("*").alias("n"))


@query("concat_layers", "SELECT s_suppkey, 'calendar' AS layer, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'financial', NULL FROM supplier WHERE s_suppkey % 2 = 1")
def concat_layers(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    cal = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("calendar").alias("layer"), "s_acctbal")
    return cal.unionByName(s.where("s_suppkey % 2 = 1").select("s_suppkey", F.lit("financial").alias("layer")), allowMissingColumns=True)


# -- projections and predicates -------------------------------------------------------------------------------------


@query("nested_projection", duckdb_ctes("v_roads") + "\nSELECT road_id, xmin AS x, speed_kmh AS speed FROM v_roads")
def nested_projection(spark: SparkSession, d: str) -> DataFrame:
    """Dotted access to a struct, and the first speed limit of a list that may be null or empty."""
    limits = F.when(F.col("speed_kmh").isNotNull(), F.array(F.struct(F.struct(F.col("speed_kmh").alias("value")).alias("max_speed"))))
    r = view(spark, d, "v_roads").select("road_id", F.struct("xmin", "ymin").alias("bbox"), limits.alias("speed_limits"))
    return r.select("road_id", F.col("bbox.xmin").alias("x"), F.when(F.size("speed_limits") > 0, F.get("speed_limits", F.lit(0))["max_speed"]["value"]).alias("speed"))


@query("bbox_corner_filter", duckdb_ctes("v_properties", "v_roads") + f"\nSELECT p.property_id, count(*) AS n FROM v_properties p JOIN v_roads r ON {in_window(300, 'r.xmin', 'r.ymin')} GROUP BY 1")
def bbox_corner_filter(spark: SparkSession, d: str) -> DataFrame:
    pairs = spatial.corner_join(nearby.keyed(view(spark, d, "v_properties")), view(spark, d, "v_roads").select("road_id", "xmin", "ymin"), 300, "xmin", "ymin")
    return pairs.groupBy("property_id").agg(F.count("*").alias("n"))


@query("bbox_overlap_filter", duckdb_ctes("v_properties", "v_buildings") + ",\n" + centres_sql("n", 300) + "\nSELECT property_id, count(*) AS n FROM n GROUP BY 1")
def bbox_overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearby.building_centres(view(spark, d, "v_properties"), view(spark, d, "v_buildings"), 300)
    return pairs.groupBy("property_id").agg(F.count("*").alias("n"))


@query("radius_filter", duckdb_ctes("v_properties", "v_pois") + ",\n" + near_pois_sql("n", 800) + "\nSELECT property_id, count(*) AS n FROM n GROUP BY 1")
def radius_filter(spark: SparkSession, d: str) -> DataFrame:
    return nearby.places(view(spark, d, "v_properties"), view(spark, d, "v_pois"), 800).groupBy("property_id").agg(F.count("*").alias("n"))


@query("motor_road_filter", duckdb_ctes("v_roads") + "\nSELECT class, count(*) AS n FROM v_roads WHERE class NOT IN ('footway', 'path', 'steps', 'cycleway', 'pedestrian', 'track') GROUP BY 1")
def motor_road_filter(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_roads").where(places.is_motor(F.col("class"))).groupBy("class").agg(F.count("*").alias("n"))


@query("detect_state", f"SELECT {K}, {state_sql(geo.STATE_BOXES)} AS state, {state_sql(geo.HAZARD_STATE_BOXES)} AS hazard_state FROM (SELECT {K}, 110 + ({K} * 37 % 4700) / 100.0::double AS lng, -45 + ({K} * 53 % 3600) / 100.0::double AS lat FROM orders)")
def detect_state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    pts = _orders(spark, d).select(K, (110 + (k * 37 % 4700) / F.lit(100.0)).alias("lng"), (-45 + (k * 53 % 3600) / F.lit(100.0)).alias("lat"))
    return pts.select(K, geo.state_of(F.col("lat"), F.col("lng")).alias("state"), geo.state_of(F.col("lat"), F.col("lng"), geo.HAZARD_STATE_BOXES).alias("hazard_state"))


def not_like(a: Column, b: Column, patterns: list[str]) -> Column:
    """Whether neither name holds any of the patterns, whatever its case; null names hold none."""
    out = F.lit(True)
    for p in patterns:
        out = out & ~F.lower(F.coalesce(a, F.lit(""))).contains(p) & ~F.lower(F.coalesce(b, F.lit(""))).contains(p)
    return out


@query("like_exclusions", "SELECT p_partkey FROM part WHERE lower(coalesce(p_name, '')) NOT LIKE '%ring%' AND lower(coalesce(p_type, '')) NOT LIKE '%ring%' AND lower(coalesce(p_name, '')) NOT LIKE '%econ%' AND lower(coalesce(p_type, '')) NOT LIKE '%econ%'")
def like_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").where(not_like(F.col("p_name"), F.col("p_type"), ["ring", "econ"])).select("p_partkey")


@query("strip_quotes", "SELECT p_partkey, trim('\"' || p_name || '\"', '\"') AS name FROM part")
def strip_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.btrim(q, F.lit('"')).alias("name"))


@query("match_category", duckdb_ctes("v_pois") + f"\nSELECT poi_id, {GROUP_SQL} AS grp FROM v_pois")
def match_category(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_pois").select("poi_id", places.match_group(F.col("category")).alias("grp"))


@query("green_match", duckdb_ctes("v_pois") + f"\nSELECT poi_id, {sql_any('category', places.GREEN)} AS green FROM v_pois")
def green_match(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_pois").select("poi_id", places.is_green(F.col("category")).alias("green"))


@query("industrial_match", duckdb_ctes("v_pois") + f"\nSELECT poi_id, {sql_any('category', places.INDUSTRIAL)} AND NOT {sql_any('category', places.INDUSTRIAL_EXCLUDE)} AS industrial FROM v_pois")
def industrial_match(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_pois").select("poi_id", places.is_industrial(F.col("category")).alias("industrial"))


@query("noise_poi_match", duckdb_ctes("v_properties", "v_pois") + ",\n" + near_pois_sql("n", 2000) + f"\nSELECT property_id, count(*) FILTER ({sql_any('category', places.NOISY)}) AS noisy, CASE WHEN b < 200 THEN 'Surf noise likely dominant' WHEN b < 500 THEN 'Surf noise audible' WHEN b < 1000 THEN 'Surf noise faint' END AS surf FROM (SELECT *, min(CASE WHEN category LIKE '%beach%' THEN dist_m END) OVER (PARTITION BY property_id) AS b FROM n) GROUP BY property_id, b")
def noise_poi_match(spark: SparkSession, d: str) -> DataFrame:
    n = nearby.places(view(spark, d, "v_properties"), view(spark, d, "v_pois"), 2000)
    beach = F.min(F.when(places.has_any(F.col("category"), ["beach"]), F.col("dist_m")))
    out = n.groupBy("property_id").agg(F.count_if(places.is_noisy(F.col("category"))).alias("noisy"), beach.alias("b"))
    return out.select("property_id", "noisy", places.surf_note(F.col("b")).alias("surf"))


@query("quality_filter", duckdb_ctes("v_measured") + "\nSELECT property_id, measure_count >= 5 AND la50 BETWEEN 40 AND 80 AS train, measure_count >= 3 AND laeq >= 50 AS hexagon, measure_count >= 3 AS counted FROM v_measured")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("measure_count")
    return view(spark, d, "v_measured").select("property_id", ((n >= 5) & F.col("la50").between(40, 80)).alias("train"), ((n >= 3) & (F.col("laeq") >= 50)).alias("hexagon"), (n >= 3).alias("counted"))


# -- spatial functions ----------------------------------------------------------------------------------------------

PAIR_SQL = duckdb_ctes("v_properties", "v_stations") + ",\npr AS (SELECT p.*, s.station_id, s.lon AS x, s.lat AS y FROM v_properties p JOIN v_stations s ON s.direction = 'N' AND s.station_id = p.property_id % 100)\n"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "v_stations").where("direction = 'N'").select("station_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return view(spark, d, "v_properties").join(s, F.col("property_id") % 100 == F.col("station_id"))




def _place() -> tuple[Column, Column, Column, Column]:
    return F.col("lat"), F.col("lng"), F.col("y"), F.col("x")


@query("dist_isotropic", PAIR_SQL + f"SELECT property_id, round_even({iso('x', 'y').replace('p.', '')}, 3) AS m FROM pr")
def dist_isotropic(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("property_id", F.bround(geo.dist_isotropic(*_place()), 3).alias("m"))


@query("dist_anisotropic", PAIR_SQL + f"SELECT property_id, round_even({aniso('x', 'y').replace('p.', '')}, 3) AS m FROM pr")
def dist_anisotropic(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("property_id", F.bround(geo.dist_anisotropic(*_place()), 3).alias("m"))


@query("closest_point", duckdb_ctes("v_properties", "v_roads") + ",\n" + near_segments_sql("n", 200, "v_roads", "road_id, class") + "\nSELECT property_id, road_id, round_even(near_lng, 7) AS x, round_even(near_lat, 7) AS y FROM n")
def closest_point(spark: SparkSession, d: str) -> DataFrame:
    segs = view(spark, d, "v_roads").select("road_id", "x1", "y1", "x2", "y2", "xmin", "ymin")
    n = spatial.near_segments(nearby.keyed(view(spark, d, "v_properties")), segs, 200)
    return n.select("property_id", "road_id", F.bround("near_lng", 7).alias("x"), F.bround("near_lat", 7).alias("y"))


def _rings(spark: SparkSession, d: str) -> DataFrame:
    """Closed rings of the derived water bodies as arrays of (x, y)."""
    w = view(spark, d, "v_water").groupBy("water_id").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("s"))
    points = F.transform("s", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return w.select("water_id", F.concat(points, F.slice(points, 1, 1)).alias("ring"))


@query("polygon_centroid", duckdb_ctes("v_water") + "\nSELECT water_id, round_even(x0 + sum((ax + bx) * c) / (3 * sum(c)), 7) AS x, round_even(y0 + sum((ay + by_) * c) / (3 * sum(c)), 7) AS y FROM (SELECT *, ax * by_ - bx * ay AS c FROM (SELECT water_id, x0, y0, x1 - x0 AS ax, y1 - y0 AS ay, x2 - x0 AS bx, y2 - y0 AS by_ FROM (SELECT *, first_value(x1) OVER w AS x0, first_value(y1) OVER w AS y0 FROM v_water WINDOW w AS (PARTITION BY water_id ORDER BY i)))) GROUP BY water_id, x0, y0")
def polygon_centroid(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.polygon_centroid(F.col("ring"))
    return _rings(spark, d).select("water_id", F.bround(x, 7).alias("x"), F.bround(y, 7).alias("y"))


@query("vertex_mean", duckdb_ctes("v_water") + "\nSELECT water_id, round_even((sum(x1) + max(CASE WHEN i = 0 THEN x1 END)) / 9, 6) AS x, round_even((sum(y1) + max(CASE WHEN i = 0 THEN y1 END)) / 9, 6) AS y FROM v_water GROUP BY 1")
def vertex_mean(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.vertex_mean(F.col("ring"))
    return _rings(spark, d).select("water_id", F.bround(x, 6).alias("x"), F.bround(y, 6).alias("y"))


@query("point_in_polygon", duckdb_ctes("v_properties", "v_overlays") + "\nSELECT property_id, overlay_id FROM (SELECT p.property_id, o.overlay_id, CASE WHEN (o.y1 > p.lat) <> (o.y2 > p.lat) AND p.lng < (o.x2 - o.x1) * (p.lat - o.y1) / nullif(o.y2 - o.y1, 0) + o.x1 THEN 1 ELSE 0 END AS c FROM v_properties p JOIN v_overlays o ON p.lng BETWEEN o.xmin AND o.xmax AND p.lat BETWEEN o.ymin AND o.ymax) GROUP BY ALL HAVING sum(c) % 2 = 1")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside(nearby.keyed(view(spark, d, "v_properties")), view(spark, d, "v_overlays").select("overlay_id", "x1", "y1", "x2", "y2", "xmin", "xmax", "ymin", "ymax"), "overlay_id", [])


@query("bearing_sector", PAIR_SQL + "SELECT property_id, round_even(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END, 6) AS rad, cast(floor(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END / (2 * pi() / 8)) % 8 AS INT) AS sector FROM (SELECT *, atan2((x - lng) * cos(radians((lat + y) / 2)), y - lat) AS t FROM pr)")
def bearing_sector(spark: SparkSession, d: str) -> DataFrame:
    b = geo.bearing(*_place())
    return _pairs(spark, d).select("property_id", F.bround(b, 6).alias("rad"), geo.sector(b).alias("sector"))


@query("ray_project", PAIR_SQL + "SELECT property_id, round_even(size, 3) AS size, round_even((bx * dx + by_ * dy) / CASE WHEN size = 0 THEN 1.0::double ELSE size END, 3) AS along, round_even(abs(by_ * dx - bx * dy) / CASE WHEN size = 0 THEN 1.0::double ELSE size END, 3) AS off FROM (SELECT *, sqrt(dx * dx + dy * dy) AS size FROM (SELECT property_id, (lng - x) * k AS dx, (lat - y) * 111320.0::double AS dy, (lng + 0.001::double - x) * k AS bx, (lat + 0.002::double - y) * 111320.0::double AS by_ FROM (SELECT *, 111320.0::double * cos(radians((y + lat) / 2)) AS k FROM pr)))")
def ray_project(spark: SparkSession, d: str) -> DataFrame:
    s, a, o = geo.ray_project(F.col("y"), F.col("x"), F.col("lat"), F.col("lng"), F.col("lat") + 0.002, F.col("lng") + 0.001)
    return _pairs(spark, d).select("property_id", F.bround(s, 3).alias("size"), F.bround(a, 3).alias("along"), F.bround(o, 3).alias("off"))


@query("tile_key", duckdb_ctes("v_properties") + "\nSELECT property_id, CASE WHEN floor(lng / 10) * 10 IN (110, 120, 130, 140, 150) AND floor(abs(lat) / 10) * 10 IN (10, 20, 30, 40) THEN cast(floor(lng / 10) * 10 AS INT) || 'E_' || cast(floor(abs(lat) / 10) * 10 AS INT) || 'S' END AS coarse, 'S' || lpad(cast(cast(ceil(abs(lat)) AS INT) AS VARCHAR), 2, '0') || '_00_E' || lpad(cast(cast(floor(lng) AS INT) AS VARCHAR), 3, '0') || '_00' AS fine FROM v_properties")
def tile_key(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_properties").select("property_id", geo.coarse_tile(F.col("lat"), F.col("lng")).alias("coarse"), geo.fine_tile(F.col("lat"), F.col("lng")).alias("fine"))


@query("sinusoidal_xy", duckdb_ctes("v_properties") + "\nSELECT property_id, round_even(6371007.181::double * radians(lng) * cos(radians(lat)), 2) AS x, round_even(6371007.181::double * radians(lat), 2) AS y FROM v_properties")
def sinusoidal_xy(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.sinusoidal(F.col("lat"), F.col("lng"))
    return view(spark, d, "v_properties").select("property_id", F.bround(x, 2).alias("x"), F.bround(y, 2).alias("y"))


@query("ray_samples", PAIR_SQL + "SELECT property_id, cast(i AS INT) AS i, round_even(y + i / 6.0::double * (lat - y), 6) AS s_lat, round_even(x + i / 6.0::double * (lng - x), 6) AS s_lng FROM pr, range(0, 7) t(i)")
def ray_samples(spark: SparkSession, d: str) -> DataFrame:
    s = path_samples(_pairs(spark, d).select("property_id", "lat", "lng", F.col("x").alias("src_lng"), F.col("y").alias("src_lat")), 7)
    return s.select("property_id", "i", R4("s_lat", 6), R4("s_lng", 6))


# -- scalar functions -----------------------------------------------------------------------------------------------


@query("crtn_level", f"SELECT {K}, round_even({crtn_sql(f'({K} * 7 % 60000)', f'(({K} * 13 % 5000) / 10.0::double)', f'({K} % 30)::double', f'({K} % 4 * 30)::double')}, 4) AS db FROM orders")
def crtn_level(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    return _orders(spark, d).select(K, F.bround(ac.crtn_level(k * 7 % 60000, (k * 13 % 5000) / F.lit(10.0), (k % 30).cast("double"), (k % 4 * 30).cast("double")), 4).alias("db"))


RAIL_IN = f"(SELECT {K}, CASE {K} % 4 WHEN 0 THEN 'tram' WHEN 1 THEN 'train' WHEN 2 THEN 'vline' ELSE 'ferry' END AS kind, CASE {K} % 4 WHEN 0 THEN 'tram' WHEN 1 THEN 'standard_gauge' WHEN 2 THEN 'narrow_gauge' ELSE 'mono' END AS cls, ({K} * 13 % 10000) / 10.0::double AS m, ({K} % 23)::double AS n FROM orders)"


def _rail_in(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % 4).cast("int"))
    return _orders(spark, d).select(K, pick("tram", "train", "vline", "ferry").alias("kind"), pick("tram", "standard_gauge", "narrow_gauge", "mono").alias("cls"), ((k * 13 % 10000) / F.lit(10.0)).alias("m"), (k % 23).cast("double").alias("n"))


@query("rail_level", f"SELECT {K}, CASE WHEN kind = 'ferry' THEN 0.0::double ELSE round_even({rail_sql('kind', 'm', 'n')}, 4) END AS db FROM {RAIL_IN}")
def rail_level(spark: SparkSession, d: str) -> DataFrame:
    return _rail_in(spark, d).select(K, F.bround(ac.rail_level(F.col("kind"), F.col("m"), F.col("n")), 4).alias("db"))


@query("rail_level_fallback", f"SELECT {K}, round_even({track_sql('cls', 'm')}, 4) AS db FROM {RAIL_IN}")
def rail_level_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _rail_in(spark, d).select(K, F.bround(ac.rail_level_fallback(F.col("cls"), F.col("m")), 4).alias("db"))


JOINT_SQL = "CASE " + " ".join(f"WHEN class = '{c}' AND b = {s} THEN {v}" for c, by in ac.CLASS_SPEED_AADT.items() for s, v in by.items()) + " END"
NEAREST_SPEED_SQL = "list_sort([" + ", ".join(f"{{'d': abs({k} - speed_kmh), 'i': {i}, 'v': {v}}}" for i, (k, v) in enumerate(ac.SPEED_TO_AADT.items())) + "])[1].v"


@query("estimate_aadt", duckdb_ctes("v_roads") + f"\nSELECT road_id, cast(CASE WHEN speed_kmh > 0 THEN coalesce({JOINT_SQL}, {NEAREST_SPEED_SQL}) ELSE {CLASS_AADT_SQL} END AS INT) AS aadt FROM (SELECT *, cast(round_even(speed_kmh / 10, 0) * 10 AS INT) AS b FROM v_roads)")
def estimate_aadt(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_roads").select("road_id", ac.estimate_aadt(F.col("class"), F.col("speed_kmh")).alias("aadt"))


LEVELS_IN = f"(SELECT {K}, 35 + ({K} * 7 % 500) / 10.0::double AS leq_day, 30 + ({K} * 11 % 500) / 10.0::double AS leq_eve, 25 + ({K} * 13 % 500) / 10.0::double AS leq_night FROM orders)"


def _levels_in(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    return _orders(spark, d).select(K, *[(b + (k * m % 500) / F.lit(10.0)).alias(c) for b, m, c in ((35, 7, "leq_day"), (30, 11, "leq_eve"), (25, 13, "leq_night"))])


@query("lden", f"SELECT {K}, round_even({LDEN_SQL}, 4) AS lden FROM {LEVELS_IN}")
def lden(spark: SparkSession, d: str) -> DataFrame:
    return _levels_in(spark, d).select(K, F.bround(ac.lden(F.col("leq_day"), F.col("leq_eve"), F.col("leq_night")), 4).alias("lden"))


@query("period_leq", f"SELECT {K}, round_even(leq_day, 4) AS leq_day, round_even(leq_eve, 4) AS leq_eve, round_even(leq_night, 4) AS leq_night, round_even(leq_24h, 4) AS leq_24h FROM (SELECT {K}, {period_sql('road', 'rail', 'air')} FROM (SELECT {K}, ({K} * 7 % 900) / 10.0::double AS road, ({K} * 11 % 800) / 10.0::double AS rail, ({K} % 3 * 20)::double AS air FROM orders))")
def period_leq(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    p = ac.period_levels((k * 7 % 900) / F.lit(10.0), (k * 11 % 800) / F.lit(10.0), (k % 3 * 20).cast("double"))
    return _orders(spark, d).select(K, *[F.bround(v, 4).alias(n) for n, v in p.items()])


@query("maekawa", f"SELECT {K}, round_even(CASE WHEN t > 0 THEN least(10 * log10(3 + 20 * (2 * t / 0.34::double) ** 2), 20.0::double) END, 4) AS building, round_even(CASE WHEN t > 0 THEN least(10 * log10(3 + 20 * (2 * t / 0.34::double) ** 2), 15.0::double) END, 4) AS terrain FROM (SELECT {K}, ({K} % 200 - 20) / 100.0::double AS t FROM orders)")
def maekawa(spark: SparkSession, d: str) -> DataFrame:
    t = (F.col(K) % 200 - 20) / F.lit(100.0)
    return _orders(spark, d).select(K, F.bround(ac.maekawa(t, ac.BARRIER_CAP), 4).alias("building"), F.bround(ac.maekawa(t, ac.TERRAIN_CAP), 4).alias("terrain"))


@query("parse_first_int", f"SELECT {K}, coalesce(try_cast(nullif(regexp_extract(t, '(\\d+)', 1), '') AS INT), 20) AS n FROM (SELECT {K}, CASE {K} % 3 WHEN 0 THEN 'ANEF ' || ({K} % 50) || ' - 60' WHEN 1 THEN o_orderpriority ELSE 'none' END AS t FROM orders)")
def parse_first_int(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    t = F.when(k % 3 == 0, F.concat(F.lit("ANEF "), (k % 50).cast("string"), F.lit(" - 60"))).when(k % 3 == 1, F.col("o_orderpriority")).otherwise("none")
    return _orders(spark, d).select(K, first_int(t).alias("n"))


@query("confidence_range", f"SELECT {K}, round_even(ci, 2) AS ci, round_even(greatest(l - ci, 35.0::double), 2) AS low, round_even(l + ci, 2) AS high FROM (SELECT *, {ladder_sql('l', [(50, '8.0::double'), (60, '5.0::double')], '4.0::double')} + CASE WHEN n > 0 THEN 0.0::double ELSE 3.0::double END AS ci FROM (SELECT {K}, 35 + ({K} % 400) / 10.0::double AS l, {K} % 3 AS n FROM orders))")
def confidence_range(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    ci, low, high = ladders.confidence(35 + (k % 400) / F.lit(10.0), k % 3)
    return _orders(spark, d).select(K, F.bround(ci, 2).alias("ci"), F.bround(low, 2).alias("low"), F.bround(high, 2).alias("high"))


@query("sample_weight", duckdb_ctes("v_measured") + "\nSELECT property_id, least(measure_count / 10.0::double, 5.0::double) AS w FROM v_measured")
def sample_weight(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_measured").select("property_id", F.least(F.col("measure_count") / F.lit(10.0), F.lit(5.0)).alias("w"))


@query("modelled_lden", f"SELECT {K}, round_even(CASE WHEN dd > 0 THEN {LDEN_SQL} ELSE 0.0::double END, 4) AS lden FROM (SELECT {K}, dd, dd AS leq_day, CASE WHEN coalesce(ee, 0) > 0 THEN ee ELSE dd - 5 END AS leq_eve, CASE WHEN coalesce(nn, 0) > 0 THEN nn ELSE dd - 10 END AS leq_night FROM (SELECT {K}, CASE WHEN {K} % 11 = 0 THEN 0.0::double ELSE 40 + ({K} % 300) / 10.0::double END AS dd, CASE WHEN {K} % 3 = 0 THEN NULL ELSE 35 + ({K} % 250) / 10.0::double END AS ee, CASE WHEN {K} % 5 = 0 THEN 0.0::double ELSE 30 + ({K} % 200) / 10.0::double END AS nn FROM orders))")
def modelled_lden(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    dd = F.when(k % 11 == 0, F.lit(0.0)).otherwise(40 + (k % 300) / F.lit(10.0))
    ee = F.when(k % 3 != 0, 35 + (k % 250) / F.lit(10.0))
    nn = F.when(k % 5 == 0, F.lit(0.0)).otherwise(30 + (k % 200) / F.lit(10.0))
    return _orders(spark, d).select(K, F.bround(ac.modelled_lden(dd, ee, nn), 4).alias("lden"))


@query("order_by_distance", duckdb_ctes("v_properties", "v_pois") + ",\n" + near_pois_sql("n", 1000) + "\nSELECT property_id, poi_id, cast(row_number() OVER (PARTITION BY property_id ORDER BY dist_m, poi_id) AS INT) AS place FROM n")
def order_by_distance(spark: SparkSession, d: str) -> DataFrame:
    n = nearby.places(view(spark, d, "v_properties"), view(spark, d, "v_pois"), 1000)
    return n.select("property_id", "poi_id", F.row_number().over(Window.partitionBy("property_id").orderBy("dist_m", "poi_id")).alias("place"))


@query("nearest_by_group", duckdb_ctes("v_properties", "v_rail_shapes", "v_rail_frequency") + ",\n" + near_rail_sql("n", 1000) + "\nSELECT property_id, shape_id, route_type, round_even(dist_m, 3) AS dist_m, round_even(near_lng, 6) AS x, round_even(near_lat, 6) AS y FROM n_pts WHERE rn = 1 AND dist_m < 1000")
def nearest_by_group(spark: SparkSession, d: str) -> DataFrame:
    pts = view(spark, d, "v_rail_shapes").select("shape_id", "route_type", F.col("sequence").alias("seq"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    pairs = spatial.near_points(nearby.keyed(view(spark, d, "v_properties")), pts, 1000, "s_lng", "s_lat", "anisotropic")
    best = spatial.nearest_by_group(pairs, ["property_id", "shape_id", "route_type"], "dist_m", ["s_lng", "s_lat"], 1000, ["seq"])
    return best.select("property_id", "shape_id", "route_type", R4("dist_m"), F.bround("s_lng", 6).alias("x"), F.bround("s_lat", 6).alias("y"))


@query("station_aadt", duckdb_ctes("v_stations") + "\nSELECT station_id, cast(coalesce(max(CASE WHEN direction IS NULL THEN aadt END), sum(CASE WHEN direction IS NOT NULL THEN aadt END)) AS BIGINT) AS aadt, max(heavy_vehicle_pct) AS hv_pct FROM v_stations GROUP BY station_id, road_name, lon, lat")
def q_station_aadt(spark: SparkSession, d: str) -> DataFrame:
    return nearby.station_aadt(view(spark, d, "v_stations")).select("station_id", "aadt", "hv_pct")


