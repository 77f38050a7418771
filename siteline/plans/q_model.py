"""Features, split, training and evaluation of the noise residual model, and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.functions import acoustics as ac
from siteline.functions import geo, places
from siteline.operators import ranks, spatial
from siteline.plans import boosting, nearby
from siteline.plans.q_etl import shared_folder, staged
from siteline.plans.q_nearby import MDEG, R4, centres_sql, near_pois_sql, near_rail_sql, near_segments_sql, near_stations_sql, state_sql
from siteline.plans.q_noise import CLASS_AADT_SQL, FACADE_SQL, LDEN_SQL, LEVELS_SQL, NOISE_SQL, NOT_MOTOR_SQL, PATHS_SQL, RADIUS, best_terrain_barrier, crtn_sql, facade, facade_sectors, map_sources, noise, parts_of, path_samples, period_sql, rail_kind, score_noise, with_aircraft_level
from siteline.plans.q_scores import aircraft, raster_at, sql_any
from siteline.registry import query
from siteline.sources.views import duckdb_ctes, view

CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service"]
MAJOR = CLASSES[:5]


def _props(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_properties")


# -- feature blocks --------------------------------------------------------------------------------------------------


def building_stats(props: DataFrame, centres: DataFrame) -> DataFrame:
    """Counts and heights of buildings in the window and within 100 m; the upper quartile is interpolated."""
    dist = geo.dist_anisotropic(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng"))
    rows = centres.join(nearby.keyed(props), "property_id").withColumn("inner", dist < 100)
    n, inner = F.count("*"), F.count_if("inner")
    out = rows.groupBy("property_id").agg(n.alias("building_count"), F.avg("h").alias("building_height_mean"), F.max("h").alias("building_height_max"), F.percentile("h", 0.75).alias("building_height_p75"), inner.alias("building_count_100m"), F.coalesce(F.avg(F.when(F.col("inner"), F.col("h"))), F.lit(0.0)).alias("building_height_100m_mean"))
    return out.withColumn("density_ratio", F.col("building_count_100m") / F.greatest("building_count", F.lit(1)))


BUILDING_SQL = centres_sql("fb0", RADIUS) + f""",
fbs AS (SELECT property_id, count(*) AS building_count, avg(h) AS building_height_mean, max(h) AS building_height_max, quantile_cont(h, 0.75) AS building_height_p75, count(*) FILTER (inn) AS building_count_100m, coalesce(avg(h) FILTER (inn), 0.0::double) AS building_height_100m_mean, count(*) FILTER (inn) / count(*) AS density_ratio
 FROM (SELECT b.*, sqrt(((b.clng - p.lng) * {MDEG}) ** 2 + ((b.clat - p.lat) * 111320.0::double) ** 2) < 100 AS inn FROM fb0 b JOIN v_properties p ON b.property_id = p.property_id) GROUP BY 1)"""
BUILDING_COLS = ["building_count", "building_height_mean", "building_height_max", "building_height_p75", "building_count_100m", "building_height_100m_mean", "density_ratio"]


def rounded(cols: list[str]) -> str:
    return ", ".join(f"round_even({c}::double, 4) AS {c}" for c in cols)


def numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select("property_id", *[F.bround(F.col(c).cast("double"), 4).alias(c) for c in cols])


@query("building_stats", duckdb_ctes("v_properties", "v_buildings") + ",\n" + BUILDING_SQL + f"\nSELECT property_id, {rounded(BUILDING_COLS)} FROM fbs")
def q_building_stats(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    return numbers(building_stats(props, nearby.building_centres(props, view(spark, d, "v_buildings"), RADIUS)), BUILDING_COLS)


def road_class_features(roads: DataFrame, radius_m: float) -> DataFrame:
    """Count and nearest distance of motor roads by class (the radius where there is none), and the share with a limit."""
    motor = roads.where(places.is_motor(F.col("class")))
    aggs: list[Column] = [F.count("*").alias("road_count")]
    for c in CLASSES:
        is_c = F.col("class") == c
        aggs += [F.count_if(is_c).alias(f"road_{c}_count"), F.coalesce(F.min(F.when(is_c, F.col("dist_m"))), F.lit(float(radius_m))).alias(f"road_{c}_min_dist")]
    aggs += [(F.count_if(F.coalesce(F.col("speed_kmh") > 0, F.lit(False))) / F.count("*")).alias("roads_with_speed_pct"), F.coalesce(F.min(F.when(F.col("class").isin(MAJOR), F.col("dist_m"))), F.lit(float(radius_m))).alias("nearest_major_dist")]
    return motor.groupBy("property_id").agg(*aggs)


ROAD_COLS = ["road_count", *[f"road_{c}_{s}" for c in CLASSES for s in ("count", "min_dist")], "roads_with_speed_pct", "nearest_major_dist"]
ROAD_SQL = near_segments_sql("fr0", RADIUS, "(SELECT * FROM v_roads WHERE subtype = 'road')", "road_id, class, speed_kmh") + ",\nfrs AS (SELECT property_id, count(*) AS road_count, " + ", ".join(f"count(*) FILTER (class = '{c}') AS road_{c}_count, coalesce(min(dist_m) FILTER (class = '{c}'), {RADIUS}) AS road_{c}_min_dist" for c in CLASSES) + f", count(*) FILTER (speed_kmh > 0) / count(*) AS roads_with_speed_pct, coalesce(min(dist_m) FILTER (class IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary')), {RADIUS}) AS nearest_major_dist FROM fr0 WHERE {NOT_MOTOR_SQL} GROUP BY 1)"


@query("road_class_features", duckdb_ctes("v_properties", "v_roads") + ",\n" + ROAD_SQL + f"\nSELECT property_id, {rounded(ROAD_COLS)} FROM frs")
def q_road_class_features(spark: SparkSession, d: str) -> DataFrame:
    return numbers(road_class_features(nearby.roads(_props(spark, d), view(spark, d, "v_roads"), RADIUS), RADIUS), ROAD_COLS)


def road_levels(roads: DataFrame) -> DataFrame:
    """Map roads as sources with raw levels by class; no band test against measured traffic, as the features have it."""
    return map_sources(roads.where(places.is_motor(F.col("class"))))


def road_energy_features(levels: DataFrame) -> DataFrame:
    """Loudest, mean and summed raw level of road sources, loudest and top-eight sum of screened ones, greatest screening."""
    w = Window.partitionBy("property_id").orderBy(F.desc("level"), "sid")
    rows = levels.withColumn("rn", F.row_number().over(w))
    e = lambda c, ok: F.coalesce(10 * F.log10(F.nullif(F.sum(F.when(ok, F.pow(F.lit(10.0), F.col(c) / 10)).otherwise(0.0)), F.lit(0.0))), F.lit(0.0))
    return rows.groupBy("property_id").agg(F.max("raw").alias("road_db_max"), F.avg("raw").alias("road_db_mean"), e("raw", F.lit(True)).alias("road_db_sum_energy"), F.max("level").alias("road_screened_max"), e("level", (F.col("rn") <= 8) & (F.col("level") > 0)).alias("road_screened_sum"), F.max("screen").alias("max_screening_db"))


ENERGY_COLS = ["road_db_max", "road_db_mean", "road_db_sum_energy", "road_screened_max", "road_screened_sum", "max_screening_db"]


def _screen_sql(src: str, name: str) -> str:
    """CTEs that screen the sources of ``src`` (property_id, sid, raw, dist_m, src_lng, src_lat, factor) by buildings fb0."""
    return f"""{name}b AS (SELECT property_id, sid, dist_m, h, (bx * dx + by_ * dy) / nullif(sqrt(dx * dx + dy * dy), 0) AS along, abs(by_ * dx - bx * dy) / nullif(sqrt(dx * dx + dy * dy), 0) AS off, sqrt(dx * dx + dy * dy) AS size FROM (
  SELECT s.property_id, s.sid, s.dist_m, b.h, (s.lng - src_lng) * k AS dx, (s.lat - src_lat) * 111320.0::double AS dy, (clng - src_lng) * k AS bx, (clat - src_lat) * 111320.0::double AS by_
  FROM (SELECT s.*, p.lat, p.lng, 111320.0::double * cos(radians((s.src_lat + p.lat) / 2)) AS k FROM {src} s JOIN v_properties p ON s.property_id = p.property_id WHERE s.dist_m >= 20) s JOIN fb0 b ON b.property_id = s.property_id)),
{name}z AS (SELECT property_id, sid, zone, max(least(10 * log10(3 + 20 * (2 * det / 0.34::double) ** 2), 20.0::double)) AS loss FROM (SELECT property_id, sid, floor(along / 20) AS zone, sqrt(along ** 2 + (h - 0.5::double) ** 2) + sqrt((dist_m - along) ** 2 + (h - 1.5::double) ** 2) - dist_m AS det FROM {name}b WHERE size >= 1 AND along >= 5 AND along <= dist_m - 5 AND off <= 30) WHERE det > 0 GROUP BY ALL),
{name}s AS (SELECT property_id, sid, least(25.0::double, max(loss) + 0.4::double * (sum(loss) - max(loss))) AS screen FROM {name}z GROUP BY ALL),
{name} AS MATERIALIZED (SELECT s.*, coalesce(x.screen, 0.0::double) AS screen, greatest(s.raw - coalesce(x.screen, 0.0::double) * s.factor, 0.0::double) AS level FROM {src} s LEFT JOIN {name}s x ON s.property_id = x.property_id AND s.sid = x.sid)"""


ROAD_LEVEL_SQL = f"rv0 AS (SELECT * FROM (SELECT property_id, road_id AS sid, {crtn_sql(CLASS_AADT_SQL, 'dist_m')} AS raw, dist_m, near_lng AS src_lng, near_lat AS src_lat, 1.0::double AS factor FROM fr0 WHERE {NOT_MOTOR_SQL}) WHERE raw > 0),\n" + _screen_sql("rv0", "rv")
ENERGY_SQL = "fen AS (SELECT property_id, max(raw) AS road_db_max, avg(raw) AS road_db_mean, 10 * log10(sum(10.0::double ** (raw / 10))) AS road_db_sum_energy, max(level) AS road_screened_max, coalesce(10 * log10(nullif(sum(CASE WHEN rn <= 8 AND level > 0 THEN 10.0::double ** (level / 10) ELSE 0.0::double END), 0)), 0.0::double) AS road_screened_sum, max(screen) AS max_screening_db FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY level DESC, sid) AS rn FROM rv) GROUP BY 1)"
ROAD_BASE_SQL = duckdb_ctes("v_properties", "v_roads", "v_buildings", "v_rail_shapes", "v_rail_frequency", "v_stations", "v_pois") + ",\n" + ROAD_SQL + ",\n" + BUILDING_SQL + ",\n" + ROAD_LEVEL_SQL


def _road_levels(spark: SparkSession, d: str) -> DataFrame:
    from siteline.plans.q_noise import screened

    props = _props(spark, d)
    return screened(road_levels(nearby.roads(props, view(spark, d, "v_roads"), RADIUS)), props, view(spark, d, "v_buildings"), RADIUS)


@query("road_energy_features", ROAD_BASE_SQL + ",\n" + ENERGY_SQL + f"\nSELECT property_id, {rounded(ENERGY_COLS)} FROM fen")
def q_road_energy_features(spark: SparkSession, d: str) -> DataFrame:
    return numbers(road_energy_features(_road_levels(spark, d)), ENERGY_COLS)


def sector_stats(levels: DataFrame, props: DataFrame) -> DataFrame:
    """Greatest, least, range, spread and number of sectors with road energy (raw levels)."""
    rows = levels.join(nearby.keyed(props), "property_id")
    s = geo.sector(geo.bearing(F.col("lat"), F.col("lng"), F.col("src_lat"), F.col("src_lng")))
    by = spatial.worked_out(rows, s=s).groupBy("property_id", "s").agg((10 * F.log10(F.sum(F.pow(F.lit(10.0), F.col("raw") / 10)))).alias("db"))
    on = F.col("db") > 0
    out = by.groupBy("property_id").agg(F.max("db").alias("sector_max_db"), F.min(F.when(on, F.col("db"))).alias("sector_min_db"), F.coalesce(F.stddev_pop(F.when(on, F.col("db"))), F.lit(0.0)).alias("sector_std_db"), F.count_if(on).alias("sectors_active"))
    return out.withColumn("sector_range_db", F.col("sector_max_db") - F.col("sector_min_db"))


SECTOR_COLS = ["sector_max_db", "sector_min_db", "sector_range_db", "sector_std_db", "sectors_active"]
SECTOR_SQL = """fse AS (SELECT property_id, max(db) AS sector_max_db, min(db) FILTER (db > 0) AS sector_min_db, max(db) - min(db) FILTER (db > 0) AS sector_range_db, coalesce(stddev_pop(db) FILTER (db > 0), 0.0::double) AS sector_std_db, count(*) FILTER (db > 0) AS sectors_active FROM (
 SELECT property_id, cast(floor(CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END / (2 * pi() / 8)) % 8 AS INT) AS s, 10 * log10(sum(10.0::double ** (raw / 10))) AS db FROM (SELECT rv.*, atan2((src_lng - p.lng) * cos(radians((p.lat + src_lat) / 2)), src_lat - p.lat) AS t FROM rv JOIN v_properties p ON rv.property_id = p.property_id) GROUP BY 1, 2) GROUP BY 1)"""


@query("sector_stats", ROAD_BASE_SQL + ",\n" + SECTOR_SQL + f"\nSELECT property_id, {rounded(SECTOR_COLS)} FROM fse")
def q_sector_stats(spark: SparkSession, d: str) -> DataFrame:
    return numbers(sector_stats(_road_levels(spark, d), _props(spark, d)), SECTOR_COLS)


def traffic_features(stations: DataFrame, radius_m: float) -> DataFrame:
    return stations.groupBy("property_id").agg(F.count("*").alias("nfdh_count"), F.max("aadt").alias("nfdh_max_aadt"), F.min("dist_m").alias("nfdh_nearest_dist"))


TRAFFIC_COLS = ["nfdh_count", "nfdh_max_aadt", "nfdh_nearest_dist"]
TRAFFIC_SQL = near_stations_sql("fs0", RADIUS) + ",\nfts AS (SELECT property_id, count(*) AS nfdh_count, max(aadt) AS nfdh_max_aadt, min(dist_m) AS nfdh_nearest_dist FROM fs0 GROUP BY 1)"


@query("traffic_features", duckdb_ctes("v_properties", "v_stations") + ",\n" + TRAFFIC_SQL + f"\nSELECT property_id, {rounded(TRAFFIC_COLS)} FROM fts")
def q_traffic_features(spark: SparkSession, d: str) -> DataFrame:
    return numbers(traffic_features(nearby.stations(_props(spark, d), view(spark, d, "v_stations"), RADIUS), RADIUS), TRAFFIC_COLS)


def rail_features(rail: DataFrame, screen: DataFrame, radius_m: float) -> DataFrame:
    """Counts, nearest distances and levels of rail routes; ``screen`` has the screening by (property_id, sid)."""
    train = F.col("route_type") != 0
    raw = ac.rail_level(rail_kind(F.col("route_type"), F.col("peak")), F.col("dist_m"), F.col("peak") * 0.4 + F.col("offpeak") * 0.6)
    s = screen.select("property_id", F.col("sid").alias("shape_id"), "screen")
    rows = rail.withColumn("raw", raw).join(s, ["property_id", "shape_id"], "left").withColumn("scr", F.when(F.col("raw") > 0, F.greatest(F.col("raw") - F.coalesce("screen", F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    near = lambda ok: F.coalesce(F.min(F.when(ok, F.col("dist_m"))), F.lit(float(radius_m)))
    out = rows.groupBy("property_id").agg(F.count("*").alias("rail_route_count"), F.count_if(train).alias("train_count"), F.count_if(~train).alias("tram_count"), near(train).alias("train_min_dist"), near(~train).alias("tram_min_dist"), F.coalesce(F.max(F.when(train, F.col("peak"))), F.lit(0.0)).alias("train_max_peak_svc"), F.max("raw").alias("rail_raw_db_max"), F.max("scr").alias("rail_screened_db_max"))
    return out.withColumn("rail_screening_delta", F.col("rail_raw_db_max") - F.col("rail_screened_db_max"))


RAIL_COLS = ["rail_route_count", "train_count", "tram_count", "train_min_dist", "tram_min_dist", "train_max_peak_svc", "rail_raw_db_max", "rail_screened_db_max", "rail_screening_delta"]


def _rail_sql() -> str:
    from siteline.plans.q_noise import RAIL_TYPE_SQL, rail_sql

    return near_rail_sql("fg0", RADIUS) + f",\nfg1 AS (SELECT property_id, shape_id AS sid, route_type, peak, {rail_sql(RAIL_TYPE_SQL, 'dist_m', '(peak * 0.4::double + offpeak * 0.6::double)')} AS raw, dist_m, near_lng AS src_lng, near_lat AS src_lat, 1.0::double AS factor FROM fg0),\n" + _screen_sql("fg1", "fg2") + f""",
frl AS (SELECT property_id, count(*) AS rail_route_count, count(*) FILTER (route_type <> 0) AS train_count, count(*) FILTER (route_type = 0) AS tram_count, coalesce(min(dist_m) FILTER (route_type <> 0), {RADIUS}) AS train_min_dist, coalesce(min(dist_m) FILTER (route_type = 0), {RADIUS}) AS tram_min_dist, coalesce(max(peak) FILTER (route_type <> 0), 0) AS train_max_peak_svc, max(raw) AS rail_raw_db_max, max(CASE WHEN raw > 0 THEN level ELSE 0.0::double END) AS rail_screened_db_max, max(raw) - max(CASE WHEN raw > 0 THEN level ELSE 0.0::double END) AS rail_screening_delta FROM fg2 GROUP BY 1)"""


RAIL_SQL = _rail_sql()


def _rail_features(spark: SparkSession, d: str) -> DataFrame:
    from siteline.plans.q_noise import barrier_combine, corridor

    props = _props(spark, d)
    rail = nearby.rail(props, view(spark, d, "v_rail_shapes"), view(spark, d, "v_rail_frequency"), RADIUS)
    src = rail.select("property_id", F.lit(3).alias("kind_no"), F.col("shape_id").alias("sid"), "dist_m", F.col("near_lng").alias("src_lng"), F.col("near_lat").alias("src_lat"))
    return rail_features(rail, barrier_combine(corridor(src, props, view(spark, d, "v_buildings"), RADIUS)), RADIUS)


@query("rail_features", ROAD_BASE_SQL + ",\n" + RAIL_SQL + f"\nSELECT property_id, {rounded(RAIL_COLS)} FROM frl")
def q_rail_features(spark: SparkSession, d: str) -> DataFrame:
    return numbers(_rail_features(spark, d), RAIL_COLS)


def poi_features(near: DataFrame, radius_m: float = 500) -> DataFrame:
    noisy = places.is_noisy(F.col("category"))
    return near.groupBy("property_id").agg(F.count_if(noisy).alias("poi_noise_count"), F.coalesce(F.min(F.when(noisy, F.col("dist_m"))), F.lit(float(radius_m))).alias("poi_noise_min_dist"), F.count("*").alias("poi_total_count"))


POI_COLS = ["poi_noise_count", "poi_noise_min_dist", "poi_total_count"]
POI_SQL = near_pois_sql("fp0", 500) + f",\nfpo AS (SELECT property_id, count(*) FILTER ({sql_any('category', places.NOISY)}) AS poi_noise_count, coalesce(min(dist_m) FILTER ({sql_any('category', places.NOISY)}), 500) AS poi_noise_min_dist, count(*) AS poi_total_count FROM fp0 GROUP BY 1)"


@query("poi_features", duckdb_ctes("v_properties", "v_pois") + ",\n" + POI_SQL + f"\nSELECT property_id, {rounded(POI_COLS)} FROM fpo")
def q_poi_features(spark: SparkSession, d: str) -> DataFrame:
    return numbers(poi_features(nearby.places(_props(spark, d), view(spark, d, "v_pois"), 500)), POI_COLS)


def physics_features(levels: DataFrame, rail: DataFrame, sectors: DataFrame, props: DataFrame) -> DataFrame:
    """Simplified physics from road levels and the loudest screened rail: no aircraft, terrain or measured traffic."""
    from siteline.plans.q_noise import adaptive_select

    top = adaptive_select(levels.where("level > 0"), ac.MAX_ROADS).groupBy("property_id").agg((10 * F.log10(F.sum(F.pow(F.lit(10.0), F.col("level") / 10)))).alias("road"))
    rows = nearby.beside(nearby.keyed(props).select("property_id"), top, rail.select("property_id", F.col("rail_screened_db_max").alias("rail")), sectors.select("property_id", "sector_range_db"))
    rows = rows.na.fill(0.0, ["road", "rail", "sector_range_db"])
    rows = spatial.worked_out(rows, **ac.period_levels(F.col("road"), F.col("rail"), F.lit(0.0)))
    rows = spatial.worked_out(rows, l=ac.lden(F.col("leq_day"), F.col("leq_eve"), F.col("leq_night")))
    one = lambda c, n: F.bround(c, 1).alias(n)
    return rows.select("property_id", one("l", "physics_lden"), one("road", "physics_road_db"), one("rail", "physics_rail_db"), one("l", "physics_max_facade"), one(F.greatest(F.col("l") - F.col("sector_range_db"), F.lit(ac.AMBIENT_DB)), "physics_min_facade"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround((75 - F.col("l")) / 35 * 100))).alias("physics_score"))


PHYSICS_COLS = ["physics_lden", "physics_road_db", "physics_rail_db", "physics_max_facade", "physics_min_facade", "physics_score"]
PHYSICS_SQL = f"""fph0 AS (SELECT p.property_id, coalesce(a.road, 0.0::double) AS road, coalesce(frl.rail_screened_db_max, 0.0::double) AS rail, coalesce(fse.sector_range_db, 0.0::double) AS sr FROM v_properties p
 LEFT JOIN (SELECT property_id, 10 * log10(sum(10.0::double ** (level / 10))) AS road FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY level DESC, sid) AS rn, max(level) OVER (PARTITION BY property_id) AS peak FROM rv WHERE level > 0) WHERE level >= peak - 6 AND rn <= 8 GROUP BY 1) a ON p.property_id = a.property_id
 LEFT JOIN frl ON p.property_id = frl.property_id LEFT JOIN fse ON p.property_id = fse.property_id),
fph AS (SELECT property_id, round_even(l, 1) AS physics_lden, round_even(road, 1) AS physics_road_db, round_even(rail, 1) AS physics_rail_db, round_even(l, 1) AS physics_max_facade, round_even(greatest(l - sr, 35.0::double), 1) AS physics_min_facade, greatest(0.0::double, least(100.0::double, round_even((75 - l) / 35 * 100, 0))) AS physics_score FROM (SELECT *, {LDEN_SQL} AS l FROM (SELECT *, {period_sql('road', 'rail', '0.0::double')} FROM fph0)))"""
FEATURES_BASE_SQL = ROAD_BASE_SQL + ",\n" + ",\n".join((ENERGY_SQL, SECTOR_SQL, RAIL_SQL, TRAFFIC_SQL, POI_SQL, PHYSICS_SQL))


def _physics(spark: SparkSession, d: str) -> DataFrame:
    props, levels = _props(spark, d), staged(_road_levels(spark, d))
    return physics_features(levels, _rail_features(spark, d), sector_stats(levels, props), props)


@query("physics_features", FEATURES_BASE_SQL + f"\nSELECT property_id, {rounded(PHYSICS_COLS)} FROM fph")
def q_physics_features(spark: SparkSession, d: str) -> DataFrame:
    return numbers(_physics(spark, d), PHYSICS_COLS)


#: Features of a location in sorted order, with what stands in where a block has nothing.
DEFAULTS = dict.fromkeys([*BUILDING_COLS, *ROAD_COLS, *ENERGY_COLS, *TRAFFIC_COLS, *RAIL_COLS, *POI_COLS, *SECTOR_COLS, *PHYSICS_COLS], 0.0) | {c: float(RADIUS) for c in [*ROAD_COLS, *TRAFFIC_COLS, *RAIL_COLS] if c.endswith("_dist")} | {"poi_noise_min_dist": 500.0}
FEATURES = sorted([*DEFAULTS, "canyon_ratio"])


def noise_features(spark: SparkSession, d: str) -> DataFrame:
    """One row of FEATURES per property: all blocks side by side."""
    props = _props(spark, d)
    centres = nearby.building_centres(props, view(spark, d, "v_buildings"), RADIUS)
    roads = nearby.roads(props, view(spark, d, "v_roads"), RADIUS)
    levels = staged(_road_levels(spark, d))
    rail, sectors = staged(_rail_features(spark, d)), staged(sector_stats(levels, props))
    blocks = [building_stats(props, centres), road_class_features(roads, RADIUS), road_energy_features(levels), traffic_features(nearby.stations(props, view(spark, d, "v_stations"), RADIUS), RADIUS), rail, poi_features(nearby.places(props, view(spark, d, "v_pois"), 500)), sectors, physics_features(levels, rail, sectors, props)]
    out = nearby.beside(nearby.keyed(props).select("property_id"), *blocks)
    out = out.select("property_id", *[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])
    height = F.when(F.col("building_height_100m_mean") > 0, F.col("building_height_100m_mean")).otherwise(F.col("building_height_mean"))
    return out.withColumn("canyon_ratio", height / F.greatest("nearest_major_dist", F.lit(5.0))).select("property_id", *FEATURES)


FEATURE_TABLES = {"fbs": BUILDING_COLS, "frs": ROAD_COLS, "fen": ENERGY_COLS, "fts": TRAFFIC_COLS, "frl": RAIL_COLS, "fpo": POI_COLS, "fse": SECTOR_COLS, "fph": PHYSICS_COLS}
FEATURES_SQL = FEATURES_BASE_SQL + ",\nfx AS (SELECT p.property_id, " + ", ".join(f"coalesce({t}.{c}::double, {DEFAULTS[c]!r}::double) AS {c}" for t, cols in FEATURE_TABLES.items() for c in cols) + " FROM v_properties p " + " ".join(f"LEFT JOIN {t} ON p.property_id = {t}.property_id" for t in FEATURE_TABLES) + "),\nfy AS (SELECT *, CASE WHEN building_height_100m_mean > 0 THEN building_height_100m_mean ELSE building_height_mean END / greatest(nearest_major_dist, 5.0::double) AS canyon_ratio FROM fx)"


@query("noise_features", FEATURES_SQL + f"\nSELECT property_id, {rounded(FEATURES)} FROM fy")
def q_noise_features(spark: SparkSession, d: str) -> DataFrame:
    return numbers(noise_features(spark, d), FEATURES)


# -- split, training, metrics ----------------------------------------------------------------------------------------


def assign_split(points: DataFrame, key: str, folds: int = 5, train_pct: int = 80) -> DataFrame:
    """``points`` with is_train and fold, by integer arithmetic on the key: the same on any partitioning."""
    h = F.pmod(F.col(key) * 48271 + 12345, F.lit(1_000_003))
    return points.withColumn("is_train", F.pmod(h, F.lit(100)) < train_pct).withColumn("fold", F.pmod(F.floor(h / 100), F.lit(folds)).cast("int"))


@query("assign_split", duckdb_ctes("v_measured") + "\nSELECT property_id, ((property_id * 48271 + 12345) % 1000003) % 100 < 80 AS is_train, cast((((property_id * 48271 + 12345) % 1000003) // 100) % 5 AS INT) AS fold FROM v_measured")
def q_assign_split(spark: SparkSession, d: str) -> DataFrame:
    return assign_split(view(spark, d, "v_measured"), "property_id").select("property_id", "is_train", "fold")


def systematic_sample(rows: DataFrame, by: str, level: str, key: str, k: int) -> DataFrame:
    """k rows of each group, evenly along the level: those at places int(i * n / k); groups may be of any size."""
    placed = ranks.ranked(rows, [by], [level, key], shared_folder(rows.sparkSession))
    i = F.ceil(F.col("rank") * k / F.col("n"))
    picked = (F.floor(i * F.col("n") / k) == F.col("rank")) & (i < k)
    return placed.where(picked | (F.col("n") <= k)).drop("rank", "n")


@query("systematic_sample", duckdb_ctes("v_measured") + "\nSELECT city, property_id FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY laeq, property_id) - 1 AS i, count(*) OVER (PARTITION BY city) AS n FROM v_measured) m WHERE n <= 20 OR i IN (SELECT cast(floor(j * m.n / 20) AS BIGINT) FROM range(0, 20) t(j))")
def q_systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return systematic_sample(view(spark, d, "v_measured"), "city", "laeq", "property_id", 20).select("city", "property_id")


def error_metrics(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, bias, MAE, RMSE, shares within 5 and 10 dB and the upper median of column ``err``."""
    e, a = F.col("err"), F.abs("err")
    share = lambda m: F.bround(F.count_if(a <= m) / F.count("*") * 100, 4)
    out = errors.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.bround(F.avg(e), 4).alias("bias"), F.bround(F.avg(a), 4).alias("mae"), F.bround(F.sqrt(F.avg(e * e)), 4).alias("rmse"), share(5).alias("w5"), share(10).alias("w10"))
    return out


METRICS_SQL = "count(*) AS n, round_even(avg(err), 4) AS bias, round_even(avg(abs(err)), 4) AS mae, round_even(sqrt(avg(err * err)), 4) AS rmse, round_even(count(*) FILTER (abs(err) <= 5) / count(*) * 100, 4) AS w5, round_even(count(*) FILTER (abs(err) <= 10) / count(*) * 100, 4) AS w10"


def upper_median(errors: DataFrame, steps: int = 100) -> DataFrame:
    """The middle error, the upper one of two. Errors are counted by steps of 1/``steps`` first, and only those of the
    step that holds the middle are looked at one by one, as counts of equal errors."""
    bins = errors.where("err is not null").withColumn("bin", F.floor(F.col("err") * steps))
    counts = bins.groupBy("bin").agg(F.count("*").alias("c"))  # a few thousand steps of a level's range
    place = counts.withColumn("upto", F.sum("c").over(Window.orderBy("bin"))).withColumn("half", F.floor(F.sum("c").over(Window.partitionBy(F.lit(1))) / 2))
    middle = place.where("upto > half").orderBy("bin").limit(1).select("bin", (F.col("half") - F.col("upto") + F.col("c")).alias("left"))
    inside = bins.join(F.broadcast(middle), "bin").groupBy("err").agg(F.count("*").alias("c"), F.first("left").alias("left"))
    return inside.withColumn("upto", F.sum("c").over(Window.orderBy("err"))).where("upto > left").agg(F.min("err").alias("median_err"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_pred").withColumn("err", F.col("predicted") - F.col("laeq"))


ERR_SQL = duckdb_ctes("v_pred") + ", er AS (SELECT *, predicted - laeq AS err FROM v_pred)"


@query("error_metrics", ERR_SQL + f"\nSELECT *, (SELECT list_sort(list(err))[count(*) // 2 + 1] FROM er) AS median_err FROM (SELECT {METRICS_SQL} FROM er)")
def q_error_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    return error_metrics(e).join(F.broadcast(upper_median(e)))


@query("error_histogram", ERR_SQL + "\nSELECT b, count(*) AS n FROM (SELECT CASE WHEN abs(err) < 3 THEN '0-3' WHEN abs(err) < 5 THEN '3-5' WHEN abs(err) < 8 THEN '5-8' WHEN abs(err) < 10 THEN '8-10' WHEN abs(err) < 15 THEN '10-15' WHEN abs(err) < 99 THEN '15-99' END AS b FROM er) WHERE b IS NOT NULL GROUP BY b")
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    from siteline.functions.ladders import steps

    b = steps(F.abs("err"), [(3, "0-3"), (5, "3-5"), (8, "5-8"), (10, "8-10"), (15, "10-15"), (99, "15-99")], None)
    return _errors(spark, d).select(b.alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("n"))


def city_weighted(errors: DataFrame) -> DataFrame:
    """Metrics by city, and their means weighted by n as the row of city null."""
    by = error_metrics(errors, ["city"])
    n = F.sum("n")
    total = by.agg(n.alias("n"), *[F.bround(F.sum(F.col(c) * F.col("n")) / n, 3).alias(c) for c in ("bias", "mae", "w5")])
    return by.select("city", "n", *[F.bround(c, 3).alias(c) for c in ("bias", "mae", "w5")]).unionByName(total.withColumn("city", F.lit(None).cast("int")))


CITY_SQL = f"cw AS (SELECT city, {METRICS_SQL} FROM er GROUP BY city)\nSELECT city, n, round_even(bias, 3) AS bias, round_even(mae, 3) AS mae, round_even(w5, 3) AS w5 FROM cw UNION ALL SELECT NULL, cast(sum(n) AS BIGINT), round_even(sum(bias * n) / sum(n), 3), round_even(sum(mae * n) / sum(n), 3), round_even(sum(w5 * n) / sum(n), 3) FROM cw"


@query("city_weighted", ERR_SQL + ", " + CITY_SQL)
def q_city_weighted(spark: SparkSession, d: str) -> DataFrame:
    return city_weighted(_errors(spark, d))


def metrics_by_band(errors: DataFrame, least: int = 5) -> DataFrame:
    """Metrics by level band of ten dB from 40 to 80; bands of fewer than ``least`` rows are left out."""
    band = (F.floor(F.col("laeq") / 10) * 10).cast("int")
    return error_metrics(errors.withColumn("band", band).where(F.col("band").between(40, 70)), ["band"]).where(F.col("n") >= least).select("band", "n", "bias", "mae", "w5")


@query("metrics_by_band", ERR_SQL + f"\nSELECT band, n, bias, mae, w5 FROM (SELECT cast(floor(laeq / 10) * 10 AS INT) AS band, {METRICS_SQL} FROM er WHERE laeq >= 40 AND laeq < 80 GROUP BY 1) WHERE n >= 5")
def q_metrics_by_band(spark: SparkSession, d: str) -> DataFrame:
    return metrics_by_band(_errors(spark, d))


def metrics_by_state(errors: DataFrame, least: int = 5) -> DataFrame:
    """Metrics by the state that a row (lat, lng) lies in, null outside all; states of fewer than ``least`` rows are left out."""
    by = error_metrics(errors.withColumn("state", geo.state_of(F.col("lat"), F.col("lng"))), ["state"])
    return by.where(F.col("n") >= least).select("state", "n", "bias", "mae", "w5")


@query("metrics_by_state", duckdb_ctes("v_pred", "v_properties") + f", er AS (SELECT predicted - laeq AS err, {state_sql(geo.STATE_BOXES)} AS state FROM v_pred JOIN v_properties USING (property_id))\nSELECT state, n, bias, mae, w5 FROM (SELECT state, {METRICS_SQL} FROM er GROUP BY state) WHERE n >= 5")
def q_metrics_by_state(spark: SparkSession, d: str) -> DataFrame:
    return metrics_by_state(_errors(spark, d).join(_props(spark, d).select("property_id", "lat", "lng"), "property_id"))


@query("worst_best_n", ERR_SQL + "\nSELECT * FROM (SELECT 'worst' AS side, property_id, err FROM er ORDER BY abs(err) DESC, property_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'best', property_id, err FROM er ORDER BY abs(err), property_id LIMIT 5)")
def worst_best_n(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    pick = lambda side, o: e.orderBy(o, "property_id").limit(5).select(F.lit(side).alias("side"), "property_id", "err")
    return pick("worst", F.desc(F.abs("err"))).unionByName(pick("best", F.abs("err")))


@query("argmax_first", duckdb_ctes("v_measured") + "\nSELECT city, arg_max(property_id % 8, laeq * 1000000 - property_id) AS first_max, arg_min(property_id % 8, laeq * 1000000 + property_id) AS first_min FROM v_measured GROUP BY city")
def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_measured").withColumn("s", F.col("property_id") % 8)
    return m.groupBy("city").agg(F.max_by("s", F.struct("laeq", -F.col("property_id"))).alias("first_max"), F.min_by("s", F.struct("laeq", "property_id")).alias("first_min"))


@query("best_terrain_barrier", PATHS_SQL.replace("range(0, 21)", "range(0, 7)").replace("i / 20.0", "i / 6.0").replace("i = 20", "i = 6") + ",\nlb AS (SELECT property_id, sid, sqrt(((lng - lon) * 111320.0::double * cos(radians(lat))) ** 2 + ((lat - slat) * 111320.0::double) ** 2) AS d, i / 6.0::double AS f, value - (e0 + 0.5::double + i / 6.0::double * (e1 + 1.5::double - e0 - 0.5::double)) AS rise FROM pw WHERE i BETWEEN 1 AND 5 AND value IS NOT NULL)\nSELECT property_id * 1000 + sid AS path_id, round_even(coalesce(max(CASE WHEN rise >= 3 AND d >= 100 AND det > 0 THEN least(10 * log10(3 + 20 * (2 * det / 0.34::double) ** 2), 15.0::double) END), 0.0::double), 3) AS terrain FROM (SELECT *, sqrt((d * f) ** 2 + rise ** 2) + sqrt((d * (1 - f)) ** 2 + rise ** 2) - d AS det FROM lb) GROUP BY 1")
def q_best_terrain_barrier(spark: SparkSession, d: str) -> DataFrame:
    props = _props(spark, d)
    paths = nearby.stations(props, view(spark, d, "v_stations"), 1000).join(nearby.keyed(props), "property_id").select((F.col("property_id") * 1000 + F.col("station_id")).alias("property_id"), "dist_m", F.col("lon").alias("src_lng"), F.col("slat").alias("src_lat"), "lat", "lng")
    return best_terrain_barrier(raster_at(path_samples(paths, 7), view(spark, d, "v_raster"))).select(F.col("property_id").alias("path_id"), R4("terrain"))


def training_table(features: DataFrame, measured: DataFrame) -> DataFrame:
    """Features with target (level less physics), weight, split and place; points of poor quality are left out."""
    good = measured.where((F.col("measure_count") >= 5) & F.col("la50").between(40, 80)).select("property_id", "la50", "city", F.least(F.col("measure_count") / F.lit(10.0), F.lit(5.0)).alias("weight"))
    rows = features.join(good, "property_id")
    return assign_split(rows.withColumn("target", F.col("la50") - F.col("physics_lden")), "property_id")


def fit_residual(rows: DataFrame, models: dict[str, Column], settings: boosting.Settings | None = None) -> boosting.Forest:
    """Gradient-boosted models of the residual, weighted, on the sorted features: one for each set of rows."""
    return boosting.fit(rows, "property_id", FEATURES, "target", "weight", models, shared_folder(rows.sparkSession), settings)


def predicted_errors(forest: boosting.Forest, rows: DataFrame, model: Column) -> DataFrame:
    """Rows with err of the model that ``model`` names for each, and phys_err of physics alone."""
    out = forest.predict(rows).withColumn("prediction", F.element_at("predicted", model)).drop("predicted")
    return out.withColumn("err", F.col("physics_lden") + F.col("prediction") - F.col("la50")).withColumn("phys_err", F.col("physics_lden") - F.col("la50"))


def _table(spark: SparkSession, d: str) -> DataFrame:
    """The training table, written once: features are dear and training reads them several times."""
    path = f"{shared_folder(spark)}/training"
    training_table(noise_features(spark, d), view(spark, d, "v_measured")).write.parquet(path)
    return spark.read.parquet(path)


def both_metrics(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of model and physics, told apart by ``which``."""
    m = error_metrics(errors, by).withColumn("which", F.lit("model"))
    return m.unionByName(error_metrics(errors.withColumn("err", F.col("phys_err")), by).withColumn("which", F.lit("physics")))


@query("train_residual")
def train_residual(spark: SparkSession, d: str) -> DataFrame:
    """Held-out metrics of model and physics; the model of all rows, fitted beside it, is for use (``refit``)."""
    rows = _table(spark, d)
    forest = fit_residual(rows, {"train": F.col("is_train")})
    return both_metrics(predicted_errors(forest, rows.where("not is_train"), F.lit("train")))


@query("refit_all")
def refit_all(spark: SparkSession, d: str) -> DataFrame:
    """Predictions for all training rows by the model fitted on all, saved and loaded again."""
    rows, path = _table(spark, d), f"{shared_folder(spark)}/model"
    fit_residual(rows, {"all": F.lit(True)}).save(spark, path)
    return boosting.Forest.load(spark, path).predict(rows).select("property_id", F.bround(F.col("physics_lden") + F.element_at("predicted", F.lit("all")), 4).alias("level_db"))


@query("top_features")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    """The ten features of most importance, as shares of the gain of all splits."""
    forest = fit_residual(_table(spark, d), {"train": F.col("is_train")})
    return spark.createDataFrame(forest.importance("train"), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(10)


@query("cross_validate")
def cross_validate(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by fold of five-fold validation, each fold by a model of the others; all models share their jobs."""
    rows = _table(spark, d)
    forest = fit_residual(rows, {f"fold {k}": F.col("fold") != k for k in range(5)})
    return error_metrics(predicted_errors(forest, rows, F.concat(F.lit("fold "), F.col("fold").cast("string"))), ["fold"])


@query("leave_city_out")
def leave_city_out(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of model and physics by city, each city by a model of the others (200 trees of depth 4), and of all as city
    null."""
    rows = _table(spark, d)
    cities = [r.city for r in rows.select("city").distinct().where("city is not null").orderBy("city").limit(boosting.MOST_MODELS + 1).collect()]
    forest = fit_residual(rows, {f"city {c}": F.col("city") != c for c in cities}, boosting.Settings(trees=200, depth=4, rate=0.05, alpha=1.0, least_weight=1.0))
    errors = predicted_errors(forest, rows.where("city is not null"), F.concat(F.lit("city "), F.col("city").cast("string")))
    columns = ["city", "which", "n", "bias", "mae", "w5"]
    return both_metrics(errors, ["city"]).select(columns).unionByName(both_metrics(errors).withColumn("city", F.lit(None).cast("int")).select(columns))


@query("evaluate_model", FEATURES_SQL + """, ms AS (SELECT c_custkey AS property_id, (38 + (c_custkey * 17) % 45)::double AS la50, c_custkey % 12 AS mc FROM customer),
er AS (SELECT fy.physics_lden - ms.la50 AS err, ms.la50 FROM fy JOIN ms ON fy.property_id = ms.property_id WHERE mc >= 5 AND la50 BETWEEN 40 AND 80 AND ((fy.property_id * 48271 + 12345) % 1000003) % 100 >= 80)
SELECT """ + METRICS_SQL + " FROM er")
def evaluate_model(spark: SparkSession, d: str) -> DataFrame:
    """Held-out metrics of the physics baseline."""
    rows = _table(spark, d).where("not is_train").withColumn("err", F.col("physics_lden") - F.col("la50"))
    return error_metrics(rows)


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_measured").where("measure_count >= 3 and laeq >= 50").select("property_id", "laeq", "city")


def _noise_errors(spark: SparkSession, d: str) -> DataFrame:
    return noise(spark, d).select("property_id", "leq_db", "lden_db").join(_measured(spark, d), "property_id")


MEASURED_SQL = ", ms AS (SELECT c_custkey AS property_id, (40 + (c_custkey * 13) % 35)::double AS laeq, cast(c_custkey % 7 AS INT) AS city FROM customer WHERE c_custkey % 12 >= 3 AND 40 + (c_custkey * 13) % 35 >= 50)"


@query("validate_measured", LEVELS_SQL + ",\n" + NOISE_SQL + MEASURED_SQL + f", er AS (SELECT round_even(leq_24h, 1) - laeq AS err FROM n4 JOIN ms ON n4.property_id = ms.property_id)\nSELECT {METRICS_SQL} FROM er")
def validate_measured(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the score's Leq against measured hexagons."""
    return error_metrics(_noise_errors(spark, d).withColumn("err", F.col("leq_db") - F.col("laeq")))


def both_forms(errors: DataFrame) -> DataFrame:
    """``city_weighted`` of the level all around (column ``omni``) and, as facade_bias, facade_mae and facade_w5, of that at the loudest
    facade (column ``facade``)."""
    forms = [city_weighted(errors.withColumn("err", F.col(c))) for c in ("omni", "facade")]
    facade = forms[1].select(F.col("city").alias("f_city"), *(F.col(c).alias(f"facade_{c}") for c in ("bias", "mae", "w5")))
    return forms[0].join(facade, F.col("city").eqNullSafe(F.col("f_city"))).drop("f_city")


def _city_sql(err: str, name: str) -> str:
    """CTE of city_weighted for the errors in a column of er."""
    return f"{name}0 AS (SELECT city, {METRICS_SQL.replace('err', err)} FROM er GROUP BY city), {name} AS ({CITY_SQL.split(chr(10), 1)[1].replace('FROM cw', f'FROM {name}0')})"


FACADES_AFTER_NOISE_SQL = FACADE_SQL[FACADE_SQL.index("fa AS ("):]


@query("benchmark_cities", LEVELS_SQL + ",\n" + NOISE_SQL + ",\n" + FACADES_AFTER_NOISE_SQL + MEASURED_SQL + ", er AS (SELECT round_even(n4.lden, 1) - laeq AS omni, ff.hi - laeq AS facade, city FROM n4 JOIN ff ON n4.property_id = ff.property_id JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY laeq, property_id) - 1 AS i, count(*) OVER (PARTITION BY city) AS n FROM ms) m WHERE n <= 50 OR i IN (SELECT cast(floor(j * m.n / 50) AS BIGINT) FROM range(0, 50) t(j))) s ON n4.property_id = s.property_id), " + _city_sql("omni", "co") + ", " + _city_sql("facade", "cf") + "\nSELECT co.*, cf.bias AS facade_bias, cf.mae AS facade_mae, cf.w5 AS facade_w5 FROM co JOIN cf ON co.city IS NOT DISTINCT FROM cf.city")
def benchmark_cities(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by city on an even sample along the published levels, and their weighted means, for the level all around and at the
    loudest facade; both come from one set of sources."""
    props, parts, air = _props(spark, d), parts_of(spark, d), staged(aircraft(spark, d))
    omni = score_noise(props, parts, air, view(spark, d, "v_raster")).select("property_id", "lden_db")
    loudest = facade(parts["levels"], props, with_aircraft_level(air)).select("property_id", "lden_max_facade")
    rows = omni.join(loudest, "property_id").join(_measured(spark, d), "property_id")
    errors = systematic_sample(rows, "city", "laeq", "property_id", 50)
    return both_forms(staged(errors.select("city", (F.col("lden_db") - F.col("laeq")).alias("omni"), (F.col("lden_max_facade") - F.col("laeq")).alias("facade"))))


@query("benchmark_facades", LEVELS_SQL + ",\n" + FACADE_SQL + MEASURED_SQL + ", er AS (SELECT ff.hi - laeq AS err, city FROM ff JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY laeq, property_id) - 1 AS i, count(*) OVER (PARTITION BY city) AS n FROM ms) m WHERE n <= 50 OR i IN (SELECT cast(floor(j * m.n / 50) AS BIGINT) FROM range(0, 50) t(j))) s ON ff.property_id = s.property_id), " + CITY_SQL)
def benchmark_facades(spark: SparkSession, d: str) -> DataFrame:
    """As ``benchmark_cities``, for the level at the loudest facade."""
    loudest = facade_sectors(spark, d).select("property_id", "lden_max_facade").join(_measured(spark, d), "property_id")
    return city_weighted(systematic_sample(loudest, "city", "laeq", "property_id", 50).withColumn("err", F.col("lden_max_facade") - F.col("laeq")))
