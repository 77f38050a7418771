"""All scores side by side, pre-computed grids, and answers from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.functions import ladders
from siteline.operators import spatial
from siteline.plans import nearby
from siteline.plans.q_etl import shared_folder, staged
from siteline.plans.q_nearby import worst_contour
from siteline.plans.q_noise import LEVELS_SQL, NOISE_SQL, RADIUS, noise, noise_parts, score_noise
from siteline.plans.q_scores import CONTAMINATION_SQL, INDUSTRY_SQL, WALK_SQL, aircraft_exposure, bushfire, contamination, flood, heat, score_solar, view_score, walk
from siteline.plans.q_scores import _solar_props as solar_props
from siteline.registry import ORACLES, query
from siteline.sources.views import duckdb_ctes, view
from siteline.streaming import serve

DISCLAIMER = "Estimates from open data. Not a professional assessment."
# Regions of pre-computed grids: least and greatest latitude and longitude, and step in degrees.
REGIONS = {"melbourne-inner": (-37.86, -37.76, 144.90, 145.02, 0.002), "melbourne": (-38.05, -37.55, 144.55, 145.45, 0.005), "sydney-inner": (-33.92, -33.82, 151.15, 151.28, 0.002)}


def compose(props: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """(property_id, a column per score): all joined on the property. Each score is written first, in a job of its own: one
    plan of all is more than a driver can hold several hundred times, once for each step."""
    return nearby.beside(nearby.keyed(props).select("property_id"), *(staged(t.select("property_id", F.col("score").alias(name))) for name, t in scores.items()))


SCORES = {"noise": "score_noise", "walkability": "score_walkability", "solar": "score_solar", "flood": "score_flood", "bushfire": "score_bushfire", "heat": "score_heat", "view_quality": "score_view", "contamination": "score_contamination"}
BESIDE_SQL = "".join(f"\nLEFT JOIN ({ORACLES[q]}) {c} ON p.property_id = {c}.property_id" for c, q in SCORES.items())


def _scores(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"noise": noise(spark, d), "walkability": walk(spark, d), "solar": score_solar(solar_props(spark, d)), "flood": flood(spark, d), "bushfire": bushfire(spark, d), "heat": heat(spark, d), "view_quality": view_score(spark, d), "contamination": contamination(spark, d)}


@query("compose_scores", duckdb_ctes("v_properties") + "\nSELECT p.property_id, " + ", ".join(f"{c}.score AS {c}" for c in SCORES) + " FROM v_properties p" + BESIDE_SQL)
def compose_scores(spark: SparkSession, d: str) -> DataFrame:
    """All eight scores of every property side by side."""
    return compose(view(spark, d, "v_properties"), _scores(spark, d))


@query("score_all", duckdb_ctes("v_properties") + "\nSELECT p.property_id, " + ", ".join(f"{c}.score AS {c}" for c in SCORES) + f", '{DISCLAIMER}' AS disclaimer FROM v_properties p" + BESIDE_SQL)
def score_all(spark: SparkSession, d: str) -> DataFrame:
    """All eight scores of every property with the disclaimer."""
    return compose_scores(spark, d).withColumn("disclaimer", F.lit(DISCLAIMER))


def grid_points(spark: SparkSession, lat0: float, lat1: float, lng0: float, lng1: float, step: float) -> DataFrame:
    """(property_id, lat, lng) of a lattice, made where it is used: nothing is built on the driver."""
    rows, cols = int((lat1 - lat0) / step + 1 - 1e-9), int((lng1 - lng0) / step + 1 - 1e-9)
    g = spark.range(rows * cols).select(F.col("id").alias("property_id"), F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"))
    return g.select("property_id", F.bround(lat0 + F.col("r") * step, 6).alias("lat"), F.bround(lng0 + F.col("c") * step, 6).alias("lng"))


GRID_SQL = "v_properties AS (SELECT *, NULL AS roof_area_m2, 'optimal' AS orientation FROM v_lattice)"


def _without_properties(sql: str) -> str:
    """The SQL with the lattice in place of the properties."""
    start = sql.index("v_properties AS MATERIALIZED (")
    end = sql.index("),\n", start) + 3
    return sql[:start] + duckdb_ctes("v_lattice").removeprefix("WITH ") + ",\n" + GRID_SQL + ",\n" + sql[end:]


def grid_noise(spark: SparkSession, d: str, props: DataFrame, radius_m: float = RADIUS, without: Column | None = None) -> DataFrame:
    """Noise scores of a lattice (property_id, lat, lng), such as ``grid_points`` of one of REGIONS; ``without`` tells roads that are
    left out by their road_id."""
    v = lambda n: view(spark, d, n)
    contours = v("v_overlays").where("theme = 'aircraft'")
    hits = spatial.inside(props, contours, "overlay_id", ["layer_name", "layer_no", "severity", "code", "airfield", "defence"])
    roads, counted = v("v_roads"), v("v_aadt")
    if without is not None:
        roads, counted = roads.where(~without), counted.withColumn("road_id", F.col("seg_id")).where(~without).drop("road_id")
    parts = noise_parts(props, counted, v("v_stations"), roads, v("v_rail_shapes"), v("v_rail_frequency"), v("v_buildings"), radius_m)
    out = score_noise(props, parts, aircraft_exposure(props, worst_contour(hits)), v("v_raster"))
    return props.join(out, "property_id").select("property_id", "lat", "lng", "score", F.col("lden_db").alias("estimated_db"), "road_db", "rail_db", "label", "dominant_source")


GRID_OUT = "SELECT n4.property_id, p.lat, p.lng, score, round_even(lden, 1) AS estimated_db, round_even(road_db, 1) AS road_db, round_even(rail_db, 1) AS rail_db FROM n4 JOIN v_properties p ON n4.property_id = p.property_id"


@query("grid_precompute", _without_properties(LEVELS_SQL) + ",\n" + NOISE_SQL + "\n" + GRID_OUT)
def grid_precompute(spark: SparkSession, d: str) -> DataFrame:
    """The lattice of 0.005 degrees over every box that customers occupy."""
    return grid_noise(spark, d, view(spark, d, "v_lattice")).drop("label", "dominant_source")


def write_score_grid(grid: DataFrame, path: str, region: str) -> None:
    """A region's folder of the score grid; a place without score stays, with nulls."""
    grid.withColumn("region", F.lit(region)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(path)


@query("write_score_grid", duckdb_ctes("v_grid") + "\nSELECT 'inner' AS region, count(*) AS n, count(CASE WHEN score < 90 THEN score END) AS scored FROM v_grid")
def q_write_score_grid(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    write_score_grid(view(spark, d, "v_grid").withColumn("score", F.when(F.col("score") < 90, F.col("score"))), path, "inner")
    return spark.read.parquet(path).groupBy("region").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_grid").select(F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng"), "score", "r", "c")


def serve_from_grid(props: DataFrame, grid: DataFrame, computed: DataFrame, max_dist_m: float) -> DataFrame:
    """(property_id, score, cached): the nearest grid point's score, else the computed one."""
    hit = serve.answer(nearby.keyed(props), grid, max_dist_m).select("property_id", "score", F.lit(True).alias("cached"))
    miss = computed.join(hit, "property_id", "left_anti").select("property_id", "score", F.lit(False).alias("cached"))
    return hit.unionByName(miss)


HIT_SQL = "ht AS (SELECT property_id, score FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY dd, r, c) AS rn FROM (SELECT p.property_id, g.score, g.r, g.c, sqrt((g.lat - p.lat) ** 2 + ((g.lng - p.lng) * cos(radians(p.lat))) ** 2) AS dd FROM v_properties p JOIN v_grid g ON abs(g.lat - p.lat) <= 80 / 111320.0::double AND abs(g.lng - p.lng) <= 80 / 111320.0::double * 1.5::double) WHERE dd < 80 / 111320.0::double) WHERE rn = 1)"


@query("serve_from_grid", duckdb_ctes("v_properties", "v_pois", "v_roads", "v_raster", "v_grid") + ",\n" + WALK_SQL + ",\n" + HIT_SQL + "\nSELECT property_id, score, true AS cached FROM ht UNION ALL SELECT property_id, score, false FROM walk WHERE property_id NOT IN (SELECT property_id FROM ht)")
def q_serve_from_grid(spark: SparkSession, d: str) -> DataFrame:
    return serve_from_grid(view(spark, d, "v_properties"), _grid(spark, d), walk(spark, d), 80)


@query("score_stream", duckdb_ctes("v_properties", "v_grid") + ",\n" + HIT_SQL.replace("80 /", "150 /") + "\nSELECT property_id, score FROM ht")
def score_stream(spark: SparkSession, d: str) -> DataFrame:
    """Requests landed as files, answered by a stream that ends with the input."""
    base = shared_folder(spark)
    nearby.keyed(view(spark, d, "v_properties")).repartition(3).write.parquet(f"{base}/requests")
    requests = spark.readStream.schema("property_id long, lat double, lng double").option("maxFilesPerTrigger", 1).parquet(f"{base}/requests")
    grid = _grid(spark, d).persist()
    serve.score_stream(requests, grid, f"{base}/answers", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/answers").select("property_id", "score")


@query("industrial_component", f"SELECT o_orderkey, cast({INDUSTRY_SQL} AS INT) AS industrial FROM (SELECT o_orderkey, o_orderkey % 9 AS n_industrial, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey * 3 % 400 END AS industrial_m FROM orders)")
def industrial_component(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k, ladders.industrial_component(F.when(k % 7 != 0, k * 3 % 400), k % 9).alias("industrial"))


