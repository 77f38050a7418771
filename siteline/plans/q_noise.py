"""Noise: levels of all sources around a property, screened by buildings and terrain, to a day-evening-night level and a score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.functions import acoustics as ac
from siteline.functions import geo, ladders, places
from siteline.operators import spatial
from siteline.plans import nearby
from siteline.plans.q_etl import drop_folder, shared_folder, staged
from siteline.plans.q_nearby import R4, centres_sql, near_rail_sql, near_segments_sql, near_stations_sql
from siteline.plans.q_scores import CONTOUR_SQL, PENALTY_SQL, aircraft, inside_sql, label_sql, ladder_sql, raster_at
from siteline.registry import query
from siteline.sources.views import duckdb_ctes, view

MAJOR = ["motorway", "trunk", "primary", "secondary"]
TERRAIN_SAMPLES, TERRAIN_RISE_M, SOURCE_M, EAR_M = 7, 3.0, 0.5, 1.5
SECTORS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
SOURCE = ["property_id", "kind", "kind_no", "sid", "name", "raw", "dist_m", "src_lng", "src_lat", "factor"]


def dedup_directional(counted: DataFrame) -> DataFrame:
    """Of measured lines of one road at one distance (to 10 m), the one with the most vehicles."""
    w = Window.partitionBy("property_id", "road_name", F.bround("dist_m", -1)).orderBy(F.desc("aadt"), "dist_m", "seg_id")
    return counted.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def without_band(rows: DataFrame, measured: DataFrame, band_m: float = 80) -> DataFrame:
    """``rows`` whose distance is at least ``band_m`` from that of every measured row (property_id, m_dist)."""
    m = measured.select(F.col("property_id").alias("m_id"), "m_dist")
    return rows.join(m, (F.col("property_id") == F.col("m_id")) & (F.abs(F.col("dist_m") - F.col("m_dist")) < band_m), "left_anti")


def adaptive_select(levels: DataFrame, most: int) -> DataFrame:
    """Per property the levels within 6 dB of the loudest, ``most`` of them at most."""
    w = Window.partitionBy("property_id")
    loud = levels.withColumn("_peak", F.max("level").over(w)).where(F.col("level") >= F.col("_peak") - ac.WINDOW_DB)
    return loud.withColumn("rank", F.row_number().over(w.orderBy(F.desc("level"), "kind_no", "sid"))).where(F.col("rank") <= most).drop("_peak")


def road_sources(counted: DataFrame, stations: DataFrame, roads: DataFrame) -> DataFrame:
    """Road sources with raw levels: measured lines, stations away from them, and other roads, the major ones only away
    from anything measured."""
    lit = F.lit
    a = counted.select("property_id", lit("aadt").alias("kind"), lit(0).alias("kind_no"), F.col("seg_id").alias("sid"), F.col("road_name").alias("name"), ac.crtn_level(F.col("aadt"), F.col("dist_m"), F.coalesce("hv", lit(0.0)) * 100, float(ac.DEFAULT_SPEED)).alias("raw"), "dist_m", F.col("near_lng").alias("src_lng"), F.col("near_lat").alias("src_lat"), lit(1.0).alias("factor"))
    m1 = counted.select("property_id", F.col("dist_m").alias("m_dist"))
    s = without_band(stations, m1).select("property_id", lit("station").alias("kind"), lit(1).alias("kind_no"), F.col("station_id").alias("sid"), F.col("road_name").alias("name"), ac.crtn_level(F.col("aadt"), F.col("dist_m"), F.greatest(F.coalesce("hv_pct", lit(0.0)), lit(0.0)), float(ac.DEFAULT_SPEED)).alias("raw"), "dist_m", F.col("lon").alias("src_lng"), F.col("slat").alias("src_lat"), lit(1.0).alias("factor"))
    measured = m1.unionByName(stations.select("property_id", F.col("dist_m").alias("m_dist")))
    motor = roads.where(places.is_motor(F.col("class")))
    major = F.coalesce(F.col("class").isin(MAJOR), lit(False))
    kept = motor.where(~major).unionByName(without_band(motor.where(major), measured))
    return a.unionByName(s).where("raw > 0").unionByName(map_sources(kept))


def map_sources(motor: DataFrame) -> DataFrame:
    """Roads of the map near properties as sources with raw levels by class."""
    lit = F.lit
    rows = spatial.worked_out(motor, aadt=ac.aadt_of_class(F.col("class")))
    rows = spatial.worked_out(rows, raw=ac.crtn_level(F.col("aadt"), F.col("dist_m"))).where("raw > 0")
    return rows.select("property_id", lit("road").alias("kind"), lit(2).alias("kind_no"), F.col("road_id").alias("sid"), F.col("class").alias("name"), "raw", "dist_m", F.col("near_lng").alias("src_lng"), F.col("near_lat").alias("src_lat"), lit(1.0).alias("factor"))


def rail_kind(route_type: F.Column, peak: F.Column) -> F.Column:
    return F.when(route_type == 0, "tram").when(peak < 4, "vline").otherwise("train")


def rail_sources(rail: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rail sources with raw levels: routes by timetable, and for properties without one, rails by class."""
    lit = F.lit
    level = ac.rail_level(rail_kind(F.col("route_type"), F.col("peak")), F.col("dist_m"), F.col("peak") * 0.4 + F.col("offpeak") * 0.6)
    g = rail.select("property_id", lit("rail").alias("kind"), lit(3).alias("kind_no"), F.col("shape_id").alias("sid"), F.col("route_name").alias("name"), level.alias("raw"), "dist_m", F.col("near_lng").alias("src_lng"), F.col("near_lat").alias("src_lat"), F.least(F.col("dist_m") / 500, lit(0.6)).alias("factor"))
    none = fallback.join(rail.select("property_id").distinct(), "property_id", "left_anti")
    f = none.select("property_id", lit("track").alias("kind"), lit(4).alias("kind_no"), F.col("road_id").alias("sid"), F.col("class").alias("name"), ac.rail_level_fallback(F.col("class"), F.col("dist_m")).alias("raw"), "dist_m", lit(None).cast("double").alias("src_lng"), lit(None).cast("double").alias("src_lat"), lit(0.0).alias("factor"))
    return g.unionByName(f).where("raw > 0")


def corridor(sources: DataFrame, props: DataFrame, buildings: DataFrame, radius_m: float) -> DataFrame:
    """(property_id, kind_no, sid, zone, loss): buildings that stand between a source and its property, by 20 m zone.

    Each line of sight walks over cells of a grid and meets the buildings whose centre lies in its corridor, 30 m to either
    side; they must also be in the property's window of the radius. Lines are dealt out by their ends and k alone: they are
    the most rows of a noise score, and what follows from the ends is worked out at the pair.
    """
    delta = geo.window_deg(radius_m)
    dx, dy = (F.col("x2") - F.col("x1")) * F.col("k"), (F.col("y2") - F.col("y1")) * geo.M_PER_DEG
    at = sources.where("src_lng is not null and dist_m >= 20").select("property_id", "kind_no", "sid", "dist_m", F.col("src_lng").alias("x1"), F.col("src_lat").alias("y1"))
    at = at.join(nearby.keyed(props).select("property_id", F.col("lng").alias("x2"), F.col("lat").alias("y2")), "property_id")
    at = at.withColumn("k", geo.M_PER_DEG * F.cos(F.radians((F.col("y1") + F.col("y2")) / 2)))
    size = F.sqrt(dx * dx + dy * dy)
    at = at.where(size >= 1)
    # only a ray of a length near the radius or more can leave the window
    leaves = (F.abs("_dx") + 35 > delta * F.col("k") * 0.99) | (F.abs("_dy") + 35 > delta * geo.M_PER_DEG)
    b = buildings.select(F.coalesce("height", F.lit(6.0)).alias("h"), "clng", "clat", "xmin", "xmax", "ymin", "ymax")
    window = ~leaves | (F.col("xmin") < F.col("x2") + delta) & (F.col("xmax") > F.col("x2") - delta) & (F.col("ymin") < F.col("y2") + delta) & (F.col("ymax") > F.col("y2") - delta)
    dx, dy, bx, by = map(F.col, ("_dx", "_dy", "_bx", "_by"))
    size = F.sqrt(dx * dx + dy * dy)
    along, off = bx * (dx / size) + by * (dy / size), F.abs(by * (dx / size) - bx * (dy / size))
    between = (off <= 30) & (along >= 5) & (along <= F.col("dist_m") - 5) & window
    out = spatial.near_rays(at, b, "clng", "clat", 30.0, between)
    out = spatial.worked_out(out, along=along, off=off, size=size)
    out = spatial.worked_out(out, loss=ac.barrier_loss(F.col("along"), F.col("off"), F.col("size"), F.col("dist_m"), F.col("h")))
    return out.where("loss is not null").select("property_id", "kind_no", "sid", F.floor(F.col("along") / 20).cast("int").alias("zone"), "loss")


def barrier_combine(losses: DataFrame) -> DataFrame:
    """(property_id, kind_no, sid, screen): the best loss of each zone; the best zone in full, others at 0.4, 25 at most."""
    zones = losses.groupBy("property_id", "kind_no", "sid", "zone").agg(F.max("loss").alias("loss"))
    m = F.max("loss")
    return zones.groupBy("property_id", "kind_no", "sid").agg(F.least(F.lit(ac.BARRIERS_CAP), m + 0.4 * (F.sum("loss") - m)).alias("screen"))


def screened(sources: DataFrame, props: DataFrame, buildings: DataFrame, radius_m: float) -> DataFrame:
    """``sources`` with ``screen`` (raw screening) and ``level``; roads and rails that end at 0 are left out."""
    s = barrier_combine(corridor(sources, props, buildings, radius_m))
    out = sources.join(s, ["property_id", "kind_no", "sid"], "left").withColumn("screen", F.coalesce("screen", F.lit(0.0)))
    return out.withColumn("level", F.greatest(F.col("raw") - F.col("screen") * F.col("factor"), F.lit(0.0)))


def best_terrain_barrier(samples: DataFrame) -> DataFrame:
    """(property_id, terrain): the greatest loss over the inner samples of a path (property_id, i, n, value, dist_m);
    ground must rise 3 m above the line of sight."""
    ends = samples.groupBy("property_id").agg(F.max(F.when(F.col("i") == 0, F.col("value"))).alias("e0"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("value"))).alias("e1"), F.first("dist_m").alias("d"))
    rows = samples.where("i > 0 and i < n - 1 and value is not null").select("property_id", "i", "n", "value").join(ends, "property_id")
    frac = F.col("i") / (F.col("n") - 1)
    rise = F.col("value") - (F.col("e0") + SOURCE_M + frac * (F.col("e1") + EAR_M - F.col("e0") - SOURCE_M))
    over = lambda x: F.sqrt(x * x + rise * rise)
    detour = over(F.col("d") * frac) + over(F.col("d") * (1 - frac)) - F.col("d")
    loss = F.when((rise >= TERRAIN_RISE_M) & (F.col("d") >= 100), ac.maekawa(detour, ac.TERRAIN_CAP))
    return rows.groupBy("property_id").agg(F.coalesce(F.max(loss), F.lit(0.0)).alias("terrain"))


def path_samples(paths: DataFrame, n: int) -> DataFrame:
    """``paths`` (lat, lng, src_lat, src_lng) with n points from the source to the property: i, n, s_lat, s_lng."""
    t = F.col("i") / F.lit(float(n - 1))
    out = paths.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("n", F.lit(n))
    return out.withColumn("s_lat", F.col("src_lat") + t * (F.col("lat") - F.col("src_lat"))).withColumn("s_lng", F.col("src_lng") + t * (F.col("lng") - F.col("src_lng")))


def with_aircraft_level(air: DataFrame) -> DataFrame:
    """Aircraft exposure with ``aircraft_db``, the level that its penalty stands for."""
    return air.withColumn("aircraft_db", F.when(F.col("penalty_db") > 0, ac.AMBIENT_DB + F.col("penalty_db")).otherwise(0.0))


def facade(levels: DataFrame, props: DataFrame, air: DataFrame) -> DataFrame:
    """(property_id, lden_max_facade, lden_min_facade, max_facade_dir, min_facade_dir, facade_range_db).

    Energy by the sector a source lies in, 10 % of it to either neighbour; tracks without position don't count.
    """
    rows = levels.where("src_lng is not null and level > 0").join(nearby.keyed(props), "property_id")
    sec = geo.sector(geo.bearing(F.col("lat"), F.col("lng"), F.col("src_lat"), F.col("src_lng")))
    e = F.pow(F.lit(10.0), F.col("level") / 10)
    rail = F.col("kind") == "rail"
    rows = rows.select("property_id", sec.alias("s"), F.when(~rail, e).otherwise(0.0).alias("road"), F.when(rail, e).otherwise(0.0).alias("rail"))
    by = rows.groupBy("property_id", "s").agg(F.sum("road").alias("road"), F.sum("rail").alias("rail"))
    part = F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(0.8).alias("k")), F.struct(F.pmod(F.col("s") + 1, F.lit(8)).alias("t"), F.lit(0.1).alias("k")), F.struct(F.pmod(F.col("s") - 1, F.lit(8)).alias("t"), F.lit(0.1).alias("k"))))
    smooth = by.select("property_id", "road", "rail", part.alias("p")).groupBy("property_id", F.col("p.t").alias("t")).agg(F.sum(F.col("road") * F.col("p.k")).alias("road"), F.sum(F.col("rail") * F.col("p.k")).alias("rail"))
    grid = nearby.keyed(props).select("property_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    full = grid.join(smooth, ["property_id", "t"], "left").join(air.select("property_id", "aircraft_db"), "property_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    full = spatial.worked_out(full, road_db=ac.level_of(zero("road")), rail_db=ac.level_of(zero("rail")), air_db=zero("aircraft_db"))
    full = spatial.worked_out(full, **ac.period_levels(F.col("road_db"), F.col("rail_db"), F.col("air_db")))
    full = spatial.worked_out(full, l=F.bround(ac.lden(F.col("leq_day"), F.col("leq_eve"), F.col("leq_night")), 1))
    names = F.array(*map(F.lit, SECTORS))
    out = full.groupBy("property_id").agg(F.max(F.struct("l", -F.col("t"))).alias("hi"), F.min(F.struct("l", "t")).alias("lo"))
    return out.select("property_id", F.col("hi.l").alias("lden_max_facade"), F.col("lo.l").alias("lden_min_facade"), F.get(names, -F.col("hi.col2")).alias("max_facade_dir"), F.get(names, F.col("lo.t")).alias("min_facade_dir"), F.bround(F.col("hi.l") - F.col("lo.l"), 1).alias("facade_range_db"))


class NoiseParts(dict):
    """Tables of a noise score by name. Each is written when it is first asked for and read from there afterwards, since
    several steps go on from it; ``release`` gives them up."""

    def __init__(self, spark: SparkSession, make: dict[str, Callable[[NoiseParts], DataFrame]]):
        super().__init__()
        self.spark, self.make, self.folder = spark, make, shared_folder(spark)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = staged(self.make[name](self), f"{self.folder}/{name}")
        if name == "levels":  # they have the sources' columns
            drop_folder(self.spark, f"{self.folder}/sources")
            del self["sources"]
        return self[name]


def all_sources(near: dict[str, DataFrame]) -> DataFrame:
    return road_sources(near["aadt"], near["stations"], near["roads"]).unionByName(rail_sources(near["rail"], near["tracks"]))


def noise_parts(props: DataFrame, aadt: DataFrame, stations: DataFrame, roads: DataFrame, shapes: DataFrame, frequency: DataFrame, buildings: DataFrame, radius_m: float) -> NoiseParts:
    """What is near, and all sources with their levels."""
    return NoiseParts(props.sparkSession, {
        "aadt": lambda p: dedup_directional(nearby.counted(props, aadt, radius_m)),
        "stations": lambda p: nearby.stations(props, stations, radius_m),
        "roads": lambda p: nearby.roads(props, roads, radius_m),
        "rail": lambda p: nearby.rail(props, shapes, frequency, radius_m),
        "tracks": lambda p: nearby.roads(props, roads, radius_m, "rail"),
        "sources": all_sources,
        "levels": lambda p: screened(p["sources"], props, buildings, radius_m),
    })


def release(parts: NoiseParts) -> None:
    """Give up what ``noise_parts`` keeps, once the results are written."""
    parts.clear()
    drop_folder(parts.spark, parts.folder)


def counts_of(parts: dict[str, DataFrame]) -> DataFrame:
    """(property_id, n_aadt, n_stations, road_count, with_speed, tram1, train1, tram2, train2): how much of each kind is near,
    and the nearest tram and train by timetable (1) and by track (2); one aggregate over all kinds."""
    tram = lambda test: (F.when(test, F.col("dist_m")), F.when(~test, F.col("dist_m")))
    values = {
        "aadt": {"n_aadt": F.lit(1)},
        "stations": {"n_stations": F.lit(1)},
        "roads": {"road_count": F.lit(1), "with_speed": F.coalesce(F.col("speed_kmh") > 0, F.lit(False)).cast("int")},
        "rail": dict(zip(("tram1", "train1"), tram(F.col("route_type") == 0), strict=True)),
        "tracks": dict(zip(("tram2", "train2"), tram(F.col("class") == "tram"), strict=True)),
    }
    kinds = {c: "double" if c.startswith("tra") else "int" for v in values.values() for c in v}
    rows = []
    for kind, own in values.items():
        t = parts[kind].where(places.is_motor(F.col("class"))) if kind == "roads" else parts[kind]
        rows.append(t.select("property_id", *(own.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items())))
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy("property_id").agg(*(F.min(c).alias(c) if k == "double" else F.sum(c).alias(c) for c, k in kinds.items()))


def score_noise(props: DataFrame, parts: dict[str, DataFrame], air: DataFrame, raster: DataFrame) -> DataFrame:
    """The noise score of every property, from ``noise_parts``, aircraft exposure and an elevation raster."""
    levels = parts["levels"].where("level > 0 or kind_no < 2")
    road = adaptive_select(levels.where("kind_no < 3"), ac.MAX_ROADS)
    rail = adaptive_select(levels.where("kind_no >= 3"), ac.MAX_RAILS)
    total = lambda c: (10 * F.log10(F.sum(F.pow(F.lit(10.0), F.col("level") / 10)))).alias(c)
    roads = road.groupBy("property_id").agg(total("road_db"), F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("dominant_source"))
    rails = rail.groupBy("property_id").agg(total("rail_db"))
    top = levels.groupBy("property_id").agg(F.max_by(F.struct("kind_no", "dist_m", "src_lng", "src_lat"), F.struct("level", -F.col("kind_no"), -F.col("sid"))).alias("t"), F.max("screen").alias("max_screening"))
    far = top.where("t.kind_no < 3 and bround(t.dist_m) > 200").select("property_id", F.bround("t.dist_m").alias("dist_m"), "t.src_lng", "t.src_lat").join(nearby.keyed(props), "property_id")
    terrain = best_terrain_barrier(raster_at(path_samples(far, TERRAIN_SAMPLES), raster))
    rows = nearby.beside(nearby.keyed(props).select("property_id"), roads, rails, top.select("property_id", "max_screening"), terrain, air.select("property_id", "penalty_db"), counts_of(parts))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.withColumn("terrain", zero("terrain")).withColumn("aircraft_db", F.when(F.col("penalty_db") > 0, ac.AMBIENT_DB + F.col("penalty_db")).otherwise(0.0))
    less = lambda c, k: F.when(F.col("terrain") > 0, F.greatest(F.lit(0.0), zero(c) - F.col("terrain") * k)).otherwise(zero(c))
    rows = spatial.worked_out(rows.withColumnsRenamed({"road_db": "road_0", "rail_db": "rail_0"}), road_db=less("road_0", 0.7), rail_db=less("rail_0", 1.0))
    rows = spatial.worked_out(rows, **ac.period_levels(F.col("road_db"), F.col("rail_db"), F.col("aircraft_db")))
    rows = spatial.worked_out(rows, lden=ac.lden(F.col("leq_day"), F.col("leq_eve"), F.col("leq_night")))
    rows = rows.withColumn("score", ladders.clamp((75 - F.col("lden")) / 35 * 100))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ci, low, high = ladders.confidence(F.col("lden"), n("n_aadt") + n("n_stations"))
    one = lambda c, name: F.bround(c, 1).alias(name)
    timetable = F.col("tram1").isNotNull() | F.col("train1").isNotNull()
    return rows.select(
        "property_id", "score", ladders.label("noise", F.col("score")).alias("label"), one("lden", "lden_db"), one("leq_24h", "leq_db"), one("leq_day", "leq_day_db"), one("leq_night", "leq_night_db"),
        one(ci, "ci_db"), one(low, "db_low"), one(high, "db_high"), one("road_db", "road_db"), one("rail_db", "rail_db"), "aircraft_db", one("terrain", "terrain_db"), one(zero("max_screening"), "max_screening_db"),
        n("n_aadt").alias("n_aadt"), n("n_stations").alias("n_stations"), n("road_count").alias("road_count"), n("with_speed").alias("roads_with_speed"), "dominant_source",
        F.bround(F.when(timetable, F.col("tram1")).otherwise(F.col("tram2"))).alias("nearest_tram_m"), F.bround(F.when(timetable, F.col("train1")).otherwise(F.col("train2"))).alias("nearest_train_m"),
    )


# -- SQL ------------------------------------------------------------------------------------------------------------

lg = lambda x: f"(10 * log10({x}))"
CLASS_AADT_SQL = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ac.CLASS_TO_AADT.items()) + " ELSE 400 END"


def crtn_sql(aadt: str, dist: str, hv: str = "0.0::double", speed: str = "0.0::double") -> str:
    d = f"greatest({dist}, 10.0::double)"
    return f"CASE WHEN {aadt} > 0 THEN greatest(42.2::double + {lg(aadt)} + CASE WHEN {hv} > 0 AND {speed} > 0 THEN 10 * log10(1 + 5 * {hv} / {speed}) ELSE 0.0::double END - {lg(f'{d} / 13.5::double')} - 3.0::double - greatest({d} - 50, 0.0::double) * 0.06::double + {lg(f'least(1.0::double, {aadt} / 15000.0::double)')}, 0.0::double) ELSE 0.0::double END"


def _case(key: str, table: dict, i: int) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v[i]}::double" for k, v in table.items()) + " END"


RAIL_TYPE_SQL = "CASE WHEN route_type = 0 THEN 'tram' WHEN peak < 4 THEN 'vline' ELSE 'train' END"


def rail_sql(kind: str, dist: str, per_hour: str) -> str:
    d, t = f"greatest({dist}, 10.0::double)", ac.RAIL_EMISSION
    return f"CASE WHEN {per_hour} > 0 THEN greatest({_case(kind, t, 0)} + {lg(_case(kind, t, 2))} + 10 * log10(CASE WHEN {per_hour} > 0 THEN {per_hour} / 3600 END) - {lg(f'{d} / {_case(kind, t, 1)}')} - 3.0::double - greatest({d} - 50, 0.0::double) * 0.04::double, 0.0::double) ELSE 0.0::double END"


def track_sql(cls: str, dist: str) -> str:
    d, t = f"greatest({dist}, 10.0::double)", ac.RAIL_FALLBACK
    return f"coalesce(greatest({_case(cls, t, 0)} - {lg(f'{d} / {_case(cls, t, 1)}')} - 3.0::double - greatest({d} - 50, 0.0::double) * 0.04::double, CASE WHEN {_case(cls, t, 0)} IS NOT NULL THEN 0.0::double END), 0.0::double)"


RADIUS = 500
NEAR_SQL = ",\n".join([
    near_segments_sql("na0", RADIUS, "v_aadt", "seg_id, aadt, hv, road_name"),
    "na AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY property_id, road_name, round_even(dist_m, -1) ORDER BY aadt DESC, dist_m, seg_id) AS rn FROM na0) WHERE rn = 1)",
    near_stations_sql("ns", RADIUS),
    near_segments_sql("nr", RADIUS, "(SELECT * FROM v_roads WHERE subtype = 'road')", "road_id, class, speed_kmh"),
    near_rail_sql("ng", RADIUS),
    near_segments_sql("nt", RADIUS, "(SELECT * FROM v_roads WHERE subtype = 'rail')", "road_id, class"),
])
NOT_MOTOR_SQL = "coalesce(class NOT IN (" + ", ".join(f"'{c}'" for c in places.NOT_MOTOR) + "), true)"
SOURCES_SQL = f"""md AS (SELECT property_id, dist_m AS m FROM na UNION ALL SELECT property_id, dist_m FROM ns),
sr AS (SELECT property_id, 'aadt' AS kind, 0 AS kind_no, seg_id AS sid, road_name AS name, {crtn_sql('aadt', 'dist_m', '(coalesce(hv, 0.0::double) * 100)', '60.0::double')} AS raw, dist_m, near_lng AS src_lng, near_lat AS src_lat, 1.0::double AS factor FROM na
 UNION ALL SELECT property_id, 'station', 1, station_id, road_name, {crtn_sql('aadt', 'dist_m', 'greatest(coalesce(hv_pct, 0.0::double), 0.0::double)', '60.0::double')}, dist_m, lon, slat, 1.0::double FROM ns WHERE NOT EXISTS (SELECT 1 FROM na WHERE na.property_id = ns.property_id AND abs(na.dist_m - ns.dist_m) < 80)
 UNION ALL SELECT property_id, 'road', 2, road_id, class, {crtn_sql(CLASS_AADT_SQL, 'dist_m')}, dist_m, near_lng, near_lat, 1.0::double FROM nr WHERE {NOT_MOTOR_SQL} AND NOT (coalesce(class IN ('motorway', 'trunk', 'primary', 'secondary'), false) AND EXISTS (SELECT 1 FROM md WHERE md.property_id = nr.property_id AND abs(md.m - nr.dist_m) < 80))
 UNION ALL SELECT property_id, 'rail', 3, shape_id, route_name, {rail_sql(RAIL_TYPE_SQL, 'dist_m', '(peak * 0.4::double + offpeak * 0.6::double)')}, dist_m, near_lng, near_lat, least(dist_m / 500, 0.6::double) FROM ng
 UNION ALL SELECT property_id, 'track', 4, road_id, class, {track_sql('class', 'dist_m')}, dist_m, NULL, NULL, 0.0::double FROM nt WHERE property_id NOT IN (SELECT property_id FROM ng)),
so AS MATERIALIZED (SELECT * FROM sr WHERE raw > 0)"""
SCREEN_SQL = centres_sql("bc", RADIUS) + """,
cb AS (SELECT *, bx * nx + by_ * ny AS along, abs(by_ * nx - bx * ny) AS off FROM (
  SELECT *, dx / nullif(size, 0) AS nx, dy / nullif(size, 0) AS ny FROM (
    SELECT *, sqrt(dx * dx + dy * dy) AS size FROM (
      SELECT so.property_id, so.kind_no, so.sid, so.dist_m, bc.h, (p.lng - src_lng) * k AS dx, (p.lat - src_lat) * 111320.0::double AS dy, (clng - src_lng) * k AS bx, (clat - src_lat) * 111320.0::double AS by_
      FROM (SELECT so.*, 111320.0::double * cos(radians((so.src_lat + pp.lat) / 2)) AS k FROM so JOIN v_properties pp ON so.property_id = pp.property_id WHERE src_lng IS NOT NULL AND dist_m >= 20) so
      JOIN v_properties p ON so.property_id = p.property_id JOIN bc ON bc.property_id = so.property_id)))),
cl AS (SELECT property_id, kind_no, sid, floor(along / 20) AS zone, sqrt(along ** 2 + (h - 0.5::double) ** 2) + sqrt((dist_m - along) ** 2 + (h - 1.5::double) ** 2) - dist_m AS det FROM cb WHERE size >= 1 AND along >= 5 AND along <= dist_m - 5 AND off <= 30),
cz AS (SELECT property_id, kind_no, sid, zone, max(least(10 * log10(3 + 20 * (2 * det / 0.34::double) ** 2), 20.0::double)) AS loss FROM cl WHERE det > 0 GROUP BY ALL),
sc AS (SELECT property_id, kind_no, sid, least(25.0::double, max(loss) + 0.4::double * (sum(loss) - max(loss))) AS screen FROM cz GROUP BY ALL),
lv AS MATERIALIZED (SELECT so.*, coalesce(sc.screen, 0.0::double) AS screen, greatest(raw - coalesce(sc.screen, 0.0::double) * factor, 0.0::double) AS level FROM so LEFT JOIN sc ON so.property_id = sc.property_id AND so.kind_no = sc.kind_no AND so.sid = sc.sid)"""
BASE = duckdb_ctes("v_properties", "v_aadt", "v_stations", "v_roads", "v_rail_shapes", "v_rail_frequency", "v_buildings", "v_overlays", "v_raster") + ",\n" + NEAR_SQL + ",\n" + SOURCES_SQL
LEVELS_SQL = BASE + ",\n" + SCREEN_SQL


def energy_sql(*x: str) -> str:
    total = " + ".join(f"CASE WHEN {v} > 0 THEN 10.0::double ** ({v} / 10) ELSE 0.0::double END" for v in x)
    return f"coalesce(10 * log10(nullif({total}, 0)), 0.0::double)"


def period_sql(road: str, rail: str, air: str) -> str:
    leq = f"CASE WHEN {road} > 0 THEN {road} - 3.0::double ELSE 0.0::double END"
    adj = lambda a: f"CASE WHEN ({leq}) > 0 THEN ({leq}) + {a!r}::double ELSE 0.0::double END"
    ev = f"CASE WHEN {rail} > 0 THEN greatest({rail} - 5, 0.0::double) ELSE 0.0::double END"
    g = lambda *x: f"greatest({energy_sql(*(f'({v})' for v in x))}, 35.0::double)"
    return f"{g(adj(ac.DAY_ADJ), rail, air)} AS leq_day, {g(adj(ac.EVE_ADJ), ev, air)} AS leq_eve, {g(adj(ac.NIGHT_ADJ), air)} AS leq_night, {g(leq, rail, air)} AS leq_24h"


LDEN_SQL = "10 * log10((12 * 10.0::double ** (leq_day / 10) + 4 * 10.0::double ** ((leq_eve + 5) / 10) + 8 * 10.0::double ** ((leq_night + 10) / 10)) / 24)"
NOISE_SQL = f"""{inside_sql('h', 'aircraft')},\n{CONTOUR_SQL},
lk AS (SELECT * FROM lv WHERE level > 0 OR kind_no < 2),
rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY level DESC, kind_no, sid) AS rank, max(level) OVER (PARTITION BY property_id) AS peak FROM lk WHERE kind_no < 3) WHERE level >= peak - 6 AND rank <= 8),
rl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY level DESC, kind_no, sid) AS rank, max(level) OVER (PARTITION BY property_id) AS peak FROM lk WHERE kind_no >= 3) WHERE level >= peak - 6 AND rank <= 4),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY level DESC, kind_no, sid) AS rank FROM lk) WHERE rank = 1 AND kind_no < 3 AND round_even(dist_m, 0) > 200),
tq AS (SELECT t.*, r.value FROM (SELECT property_id, i, round_even(dist_m, 0) AS d, src_lat + i / 6.0::double * (lat - src_lat) AS y, src_lng + i / 6.0::double * (lng - src_lng) AS x
  FROM (SELECT tp.property_id, tp.dist_m, tp.src_lat, tp.src_lng, p.lat, p.lng FROM tp JOIN v_properties p ON tp.property_id = p.property_id), range(0, 7) q(i)) t
  LEFT JOIN v_raster r ON r.row = cast(floor((y - -37.9::double) / 0.001::double + 0.5::double) AS INT) AND r.col = cast(floor((x - 144.9::double) / 0.001::double + 0.5::double) AS INT)),
te AS (SELECT property_id, max(CASE WHEN i = 0 THEN value END) AS e0, max(CASE WHEN i = 6 THEN value END) AS e1 FROM tq GROUP BY 1),
tr AS (SELECT property_id, coalesce(max(CASE WHEN rise >= 3 AND d >= 100 AND det > 0 THEN least(10 * log10(3 + 20 * (2 * det / 0.34::double) ** 2), 15.0::double) END), 0.0::double) AS terrain FROM (
  SELECT *, sqrt((d * f) ** 2 + rise ** 2) + sqrt((d * (1 - f)) ** 2 + rise ** 2) - d AS det FROM (
    SELECT tq.property_id, tq.d, i / 6.0::double AS f, value - (e0 + 0.5::double + i / 6.0::double * (e1 + 1.5::double - e0 - 0.5::double)) AS rise FROM tq JOIN te ON tq.property_id = te.property_id WHERE i BETWEEN 1 AND 5 AND value IS NOT NULL)) GROUP BY 1),
n0 AS (SELECT p.property_id, coalesce(tr.terrain, 0.0::double) AS terrain, coalesce(a.road_db, 0.0::double) AS r0, coalesce(b.rail_db, 0.0::double) AS l0, a.dominant_source, coalesce(mx.ms, 0.0::double) AS max_screening,
   CASE WHEN {PENALTY_SQL} > 0 THEN 35.0::double + {PENALTY_SQL} ELSE 0.0::double END AS aircraft_db,
   coalesce(ca.n, 0) AS n_aadt, coalesce(cs.n, 0) AS n_stations, coalesce(cr.n, 0) AS road_count, coalesce(cr.w, 0) AS roads_with_speed, CASE WHEN cg.property_id IS NOT NULL THEN cg.tram ELSE ct.tram END AS tram, CASE WHEN cg.property_id IS NOT NULL THEN cg.train ELSE ct.train END AS train
  FROM v_properties p LEFT JOIN tr ON p.property_id = tr.property_id LEFT JOIN c ON p.property_id = c.property_id
  LEFT JOIN (SELECT property_id, 10 * log10(sum(10.0::double ** (level / 10))) AS road_db, max(CASE WHEN rank = 1 THEN name END) AS dominant_source FROM rs GROUP BY 1) a ON p.property_id = a.property_id
  LEFT JOIN (SELECT property_id, 10 * log10(sum(10.0::double ** (level / 10))) AS rail_db FROM rl GROUP BY 1) b ON p.property_id = b.property_id
  LEFT JOIN (SELECT property_id, max(screen) AS ms FROM lk GROUP BY 1) mx ON p.property_id = mx.property_id
  LEFT JOIN (SELECT property_id, count(*) AS n FROM na GROUP BY 1) ca ON p.property_id = ca.property_id LEFT JOIN (SELECT property_id, count(*) AS n FROM ns GROUP BY 1) cs ON p.property_id = cs.property_id
  LEFT JOIN (SELECT property_id, count(*) AS n, count(*) FILTER (speed_kmh > 0) AS w FROM nr WHERE {NOT_MOTOR_SQL} GROUP BY 1) cr ON p.property_id = cr.property_id
  LEFT JOIN (SELECT property_id, min(CASE WHEN route_type = 0 THEN dist_m END) AS tram, min(CASE WHEN route_type <> 0 THEN dist_m END) AS train FROM ng GROUP BY 1) cg ON p.property_id = cg.property_id
  LEFT JOIN (SELECT property_id, min(CASE WHEN class = 'tram' THEN dist_m END) AS tram, min(CASE WHEN class <> 'tram' THEN dist_m END) AS train FROM nt GROUP BY 1) ct ON p.property_id = ct.property_id),
n1 AS (SELECT *, CASE WHEN terrain > 0 THEN greatest(0.0::double, r0 - terrain * 0.7::double) ELSE r0 END AS road_db, CASE WHEN terrain > 0 THEN greatest(0.0::double, l0 - terrain) ELSE l0 END AS rail_db FROM n0),
n2 AS (SELECT *, {period_sql('road_db', 'rail_db', 'aircraft_db')} FROM n1),
n3 AS (SELECT *, {LDEN_SQL} AS lden FROM n2),
n4 AS (SELECT *, cast(greatest(0, least(100, round_even((75 - lden) / 35 * 100, 0))) AS INT) AS score, {ladder_sql('lden', [(50, '8.0::double'), (60, '5.0::double')], '4.0::double')} + CASE WHEN n_aadt + n_stations > 0 THEN 0.0::double ELSE 3.0::double END AS ci FROM n3)"""


def parts_of(spark: SparkSession, d: str, radius_m: float = RADIUS) -> NoiseParts:
    v = lambda n: view(spark, d, n)
    return noise_parts(v("v_properties"), v("v_aadt"), v("v_stations"), v("v_roads"), v("v_rail_shapes"), v("v_rail_frequency"), v("v_buildings"), radius_m)


def noise(spark: SparkSession, d: str) -> DataFrame:
    return score_noise(view(spark, d, "v_properties"), parts_of(spark, d), aircraft(spark, d), view(spark, d, "v_raster"))


@query("score_noise", LEVELS_SQL + ",\n" + NOISE_SQL + f"""
SELECT property_id, score, {label_sql('noise')} AS label, round_even(lden, 1) AS lden_db, round_even(leq_24h, 1) AS leq_db, round_even(leq_day, 1) AS leq_day_db, round_even(leq_night, 1) AS leq_night_db, round_even(ci, 1) AS ci_db, round_even(greatest(lden - ci, 35.0::double), 1) AS db_low, round_even(lden + ci, 1) AS db_high,
 round_even(road_db, 1) AS road_db, round_even(rail_db, 1) AS rail_db, aircraft_db, round_even(terrain, 1) AS terrain_db, round_even(max_screening, 1) AS max_screening_db, n_aadt, n_stations, road_count, roads_with_speed, dominant_source, round_even(tram, 0) AS nearest_tram_m, round_even(train, 0) AS nearest_train_m FROM n4""")
def q_score_noise(spark: SparkSession, d: str) -> DataFrame:
    return noise(spark, d)


@query("merge_sources", BASE + "\nSELECT property_id, kind, sid, name, round_even(raw, 3) AS raw, round_even(dist_m, 3) AS dist_m FROM so")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    return all_sources(parts_of(spark, d)).select("property_id", "kind", "sid", "name", R4("raw"), R4("dist_m"))


@query("band_anti_join", BASE + "\nSELECT property_id, station_id, round_even(dist_m, 3) AS dist_m FROM ns WHERE NOT EXISTS (SELECT 1 FROM na WHERE na.property_id = ns.property_id AND abs(na.dist_m - ns.dist_m) < 80)")
def band_anti_join(spark: SparkSession, d: str) -> DataFrame:
    p = parts_of(spark, d)
    return without_band(p["stations"], p["aadt"].select("property_id", F.col("dist_m").alias("m_dist"))).select("property_id", "station_id", R4("dist_m"))


@query("dedup_directional", BASE + "\nSELECT property_id, seg_id, road_name, aadt, round_even(dist_m, 3) AS dist_m FROM na")
def q_dedup_directional(spark: SparkSession, d: str) -> DataFrame:
    return parts_of(spark, d)["aadt"].select("property_id", "seg_id", "road_name", "aadt", R4("dist_m"))


@query("join_corridor_buildings", LEVELS_SQL + "\nSELECT property_id, kind_no, sid, cast(zone AS INT) AS zone, round_even(loss, 3) AS loss FROM cz")
def join_corridor_buildings(spark: SparkSession, d: str) -> DataFrame:
    p, props = parts_of(spark, d), view(spark, d, "v_properties")
    c = corridor(p["sources"], props, view(spark, d, "v_buildings"), RADIUS)
    return c.groupBy("property_id", "kind_no", "sid", "zone").agg(F.bround(F.max("loss"), 3).alias("loss"))


@query("barrier_combine", LEVELS_SQL + "\nSELECT property_id, kind_no, sid, round_even(screen, 3) AS screen FROM sc")
def q_barrier_combine(spark: SparkSession, d: str) -> DataFrame:
    return parts_of(spark, d)["levels"].where("screen > 0").select("property_id", "kind_no", "sid", R4("screen"))


@query("adaptive_select", LEVELS_SQL + "\nSELECT property_id, kind_no, sid, cast(rank AS INT) AS rank, round_even(level, 3) AS level FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY level DESC, kind_no, sid) AS rank, max(level) OVER (PARTITION BY property_id) AS peak FROM lv WHERE kind_no < 3) WHERE level >= peak - 6 AND rank <= 8")
def q_adaptive_select(spark: SparkSession, d: str) -> DataFrame:
    return adaptive_select(parts_of(spark, d)["levels"].where("kind_no < 3"), 8).select("property_id", "kind_no", "sid", "rank", R4("level"))


@query("energy_sum", LEVELS_SQL + "\nSELECT property_id, round_even(coalesce(10 * log10(sum(CASE WHEN level > 0 THEN 10.0::double ** (level / 10) END)), 0.0::double), 3) AS total FROM lv GROUP BY property_id")
def energy_sum(spark: SparkSession, d: str) -> DataFrame:
    return parts_of(spark, d)["levels"].groupBy("property_id").agg(F.bround(ac.level_of(F.sum(ac.energy(F.col("level")))), 3).alias("total"))


@query("dominant_source", LEVELS_SQL + "\nSELECT property_id, kind, sid, name, round_even(level, 3) AS level FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY level DESC, kind_no, sid) AS rn FROM lv) WHERE rn = 1")
def dominant_source(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("kind", "sid", "name", "level"), F.struct("level", -F.col("kind_no"), -F.col("sid"))).alias("b")
    return parts_of(spark, d)["levels"].groupBy("property_id").agg(best).select("property_id", "b.kind", "b.sid", "b.name", F.bround("b.level", 3).alias("level"))


FACADE_SQL = f"""{inside_sql('h', 'aircraft')},\n{CONTOUR_SQL},
fa AS (SELECT lv.*, CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END AS b FROM (SELECT lv.*, atan2((src_lng - p.lng) * cos(radians((p.lat + src_lat) / 2)), src_lat - p.lat) AS t FROM lv JOIN v_properties p ON lv.property_id = p.property_id WHERE src_lng IS NOT NULL AND level > 0) lv),
fb AS (SELECT property_id, cast(floor(b / (2 * pi() / 8)) % 8 AS INT) AS s, sum(CASE WHEN kind <> 'rail' THEN 10.0::double ** (level / 10) ELSE 0.0::double END) AS road, sum(CASE WHEN kind = 'rail' THEN 10.0::double ** (level / 10) ELSE 0.0::double END) AS rail FROM fa GROUP BY 1, 2),
fc AS (SELECT property_id, (s + o + 8) % 8 AS t, sum(road * k) AS road, sum(rail * k) AS rail FROM fb, (VALUES (0, 0.8::double), (1, 0.1::double), (-1, 0.1::double)) q(o, k) GROUP BY 1, 2),
fd AS (SELECT p.property_id, g.t, coalesce(10 * log10(nullif(fc.road, 0)), 0.0::double) AS road_db, coalesce(10 * log10(nullif(fc.rail, 0)), 0.0::double) AS rail_db, CASE WHEN {PENALTY_SQL} > 0 THEN 35.0::double + {PENALTY_SQL} ELSE 0.0::double END AS aircraft_db FROM v_properties p CROSS JOIN range(0, 8) g(t) LEFT JOIN fc ON p.property_id = fc.property_id AND g.t = fc.t LEFT JOIN c ON p.property_id = c.property_id),
fe AS (SELECT property_id, t, round_even({LDEN_SQL}, 1) AS l FROM (SELECT *, {period_sql('road_db', 'rail_db', 'aircraft_db')} FROM fd)),
ff AS (SELECT property_id, max(l) AS hi, min(l) AS lo FROM fe GROUP BY 1)"""


@query("facade_sectors", LEVELS_SQL + ",\n" + FACADE_SQL + "\nSELECT ff.property_id, hi AS lden_max_facade, lo AS lden_min_facade, ['N','NE','E','SE','S','SW','W','NW'][min(CASE WHEN l = hi THEN t END) + 1] AS max_facade_dir, ['N','NE','E','SE','S','SW','W','NW'][min(CASE WHEN l = lo THEN t END) + 1] AS min_facade_dir, round_even(hi - lo, 1) AS facade_range_db FROM ff JOIN fe ON ff.property_id = fe.property_id GROUP BY ff.property_id, hi, lo")
def facade_sectors(spark: SparkSession, d: str) -> DataFrame:
    return facade(parts_of(spark, d)["levels"], view(spark, d, "v_properties"), with_aircraft_level(aircraft(spark, d)))


def noise_sources(props: DataFrame, parts: dict[str, DataFrame], rail_factor: float = 0.6, most: int = 30) -> DataFrame:
    """Long table of sources that explain a score: all measured and rail ones, and of map roads the ``most`` loudest of 35 dB
    and more that keep 30 dB behind buildings. Rail screening counts at a fixed factor here."""
    rows = parts["levels"].withColumn("level", F.when(F.col("kind") == "rail", F.greatest(F.col("raw") - F.col("screen") * rail_factor, F.lit(0.0))).otherwise(F.col("level")))
    top = rows.where("kind = 'road' and raw >= 35").withColumn("rn", F.row_number().over(Window.partitionBy("property_id").orderBy(F.desc("raw"), "sid"))).where((F.col("rn") <= most) & (F.col("level") >= 30)).drop("rn")
    return rows.where("kind <> 'road'").unionByName(top).select("property_id", "kind", "sid", "name", "dist_m", "raw", "screen", "level", "src_lng", "src_lat")


DEBUG_SQL = "db AS (SELECT *, CASE WHEN kind = 'rail' THEN greatest(raw - screen * 0.6::double, 0.0::double) ELSE level END AS lvl, row_number() OVER (PARTITION BY property_id, kind ORDER BY raw DESC, sid) AS rn FROM lv)"


@query("noise_sources", LEVELS_SQL + ",\n" + DEBUG_SQL + "\nSELECT property_id, kind, sid, name, round_even(dist_m, 2) AS dist_m, round_even(raw, 2) AS raw, round_even(screen, 2) AS screen, round_even(lvl, 2) AS level FROM db WHERE kind <> 'road' OR (raw >= 35 AND rn <= 30 AND lvl >= 30)")
def q_noise_sources(spark: SparkSession, d: str) -> DataFrame:
    return noise_sources(view(spark, d, "v_properties"), parts_of(spark, d)).select("property_id", "kind", "sid", "name", *[R4(c, 2) for c in ("dist_m", "raw", "screen", "level")])


@query("top30_sources", LEVELS_SQL + ",\n" + DEBUG_SQL + "\nSELECT property_id, sid, cast(rn AS INT) AS rn, round_even(raw, 2) AS raw FROM db WHERE kind = 'road' AND raw >= 35 AND rn <= 30")
def top30_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = parts_of(spark, d)["levels"].where("kind = 'road' and raw >= 35")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("property_id").orderBy(F.desc("raw"), "sid"))).where("rn <= 30").select("property_id", "sid", "rn", R4("raw", 2))


def elevation_profile(paths: DataFrame, raster: DataFrame, n: int = 21, digits: int = 1) -> DataFrame:
    """(property_id, sid, i, dist_m, elev_m, sight_m): ground and line of sight along the way from a source."""
    s = raster_at(path_samples(paths, n), raster)
    w = Window.partitionBy("property_id", "sid")
    e0, e1 = (F.max(F.when(F.col("i") == k, F.col("value"))).over(w) for k in (0, n - 1))
    dy = (F.col("lat") - F.col("src_lat")) * geo.M_PER_DEG
    dx = (F.col("lng") - F.col("src_lng")) * geo.M_PER_DEG * F.cos(F.radians((F.col("src_lat") + F.col("lat")) / 2))
    t = F.col("i") / F.lit(float(n - 1))
    return s.select("property_id", "sid", "i", F.bround(F.sqrt(dx * dx + dy * dy) * t, digits).alias("dist_m"), F.bround("value", digits).alias("elev_m"), F.bround(e0 + SOURCE_M + t * (e1 + EAR_M - e0 - SOURCE_M), digits).alias("sight_m"))


PATHS_SQL = duckdb_ctes("v_properties", "v_stations", "v_raster") + ",\n" + near_stations_sql("ns", 1000) + """,
pa AS (SELECT ns.property_id, ns.station_id AS sid, ns.lon, ns.slat, p.lat, p.lng, i FROM ns JOIN v_properties p ON ns.property_id = p.property_id, range(0, 21) q(i)),
pv AS (SELECT pa.*, r.value FROM pa LEFT JOIN v_raster r ON r.row = cast(floor((slat + i / 20.0::double * (lat - slat) - -37.9::double) / 0.001::double + 0.5::double) AS INT) AND r.col = cast(floor((lon + i / 20.0::double * (lng - lon) - 144.9::double) / 0.001::double + 0.5::double) AS INT)),
pw AS (SELECT *, max(CASE WHEN i = 0 THEN value END) OVER w AS e0, max(CASE WHEN i = 20 THEN value END) OVER w AS e1 FROM pv WINDOW w AS (PARTITION BY property_id, sid))"""


@query("elevation_profile", PATHS_SQL + "\nSELECT property_id, sid, cast(i AS INT) AS i, round_even(sqrt(((lng - lon) * 111320.0::double * cos(radians((slat + lat) / 2))) ** 2 + ((lat - slat) * 111320.0::double) ** 2) * (i / 20.0::double), 4) AS dist_m, round_even(value, 4) AS elev_m, round_even(e0 + 0.5::double + i / 20.0::double * (e1 + 1.5::double - e0 - 0.5::double), 4) AS sight_m FROM pw")
def q_elevation_profile(spark: SparkSession, d: str) -> DataFrame:
    props = view(spark, d, "v_properties")
    paths = nearby.stations(props, view(spark, d, "v_stations"), 1000).select("property_id", F.col("station_id").alias("sid"), F.col("lon").alias("src_lng"), F.col("slat").alias("src_lat")).join(nearby.keyed(props), "property_id")
    return elevation_profile(paths, view(spark, d, "v_raster"), digits=4)

