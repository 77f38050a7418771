"""What is near a property: roads, rails, counted traffic, places, buildings, water."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteline.functions import geo
from siteline.operators import dense, spatial

KEY = ["property_id", "lat", "lng"]


def keyed(props: DataFrame) -> DataFrame:
    """Properties with a place: property_id, lat, lng. All joins with them go by shuffle, whatever size Spark guesses."""
    return props.select(*KEY).where("lat is not null and lng is not null").hint("merge")


def beside(rows: DataFrame, *tables: DataFrame) -> DataFrame:
    """``rows`` with the columns of tables by property_id, null where one has no row. They have up to a row a property, which
    can be far from the size that Spark guesses after several joins and aggregates, so none is broadcast."""
    for t in tables:
        rows = rows.join(t.hint("merge"), "property_id", "left")
    return rows


def roads(props: DataFrame, all_roads: DataFrame, radius_m: float = 1000, subtype: str = "road") -> DataFrame:
    """(property_id, road_id, class, dist_m, speed_kmh, near_lng, near_lat) of road or rail segments within the radius."""
    some = all_roads.where(F.col("subtype") == subtype).select("road_id", "class", "speed_kmh", "x1", "y1", "x2", "y2", "xmin", "ymin")
    return spatial.near_segments(keyed(props), some, radius_m).select("property_id", "road_id", "class", "dist_m", "speed_kmh", "near_lng", "near_lat")


def counted(props: DataFrame, aadt: DataFrame, radius_m: float = 500) -> DataFrame:
    """(property_id, seg_id, aadt, hv, road_name, dist_m, near_lng, near_lat) of measured traffic lines."""
    found = spatial.near_segments(keyed(props), aadt.select("seg_id", "aadt", "hv", "road_name", "x1", "y1", "x2", "y2", "xmin", "ymin"), radius_m)
    return found.select("property_id", "seg_id", "aadt", "hv", "road_name", "dist_m", "near_lng", "near_lat")


def station_aadt(stations: DataFrame) -> DataFrame:
    """One row per station: its two-way count if there is one, else the sum of its directions; stations without count go."""
    both = F.max(F.when(F.col("direction").isNull(), F.col("aadt")))
    one = F.sum(F.when(F.col("direction").isNotNull(), F.col("aadt")))
    out = stations.groupBy("station_id", "road_name", "lon", F.col("lat").alias("slat")).agg(F.coalesce(both, one).cast("long").alias("aadt"), F.max("heavy_vehicle_pct").alias("hv_pct"))
    return out.where("aadt is not null")


def stations(props: DataFrame, all_stations: DataFrame, radius_m: float = 1000) -> DataFrame:
    """(property_id, station_id, aadt, hv_pct, road_name, dist_m, lon, slat) of counting stations."""
    found = spatial.near_points(keyed(props), station_aadt(all_stations), radius_m, "lon", "slat", "anisotropic")
    return found.select("property_id", "station_id", "aadt", "hv_pct", "road_name", "dist_m", "lon", "slat")


def rail(props: DataFrame, shapes: DataFrame, frequency: DataFrame, radius_m: float = 1000) -> DataFrame:
    """(property_id, shape_id, route_type, route_name, dist_m, peak, offpeak, near_lng, near_lat): the nearest point of
    each rail shape within the radius, with its route's services per hour."""
    points = shapes.select("shape_id", "route_type", F.col("sequence").alias("seq"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    pairs = spatial.near_points(keyed(props), points, radius_m, "s_lng", "s_lat", "anisotropic")
    best = spatial.nearest_by_group(pairs, ["property_id", "shape_id", "route_type"], "dist_m", ["s_lng", "s_lat"], radius_m, ["seq"])
    return best.join(frequency.select("shape_id", "route_name", "peak", "offpeak"), "shape_id").select("property_id", "shape_id", "route_type", "route_name", "dist_m", "peak", "offpeak", F.col("s_lng").alias("near_lng"), F.col("s_lat").alias("near_lat"))


def places(props: DataFrame, pois: DataFrame, radius_m: float = 1500) -> DataFrame:
    """(property_id, poi_id, category, dist_m) of places within the radius."""
    points = pois.select("poi_id", "category", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    return spatial.near_points(keyed(props), points, radius_m, "p_lng", "p_lat").select("property_id", "poi_id", "category", "dist_m")


def places_dense(props: DataFrame, pois: DataFrame, folder: str, radius_m: float = 1500, most: int = 50_000) -> DataFrame:
    """The rows of ``places`` where so many stand close together that squares of one size won't do; ``folder`` is for the
    counts of crowded squares."""
    points = pois.select("poi_id", "category", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    dist = geo.dist_isotropic(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    pairs = dense.dense_join(keyed(props), points, radius_m, "p_lng", "p_lat", folder, dist < radius_m, most)
    return pairs.select("property_id", "poi_id", "category", dist.alias("dist_m"))


def _box_distance(lat: Column, lng: Column) -> Column:
    dx = F.greatest(F.col("xmin") - lng, F.lit(0.0), lng - F.col("xmax"))
    dy = F.greatest(F.col("ymin") - lat, F.lit(0.0), lat - F.col("ymax"))
    return F.sqrt(dx * dx + dy * dy) * geo.lng_scale(lat)


def buildings(props: DataFrame, all_buildings: DataFrame, radius_m: float = 500) -> DataFrame:
    """(property_id, id, height, dist_m, floors) of building footprints (boxes) within the radius; 0 inside one."""
    dist = _box_distance(F.col("lat"), F.col("lng"))
    feats = all_buildings.select("id", "height", "floors", "xmin", "xmax", "ymin", "ymax")
    found = spatial.corner_join(keyed(props), feats, radius_m, "xmin", "ymin", dist < radius_m)
    return found.select("property_id", "id", "height", dist.alias("dist_m"), "floors")


def building_centres(props: DataFrame, all_buildings: DataFrame, radius_m: float, default_height: float = 6.0) -> DataFrame:
    """(property_id, id, h, clng, clat) of buildings whose box overlaps the window; no test of the radius itself."""
    feats = all_buildings.select("id", F.coalesce("height", F.lit(default_height)).alias("h"), "clng", "clat", "xmin", "xmax", "ymin", "ymax")
    return spatial.overlapping(keyed(props), feats, radius_m).select("property_id", "id", "h", "clng", "clat")


def water(props: DataFrame, edges: DataFrame, radius_m: float = 5000) -> DataFrame:
    """(property_id, water_id, class, subtype, dist_m) of water bodies within the radius."""
    feats = edges.select("water_id", "class", "subtype", "x1", "y1", "x2", "y2", "xmin", "xmax", "ymin", "ymax")
    return spatial.near_polygons(keyed(props), feats, "water_id", radius_m, ["class", "subtype"])


def shapes_near(props: DataFrame, shapes: DataFrame, radius_m: float = 1000) -> DataFrame:
    """(property_id, shape_id, route_type, seq, s_lat, s_lng): points in the (doubled) window of shapes that come within
    the radius, in order of seq."""
    points = shapes.select("shape_id", "route_type", F.col("sequence").alias("seq"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    wide = radius_m * 2.0 / geo.WINDOW_FACTOR
    pairs = spatial.corner_join(keyed(props), points, wide, "s_lng", "s_lat")
    pairs = pairs.withColumn("dist_m", geo.dist_anisotropic(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")))
    near = pairs.groupBy("property_id", "shape_id").agg(F.min("dist_m").alias("d")).where(F.col("d") < radius_m)
    return pairs.join(near.select("property_id", "shape_id"), ["property_id", "shape_id"], "left_semi").select("property_id", "shape_id", "route_type", "seq", "s_lat", "s_lng")
