"""Location tables derived from the driver's business tables, in one SQL text for both engines.

The driver's tables hold no coordinates. Each view turns keys into coordinates by integer arithmetic and one division, so
that both engines get the same doubles; keys are cut into blocks of their own box, so density doesn't grow with scale.
Texts are in Spark's dialect; ``for_duckdb`` rewrites integer division, double literals and a few names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Categories for derived places, by number.
CATEGORIES = ["supermarket", "Fast Food", "clothing_store", "coffee shop", "bank", "playground", "university", "cinema", "gym", "drugstore", "clinic", "train_station", "library", "gas_station", "auto_repair", "commercial_industrial", "beach", "botanical_garden", "nightclub", "Convenience Store", "warehouse", "forest_reserve", "restaurant", "tram_stop"]
ROAD_CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "residential", "service", "footway", "living_street", "unclassified", "residential"]
WATER_CLASSES = ["ocean", "lake", "river", "bay", "stream", "pond"]


def _lat(k: str, m: int, q: int, block: int) -> str:
    return f"(-37.9D + (({k} div {block}) div 10) * 0.25D + (({k} * {m}) % {q}) / 100000.0D)"


def _lng(k: str, m: int, q: int, block: int) -> str:
    return f"(144.9D + (({k} div {block}) % 10) * 0.25D + (({k} * {m}) % {q}) / 100000.0D)"


def _pick(words: list[str], k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} % {len(words)} = {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


# Places in other states and one outside all (latitude, longitude), for rows that are put there.
FAR = {"NSW": (-33.8, 151.0), "WA": (-31.9, 115.8), "SA": (-34.9, 138.5), "TAS": (-42.8, 147.2), "ACT": (-35.3, 149.1), "QLD": (-27.4, 153.0), "outside": (-20.0, 170.0)}


def _anchor(axis: int, which: str, states: list[str], n: str) -> str:
    """Latitude (axis 0) or longitude of the n-th row put near the place of number ``which`` of ``states``: thirty to a
    square of 0.02 degrees, and 64 squares before they fill up again."""
    place = "CASE " + " ".join(f"WHEN {which} = {i} THEN {FAR[s][axis]}D" for i, s in enumerate(states)) + " END"
    square = f"(({n} div 30) % 8)" if axis else f"(({n} div 240) % 8)"
    return f"({place} + {square} * 0.05D + ({n} * {(7919, 6007)[axis]}) % 2003 / 100000.0D)"


def _or_far(near: str, far: str, test: str) -> str:
    return f"CASE WHEN {test} THEN {far} ELSE {near} END"


_PUT = ("c_custkey % 50 = 49", "(c_custkey div 50) % 7", list(FAR), "(c_custkey div 350)")
_SITE = ("s_suppkey % 3 > 0", "(s_suppkey % 3 - 1)", ["NSW", "WA"], "(s_suppkey div 3)")
_ZONE = ("n_nationkey % 5 = 4", "((n_nationkey % 25) div 5)", ["NSW", "WA", "SA", "TAS", "ACT"], "(n_nationkey div 25)")
#: Twenty-five polygons for each box that suppliers occupy.
_AREAS = "(SELECT n_nationkey + 25 * b AS n_nationkey FROM nation CROSS JOIN (SELECT DISTINCT s_suppkey div 100 AS b FROM supplier))"


def _placed(axis: int, key: str, m: int, q: int, block: int, put: tuple[str, str, list[str], str]) -> str:
    near = (_lng if axis else _lat)(key, m, q, block)
    return _or_far(near, _anchor(axis, *put[1:]), put[0])


#: The boxes that customers occupy, and the cells of a grid over each: n to a side, ``step`` of them from box to box.
def _boxes(n: int, step: int, cols: str) -> str:
    boxes = f"SELECT b, r0, explode(sequence(0, {n - 1})) AS c0 FROM (SELECT b, explode(sequence(0, {n - 1})) AS r0 FROM (SELECT DISTINCT c_custkey div 1500 AS b FROM customer))"
    return f"SELECT {cols} FROM (SELECT b, (b div 10) * {step} + r0 AS r, (b % 10) * {step} + c0 AS c FROM ({boxes}))"


_OCT = [(1000, 0), (707, 707), (0, 1000), (-707, 707), (-1000, 0), (-707, -707), (0, -1000), (707, -707)]


def _octagon(key: str, base: str, radius: str, cols: str, source: str) -> str:
    """Edges of octagons around (lat, lng) of ``base``."""
    edges = " UNION ALL ".join(f"SELECT {i} AS i, {a} AS ax, {b} AS ay, {c} AS bx, {d} AS by_" for i, ((a, b), (c, d)) in enumerate(zip(_OCT, _OCT[1:] + _OCT[:1], strict=True)))
    r = f"({radius}) / 1000000.0D"
    return f"SELECT {key}, {cols}, i, lng + ax * {r} AS x1, lat + ay * {r} AS y1, lng + bx * {r} AS x2, lat + by_ * {r} AS y2, lng - 1000 * {r} AS xmin, lng + 1000 * {r} AS xmax, lat - 1000 * {r} AS ymin, lat + 1000 * {r} AS ymax FROM (SELECT *, {base} FROM {source}) CROSS JOIN ({edges})"


VIEWS: dict[str, str] = {
    "v_properties": f"SELECT c_custkey AS property_id, {_placed(0, 'c_custkey', 7919, 20011, 1500, _PUT)} AS lat, {_placed(1, 'c_custkey', 104729, 20021, 1500, _PUT)} AS lng, cast(20 + c_custkey % 100 AS double) AS roof_area_m2, {_pick(['optimal', 'east', 'west', 'suboptimal'], 'c_custkey')} AS orientation FROM customer",
    "v_pois": f"SELECT p_partkey AS poi_id, {_lat('p_partkey', 6271, 20023, 2000)} AS lat, {_lng('p_partkey', 15485863, 20029, 2000)} AS lng, {_pick(CATEGORIES, 'p_partkey')} AS category FROM part",
    "v_core": "SELECT poi_id, category, CASE WHEN poi_id % 10 < 9 THEN -37.85D + (poi_id * 613) % 1009 / 100000.0D ELSE lat END AS lat, CASE WHEN poi_id % 10 < 9 THEN 144.95D + (poi_id * 757) % 1013 / 100000.0D ELSE lng END AS lng FROM v_pois",
    "v_roads": f"SELECT road_id, class, subtype, speed_kmh, x1, y1, x1 + dx AS x2, y1 + dy AS y2, least(x1, x1 + dx) AS xmin, least(y1, y1 + dy) AS ymin, greatest(x1, x1 + dx) AS xmax, greatest(y1, y1 + dy) AS ymax FROM (SELECT o_orderkey AS road_id, {_lng('o_orderkey', 3571, 20047, 15000)} AS x1, {_lat('o_orderkey', 4409, 20051, 15000)} AS y1, ((o_orderkey * 31) % 401 - 200) / 100000.0D AS dx, ((o_orderkey * 37) % 401 - 200) / 100000.0D AS dy, CASE WHEN o_orderkey % 20 = 0 THEN {_pick(['standard_gauge', 'tram', 'narrow_gauge'], '(o_orderkey div 20)')} ELSE {_pick(ROAD_CLASSES, 'o_orderkey')} END AS class, CASE WHEN o_orderkey % 20 = 0 THEN 'rail' ELSE 'road' END AS subtype, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(30 + 10 * (o_orderkey % 8) AS double) END AS speed_kmh FROM orders)",
    "v_buildings": f"SELECT id, lat, lng, side, height, floors, lng AS xmin, lng + side AS xmax, lat AS ymin, lat + side AS ymax, lng + side / 2 AS clng, lat + side / 2 AS clat FROM (SELECT id, {_lat('id', 9973, 20063, 120000)} AS lat, {_lng('id', 7723, 20071, 120000)} AS lng, (1 + id % 3) / 10000.0D AS side, CASE WHEN id % 5 = 0 THEN NULL ELSE h END AS height, cast(1 + id % 4 AS int) AS floors FROM (SELECT l_orderkey * 8 + l_linenumber AS id, max(l_quantity) AS h FROM lineitem GROUP BY l_orderkey * 8 + l_linenumber))",
    "v_water": _octagon("n_nationkey AS water_id", f"{_lat('n_nationkey', 7001, 20011, 25)} AS lat, {_lng('n_nationkey', 9001, 20021, 25)} AS lng", "5 + n_nationkey % 25", f"{_pick(WATER_CLASSES, 'n_nationkey')} AS class, 'water' AS subtype", _AREAS),
    "v_stations": f"SELECT s_suppkey AS station_id, concat('Road ', cast(s_suppkey % 7 AS string)) AS road_name, {_pick(['VIC', 'NSW', 'WA'], 's_suppkey')} AS state, {_lng('s_suppkey', 8009, 20021, 100)} AS lon, {_lat('s_suppkey', 6007, 20011, 100)} AS lat, cast(200 + (s_suppkey * 977 + d * 31) % 40000 AS bigint) AS aadt, cast(CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE s_suppkey % 25 END AS double) AS heavy_vehicle_pct, CASE WHEN d = 0 THEN 'N' WHEN d = 1 THEN 'S' END AS direction, cast(2015 + s_suppkey % 9 AS int) AS year FROM supplier CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2) WHERE d < 2 OR s_suppkey % 4 = 0",
    "v_aadt": "SELECT road_id AS seg_id, concat('R', cast(road_id % 50 AS string)) AS road_name, cast(500 + (road_id * 131) % 30000 AS bigint) AS aadt, CASE WHEN road_id % 70 = 0 THEN NULL ELSE (road_id % 200) / 1000.0D END AS hv, x1, y1, x2, y2, xmin, ymin FROM v_roads WHERE road_id % 10 = 0",
    "v_rail_shapes": f"SELECT l_suppkey % 20 AS shape_id, cast(CASE WHEN l_suppkey % 20 % 3 = 0 THEN 0 WHEN l_suppkey % 20 % 3 = 1 THEN 1 ELSE 2 END AS int) AS route_type, l_linenumber AS sequence, {_lat('(l_suppkey % 20 * 8)', 2503, 20011, 1000)} + l_linenumber * 0.004D AS lat, {_lng('(l_suppkey % 20 * 8)', 3301, 20021, 1000)} + l_linenumber * 0.003D AS lng, 'VIC' AS state FROM lineitem GROUP BY l_suppkey % 20, l_linenumber",
    "v_rail_frequency": "SELECT s_suppkey AS shape_id, concat('Line ', cast(s_suppkey AS string)) AS route_name, cast((s_suppkey * 7) % 25 AS double) AS peak, cast((s_suppkey * 5) % 12 AS double) AS offpeak FROM supplier WHERE s_suppkey < 20",
    "v_overlays": _octagon("n_nationkey AS overlay_id", f"{_placed(0, 'n_nationkey', 5003, 20011, 25, _ZONE)} AS lat, {_placed(1, 'n_nationkey', 4001, 20021, 25, _ZONE)} AS lng", "20 + 2 * (n_nationkey % 25)", f"{_pick(['flood', 'bushfire', 'aircraft'], 'n_nationkey')} AS theme, CASE WHEN {_ZONE[0]} THEN {_pick(_ZONE[2], _ZONE[1])} ELSE 'VIC' END AS state, concat('Layer ', cast(n_nationkey % 4 AS string)) AS layer_name, cast(n_nationkey % 4 AS int) AS layer_no, CASE WHEN n_nationkey % 3 = 0 THEN {_pick(['floodway', 'flood', 'moderate'], '(n_nationkey div 3)')} WHEN n_nationkey % 3 = 1 THEN {_pick(['high', 'extreme', 'moderate', 'low'], '(n_nationkey div 3)')} END AS severity, concat('ANEF ', cast(15 + 5 * (n_nationkey % 5) AS string), ' - ', cast(20 + 5 * (n_nationkey % 5) AS string)) AS code, concat('Field ', cast(n_nationkey % 5 AS string)) AS airfield, cast(CASE WHEN n_nationkey % 6 = 2 THEN 1 ELSE 0 END AS int) AS defence", _AREAS),
    "v_climate": "SELECT cell_id, day, max(t) AS temperature_2m_max, max(p) AS precipitation FROM (SELECT user_id AS cell_id, cast(ts AS date) AS day, 15 + value / 20 AS t, CASE WHEN event_type = 'error' THEN value / 10 ELSE 0.0D END AS p FROM events) GROUP BY cell_id, day",
    "v_measured": "SELECT property_id, lat, lng, cast(40 + (property_id * 13) % 35 AS double) AS laeq, cast(38 + (property_id * 17) % 45 AS double) AS la50, cast(property_id % 12 AS int) AS measure_count, cast(property_id % 7 AS int) AS city FROM v_properties",
    "v_pred": "SELECT property_id, city, laeq, measure_count, laeq + ((property_id * 29) % 25 - 12) AS predicted FROM v_measured",
    "v_epa": f"SELECT s_suppkey AS site_id, concat('Site ', cast(s_suppkey AS string)) AS name, {_pick(['fuel', 'landfill', 'gasworks'], 's_suppkey')} AS issue, {_placed(0, 's_suppkey', 12007, 20011, 100, _SITE)} AS lat, {_placed(1, 's_suppkey', 14009, 20021, 100, _SITE)} AS lng, {_pick(['VIC', 'NSW', 'WA'], 's_suppkey')} AS state FROM supplier",
    "v_departures": "SELECT concat('r', cast(user_id % 30 AS string)) AS route_id, event_id AS trip_id, event_type AS service_id, concat('s', cast(user_id % 30 AS string), '_', cast(event_id % 3 AS string)) AS shape_id, cast(hour(ts) AS int) AS hour FROM events",
    "v_raster": _boxes(201, 250, "cast(r AS int) AS row, cast(c AS int) AS col, cast((r * 17 + c * 31 + r * c) % 101 AS double) AS value"),
    "v_grid": _boxes(101, 125, "-37.9D + r * 0.002D AS lat, 144.9D + c * 0.002D AS lng, cast((r * 7 + c * 11) % 101 AS int) AS score, r, c"),
    "v_lattice": _boxes(41, 50, "b * 1681 + (r - (b div 10) * 50) * 41 + c - (b % 10) * 50 AS property_id, -37.9D + r * 0.005D AS lat, 144.9D + c * 0.005D AS lng"),
}
#: Views with a row a property, place or cell: Spark guesses their size by the few columns that they read of compressed files.
MANY = ["v_properties", "v_measured", "v_pred", "v_raster", "v_grid", "v_lattice", "v_pois", "v_core"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def for_duckdb(sql: str) -> str:
    """The same view in DuckDB's dialect."""
    sql = re.sub(r"(\d+\.\d+)D\b", r"\1::double", sql)
    return sql.replace(" div ", " // ").replace(" AS string)", " AS varchar)").replace("explode(sequence(", "unnest(generate_series(")


def _text(sf_dir: str, name: str) -> str:
    """A view's SQL over the files of a folder, the views that it needs written out in it."""
    sql = VIEWS[name]
    for t in [*TABLES, *VIEWS]:
        source = f"({_text(sf_dir, t)})" if t in VIEWS and re.search(rf"\b(FROM|JOIN) {t}\b", sql) else f"parquet.`{sf_dir}/{t}.parquet`"
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", lambda m, source=source: f"{m[1]} {source}", sql)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder or a view derived from them; nothing is registered in the session's catalog.

    Views of many rows come with a hint for joins by shuffle, as their guessed size is far below the real one (a raster of 24
    million cells counts as a part of a customer file of 3 MB) and Spark would send them whole through the driver. Rows of
    boxes and properties are dealt out before anything is made of them: the files that they come from are a task or two, and
    boxes alone, dealt out by what they were made distinct by, are taken together again.
    """
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    boxes = "SELECT b, explode("
    dealt = boxes.replace("SELECT", f"SELECT /*+ REPARTITION({spark.conf.get('spark.sql.shuffle.partitions')}, b, r0) */")
    out = spark.sql(_text(sf_dir, name).replace(boxes, dealt))
    out = out.repartition("property_id") if name == "v_properties" else out
    return out.hint("merge") if name in MANY else out


def duckdb_ctes(*names: str) -> str:
    """A WITH clause that defines the views, and those they need, for DuckDB."""
    need: list[str] = []

    def add(n: str) -> None:
        for m in VIEWS:
            if m != n and re.search(rf"\bFROM {m}\b", VIEWS[n]):
                add(m)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({for_duckdb(VIEWS[n])})" for n in need)
