"""Jobs that build the landed tables: timetables, traffic counts, rain percentiles, contours, and file sources and sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteline.operators import ranks
from siteline.plans.q_nearby import R4
from siteline.registry import query
from siteline.sources.views import duckdb_ctes, view

PEAK, OFFPEAK = [7, 8], [10, 11, 12, 13, 14]


# -- timetable -------------------------------------------------------------------------------------------------------


def departure_hour(time: Column) -> Column:
    """Hour of a timetable's time, which may pass 24."""
    return F.split_part(time, F.lit(":"), F.lit(1)).try_cast("int")


def route_type(raw: Column, extended: dict[str, int]) -> Column:
    """Standard type of an extended one; 2 for others."""
    out = F.lit(2)
    for k, v in extended.items():
        out = F.when(raw == k, F.lit(v)).otherwise(out)
    return out


#: Extended route types and the standard types that they stand for.
ROUTE_TYPES = {"0": 0, "900": 0, "1": 1, "400": 1, "401": 1, "2": 2, "100": 2, "102": 2, "106": 2, "109": 2}


def reference_date(first_start: Column) -> Column:
    """The first Wednesday on or after a date, and a week on."""
    return F.date_add(F.next_day(F.date_sub(first_start, 1), "WED"), 7)


def active_services(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(feed, service_id) that run on the feed's reference day: the Wednesday, or else the first of Tuesday, Thursday,
    Monday and Friday of its week with a service.

    calendar: feed, service_id, start, end, monday .. friday (0 or 1); exceptions: feed, service_id, date, kind (1 added,
    2 taken away).
    """
    first = calendar.where("wednesday = 1").groupBy("feed").agg(reference_date(F.min("start")).alias("wed"))
    days = [("wednesday", 0), ("tuesday", -1), ("thursday", 1), ("monday", -2), ("friday", 2)]
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name"), F.date_add("wed", o).alias("day")) for i, (n, o) in enumerate(days)]))
    wanted = first.select("feed", tries.alias("t")).select("feed", "t.*")
    runs = F.lit(False)
    for n, _ in days:
        runs = runs | ((F.col("name") == n) & (F.col(n) == 1))
    regular = calendar.join(F.broadcast(wanted), "feed").where(runs & (F.col("start") <= F.col("day")) & (F.col("end") >= F.col("day"))).select("feed", "rank", "day", "service_id")
    off = exceptions.where("kind = 2").select("feed", F.col("date").alias("day"), "service_id")
    on = exceptions.where("kind = 1").select("feed", F.col("date").alias("day"), "service_id").join(F.broadcast(wanted), ["feed", "day"]).select("feed", "rank", "day", "service_id")
    all_ = regular.join(off, ["feed", "day", "service_id"], "left_anti").select("feed", "rank", "day", "service_id").unionByName(on).distinct()
    best = all_.groupBy("feed").agg(F.min("rank").alias("rank"))
    return all_.join(F.broadcast(best), ["feed", "rank"]).select("feed", "service_id", "day")


def first_stops(stop_times: DataFrame) -> DataFrame:
    """(trip_id, departure_time) at each trip's least stop number."""
    return stop_times.groupBy("trip_id").agg(F.min_by("departure_time", F.struct("stop_sequence", "departure_time")).alias("departure_time"), F.min("stop_sequence").alias("first_seq"))


def departures(trips: DataFrame, services: DataFrame, routes: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(route_id, trip_id, shape_id, hour): first departures of running trips on the routes.

    Trips that start at stop number 1 count; where these are fewer than the feed's routes, all trips do.
    """
    running = trips.join(services.select("feed", "service_id"), ["feed", "service_id"], "left_semi").join(routes.select("feed", "route_id"), ["feed", "route_id"], "left_semi")
    rows = running.join(first_stops(stop_times), "trip_id").withColumn("at_one", F.col("first_seq") == 1)
    ones = rows.groupBy("feed").agg(F.count_if("at_one").alias("n1"))
    n = routes.groupBy("feed").agg(F.count("*").alias("n_routes"))
    feeds = F.broadcast(n.join(ones, "feed", "left").select("feed", (F.coalesce("n1", F.lit(0)) < F.col("n_routes")).alias("every")))
    return rows.join(feeds, "feed").where(F.col("every") | F.col("at_one")).select("feed", "route_id", "trip_id", "shape_id", departure_hour(F.col("departure_time")).alias("hour"))


def route_frequency(deps: DataFrame) -> DataFrame:
    """(feed, route_id, peak, offpeak): departures per hour."""
    return deps.groupBy("feed", "route_id").agg((F.count_if(F.col("hour").isin(PEAK)) / 2.0).alias("peak"), (F.count_if(F.col("hour").isin(OFFPEAK)) / 5.0).alias("offpeak"))


def with_frequency(routes: DataFrame, freq: DataFrame) -> DataFrame:
    """Routes with their rates; routes without departures get 0."""
    out = routes.join(freq, ["feed", "route_id"], "left")
    return out.withColumn("peak", F.coalesce("peak", F.lit(0.0))).withColumn("offpeak", F.coalesce("offpeak", F.lit(0.0)))


def most_used_shape(trips: DataFrame) -> DataFrame:
    """(feed, route_id, shape_id) of each route's most frequent shape, the least shape_id at a tie."""
    n = trips.groupBy("feed", "route_id", "shape_id").agg(F.count("*").alias("n"))
    return n.groupBy("feed", "route_id").agg(F.min_by("shape_id", F.struct(-F.col("n"), "shape_id")).alias("shape_id"))


def rail_summary(freq: DataFrame) -> DataFrame:
    return freq.groupBy("state", "route_type").agg(F.count("*").alias("routes"), F.bround(F.avg("peak"), 4).alias("avg_peak"), F.bround(F.median("peak"), 4).alias("median_peak"))


def timetable(feed: dict[str, DataFrame], exclude: list[str]) -> DataFrame:
    """(feed, route_id, route_name, route_type, shape_id, peak, offpeak) of all feeds at once, keyed by the column feed."""
    from siteline.plans.q_functions import not_like

    routes = feed["routes"].where(F.col("route_type").isin(list(ROUTE_TYPES)) & not_like(F.col("route_short_name"), F.col("route_long_name"), exclude))
    deps = departures(feed["trips"], active_services(feed["calendar"], feed["exceptions"]), routes, feed["stop_times"])
    shapes = most_used_shape(feed["trips"].join(routes.select("feed", "route_id"), ["feed", "route_id"], "left_semi"))
    out = with_frequency(routes, route_frequency(deps)).join(shapes, ["feed", "route_id"], "left")
    return out.select("feed", "route_id", F.col("route_short_name").alias("route_name"), route_type(F.col("route_type"), ROUTE_TYPES).alias("route_type"), "shape_id", "peak", "offpeak")


def feed_of(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Timetable tables of one feed made from events, nations and regions."""
    dep = view(spark, d, "v_departures").withColumn("feed", F.lit("VIC"))
    routes = dep.select("feed", "route_id").distinct().withColumn("n", F.expr("cast(substring(route_id, 2) as int)"))
    raw = F.when(F.col("n") % 4 == 0, "0").when(F.col("n") % 4 == 1, "400").when(F.col("n") % 4 == 2, "102").otherwise("3")
    routes = routes.select("feed", "route_id", F.concat(F.lit("Line "), F.col("n").cast("string")).alias("route_short_name"), F.when(F.col("n") % 5 == 0, "Rail bus").otherwise("Rail").alias("route_long_name"), raw.alias("route_type"))
    days = ["monday", "tuesday", "wednesday", "thursday", "friday"]
    types = dep.select("feed", "service_id").distinct()
    cal = types.select("feed", "service_id", F.to_date(F.lit("2024-01-02")).alias("start"), F.to_date(F.lit("2024-12-31")).alias("end"), *[F.when(F.col("service_id") != "error", 1).otherwise(0).alias(x) for x in days])
    exc = types.where("service_id in ('click', 'error')").select("feed", "service_id", F.to_date(F.lit("2024-01-10")).alias("date"), F.when(F.col("service_id") == "click", 2).otherwise(1).alias("kind"))
    stops = dep.select("trip_id", F.explode(F.array(*[F.struct(F.lit(k).alias("stop_sequence"), F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(f":{10 + k}:00")).alias("departure_time")) for k in (1, 2)])).alias("s")).select("trip_id", "s.*")
    return {"routes": routes, "calendar": cal, "exceptions": exc, "trips": dep.select("feed", "route_id", "trip_id", "service_id", "shape_id"), "stop_times": stops}


ROUTES_SQL = """ro AS (SELECT DISTINCT route_id, n, CASE n % 4 WHEN 0 THEN '0' WHEN 1 THEN '400' WHEN 2 THEN '102' ELSE '3' END AS raw, n % 5 = 0 AS bus FROM (SELECT route_id, cast(substr(route_id, 2) AS INT) AS n FROM v_departures)),
rr AS (SELECT * FROM ro WHERE raw <> '3' AND NOT bus),
dp AS (SELECT v.* FROM v_departures v JOIN rr ON v.route_id = rr.route_id WHERE v.service_id NOT IN ('click'))"""
FREQ_SQL = "fq AS (SELECT route_id, count(*) FILTER (hour IN (7, 8)) / 2.0::double AS peak, count(*) FILTER (hour IN (10, 11, 12, 13, 14)) / 5.0::double AS offpeak FROM dp GROUP BY 1)"
SHAPE_SQL = "sh AS (SELECT route_id, shape_id FROM (SELECT route_id, shape_id, row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, shape_id) AS rn FROM v_departures WHERE route_id IN (SELECT route_id FROM rr) GROUP BY 1, 2) WHERE rn = 1)"
TIMETABLE_SQL = duckdb_ctes("v_departures") + f",\n{ROUTES_SQL},\n{FREQ_SQL},\n{SHAPE_SQL}"


@query("timetable_pipeline", TIMETABLE_SQL + "\nSELECT 'VIC' AS feed, rr.route_id, 'Line ' || n AS route_name, CASE raw WHEN '0' THEN 0 WHEN '400' THEN 1 ELSE 2 END AS route_type, shape_id, coalesce(peak, 0.0::double) AS peak, coalesce(offpeak, 0.0::double) AS offpeak FROM rr LEFT JOIN fq ON rr.route_id = fq.route_id LEFT JOIN sh ON rr.route_id = sh.route_id")
def timetable_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return timetable(feed_of(spark, d), ["bus"])


@query("route_frequency", TIMETABLE_SQL + "\nSELECT * FROM fq")
def q_route_frequency(spark: SparkSession, d: str) -> DataFrame:
    f = feed_of(spark, d)
    r = f["routes"].where("route_type <> '3' and route_long_name = 'Rail'")
    return route_frequency(departures(f["trips"], active_services(f["calendar"], f["exceptions"]), r, f["stop_times"])).select("route_id", "peak", "offpeak")


@query("most_used_shape", TIMETABLE_SQL + "\nSELECT * FROM sh")
def q_most_used_shape(spark: SparkSession, d: str) -> DataFrame:
    f = feed_of(spark, d)
    r = f["routes"].where("route_type <> '3' and route_long_name = 'Rail'")
    return most_used_shape(f["trips"].join(r, "route_id", "left_semi")).select("route_id", "shape_id")


@query("left_join_freq", TIMETABLE_SQL + "\nSELECT ro.route_id, coalesce(peak, 0.0::double) AS peak, coalesce(offpeak, 0.0::double) AS offpeak FROM ro LEFT JOIN fq ON ro.route_id = fq.route_id")
def left_join_freq(spark: SparkSession, d: str) -> DataFrame:
    return with_frequency(feed_of(spark, d)["routes"], q_route_frequency(spark, d).withColumn("feed", F.lit("VIC"))).select("route_id", "peak", "offpeak")


@query("join_first_stop", TIMETABLE_SQL + "\nSELECT route_id, trip_id, shape_id, hour FROM dp")
def join_first_stop(spark: SparkSession, d: str) -> DataFrame:
    f = feed_of(spark, d)
    r = f["routes"].where("route_type <> '3' and route_long_name = 'Rail'")
    return departures(f["trips"], active_services(f["calendar"], f["exceptions"]), r, f["stop_times"]).drop("feed")


@query("semi_join_routes", TIMETABLE_SQL + "\nSELECT trip_id, route_id FROM v_departures WHERE route_id IN (SELECT route_id FROM rr)")
def semi_join_routes(spark: SparkSession, d: str) -> DataFrame:
    f = feed_of(spark, d)
    return f["trips"].join(f["routes"].where("route_type <> '3' and route_long_name = 'Rail'"), ["feed", "route_id"], "left_semi").select("trip_id", "route_id")


@query("anti_join_exceptions", "SELECT DISTINCT event_type AS service_id FROM events WHERE event_type NOT IN (SELECT 'click')")
def anti_join_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Services not taken away on a day; a null in the list would leave none, as NOT IN has it."""
    f = feed_of(spark, d)
    return spark.sql("SELECT DISTINCT service_id FROM {c} WHERE service_id NOT IN (SELECT service_id FROM {e} WHERE kind = 2 AND date = date'2024-01-10')", c=f["calendar"], e=f["exceptions"])


@query("active_services", "SELECT DISTINCT event_type AS service_id FROM events WHERE event_type <> 'click'")
def q_active_services(spark: SparkSession, d: str) -> DataFrame:
    f = feed_of(spark, d)
    return active_services(f["calendar"], f["exceptions"]).select("service_id")


@query("first_wednesday", "SELECT o_orderkey, cast(s + ((2 - (isodow(s) - 1) + 7) % 7)::int + 7 AS DATE) AS day FROM (SELECT o_orderkey, cast(o_orderdate AS DATE) AS s FROM orders)")
def first_wednesday(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", reference_date(F.to_date("o_orderdate")).alias("day"))


@query("departure_hour", "SELECT event_id, cast(split_part(t, ':', 1) AS INT) AS h FROM (SELECT event_id, (event_id % 28) || ':05:00' AS t FROM events)")
def q_departure_hour(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat((F.col("event_id") % 28).cast("string"), F.lit(":05:00"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", departure_hour(t).alias("h"))


@query("route_type_map", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 2 END AS t FROM events")
def route_type_map(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ["900", "401", "106", "0", "715"])), (F.col("event_id") % 5).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", route_type(raw, ROUTE_TYPES).alias("t"))


@query("rail_summary", duckdb_ctes("v_rail_frequency") + "\nSELECT state, route_type, count(*) AS routes, round_even(avg(peak), 4) AS avg_peak, round_even(median(peak), 4) AS median_peak FROM (SELECT peak, CASE WHEN shape_id % 2 = 0 THEN 'VIC' ELSE 'NSW' END AS state, cast(shape_id % 3 AS INT) AS route_type FROM v_rail_frequency) GROUP BY ALL")
def q_rail_summary(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "v_rail_frequency").select("peak", F.when(F.col("shape_id") % 2 == 0, "VIC").otherwise("NSW").alias("state"), (F.col("shape_id") % 3).cast("int").alias("route_type"))
    return rail_summary(f)


@query("route_shape_points", duckdb_ctes("v_rail_shapes", "v_rail_frequency") + "\nSELECT s.shape_id, s.route_type, round_even(s.lat, 6) AS lat, round_even(s.lng, 6) AS lng, s.sequence, s.state FROM v_rail_shapes s JOIN (SELECT DISTINCT shape_id FROM v_rail_frequency WHERE peak > 5) f ON s.shape_id = f.shape_id")
def route_shape_points(spark: SparkSession, d: str) -> DataFrame:
    chosen = view(spark, d, "v_rail_frequency").where("peak > 5").select("shape_id").distinct()
    return view(spark, d, "v_rail_shapes").join(chosen, "shape_id").select("shape_id", "route_type", R4("lat", 6), R4("lng", 6), "sequence", "state")


# -- traffic counts --------------------------------------------------------------------------------------------------


def service_year(period: Column) -> Column:
    """Year of ``YYYY Calendar Year`` or the last year of ``YYYY-1/YYYY Financial Year``; null otherwise."""
    cal = F.regexp_extract(period, r"^(\d+) .*Calendar", 1)
    fin = F.regexp_extract(period, r"^\S*?(\d+) .*Financial", 1)
    return F.coalesce(F.nullif(cal, F.lit("")).try_cast("int"), F.nullif(F.regexp_extract(fin, r"(\d+)$", 1), F.lit("")).try_cast("int"))


def annual_to_daily(total: Column, year: Column, financial: Column) -> Column:
    """Vehicles per day of a year's total; a financial year has 365 days."""
    leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return F.bround(total / F.when(financial, F.lit(365)).otherwise(leap)).cast("int")


def heavy_share(light: Column, heavy: Column) -> Column:
    return F.when(light + heavy > 0, F.bround(heavy / (light + heavy) * 100, 1))


def station_key(state: Column, ctr: Column, station: Column, direction: Column) -> Column:
    return F.when(ctr.isNotNull(), F.concat_ws("_", state, ctr)).otherwise(F.concat_ws("_", state, F.coalesce(station, F.lit("None")), F.coalesce(direction, F.lit("None"))))


def latest_per_station(rows: DataFrame) -> DataFrame:
    """One row per station_key: the latest year of each counter type, then the most detailed type."""
    rank = F.when(F.col("counter_type") == "12-bin", 0).when(F.col("counter_type") == "04-bin", 1).when(F.col("counter_type") == "02-bin", 2).when(F.col("counter_type") == "01-bin", 3).otherwise(9)
    year = F.row_number().over(Window.partitionBy("station_key", "counter_type").orderBy(F.desc_nulls_last("year"), "record_id"))
    kind = F.row_number().over(Window.partitionBy("station_key").orderBy(rank, "counter_type"))
    return rows.withColumn("_y", year).where("_y = 1").withColumn("_k", kind).where("_k = 1").drop("_y", "_k")


def traffic(layers: DataFrame) -> DataFrame:
    """Counting stations from records (record_id, temporal_period, total, light, heavy, state, ctr_id, src_stnid,
    direction, counter_type, lon, lat)."""
    rows = layers.withColumn("year", service_year(F.col("temporal_period"))).withColumn("aadt", annual_to_daily(F.col("total"), F.col("year"), F.col("temporal_period").contains("Financial")))
    rows = rows.withColumn("heavy_vehicle_pct", heavy_share(F.col("light"), F.col("heavy"))).withColumn("station_key", station_key(F.col("state"), F.col("ctr_id"), F.col("src_stnid"), F.col("direction")))
    out = latest_per_station(rows)
    wkt = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    return out.withColumn("geometry_wkt", wkt)


def records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    y = 2012 + k % 9
    period = F.when(k % 5 == 0, F.concat((y - 1).cast("string"), F.lit("-1/"), y.cast("string"), F.lit(" Financial Year"))).when(k % 31 == 1, F.lit("unknown")).otherwise(F.concat(y.cast("string"), F.lit(" Calendar Year")))
    return spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("record_id"), period.alias("temporal_period"), (k * 7919 % 9_000_000).cast("double").alias("total"), F.when(k % 4 != 0, k % 900).cast("double").alias("light"), F.when(k % 6 != 0, k % 70).cast("double").alias("heavy"),
        pick("VIC", "NSW", "SA").alias("state"), F.when(k % 3 != 0, F.concat(F.lit("c"), (k % 400).cast("string"))).alias("ctr_id"), F.concat(F.lit("s"), (k % 77).cast("string")).alias("src_stnid"), F.when(k % 2 == 0, "N").alias("direction"),
        pick("01-bin", "12-bin", "02-bin", "04-bin", "xx").alias("counter_type"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"),
    )


RECORDS_SQL = """rc AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 = 0 THEN (2012 + o_orderkey % 9 - 1) || '-1/' || (2012 + o_orderkey % 9) || ' Financial Year' WHEN o_orderkey % 31 = 1 THEN 'unknown' ELSE (2012 + o_orderkey % 9) || ' Calendar Year' END AS period,
 (o_orderkey * 7919 % 9000000)::double AS total, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 900)::double END AS light, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 70)::double END AS heavy, ['VIC','NSW','SA'][o_orderkey % 3 + 1] AS state,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'c' || (o_orderkey % 400) END AS ctr, 's' || (o_orderkey % 77) AS stn, CASE WHEN o_orderkey % 2 = 0 THEN 'N' END AS dir, ['01-bin','12-bin','02-bin','04-bin','xx'][o_orderkey % 5 + 1] AS ct FROM orders),
r2 AS (SELECT *, CASE WHEN period LIKE '%Calendar%' THEN cast(split_part(period, ' ', 1) AS INT) WHEN period LIKE '%Financial%' THEN cast(split_part(split_part(period, ' ', 1), '/', 2) AS INT) END AS year FROM rc),
r3 AS (SELECT *, cast(round_even(total / CASE WHEN period LIKE '%Financial%' THEN 365 ELSE dayofyear(make_date(year, 12, 31)) END, 0) AS INT) AS aadt, CASE WHEN light + heavy > 0 THEN round_even(heavy / (light + heavy) * 100, 1) END AS hv, CASE WHEN ctr IS NOT NULL THEN state || '_' || ctr ELSE state || '_' || coalesce(stn, 'None') || '_' || coalesce(dir, 'None') END AS key FROM r2),
r4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, ct ORDER BY year DESC NULLS LAST, record_id) AS y1 FROM r3) WHERE y1 = 1),
r5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE ct WHEN '12-bin' THEN 0 WHEN '04-bin' THEN 1 WHEN '02-bin' THEN 2 WHEN '01-bin' THEN 3 ELSE 9 END, ct) AS k1 FROM r4) WHERE k1 = 1)"""


@query("traffic_pipeline", "WITH " + RECORDS_SQL + "\nSELECT record_id, key AS station_key, year, aadt, hv AS heavy_vehicle_pct, ct AS counter_type FROM r5")
def traffic_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return traffic(records(spark, d)).select("record_id", "station_key", "year", "aadt", "heavy_vehicle_pct", "counter_type")


@query("latest_per_station", "WITH " + RECORDS_SQL + "\nSELECT key AS station_key, record_id FROM r5")
def q_latest_per_station(spark: SparkSession, d: str) -> DataFrame:
    return traffic(records(spark, d)).select("station_key", "record_id")


@query("service_year", "WITH " + RECORDS_SQL + "\nSELECT record_id, year FROM r2")
def q_service_year(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", service_year(F.col("temporal_period")).alias("year"))


@query("annual_to_daily", "WITH " + RECORDS_SQL + "\nSELECT record_id, aadt FROM r3")
def q_annual_to_daily(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.select("record_id", annual_to_daily(F.col("total"), service_year(F.col("temporal_period")), F.col("temporal_period").contains("Financial")).alias("aadt"))


@query("hv_pct", "WITH " + RECORDS_SQL + "\nSELECT record_id, hv FROM r3")
def q_hv_pct(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", heavy_share(F.col("light"), F.col("heavy")).alias("hv"))


@query("station_key", "WITH " + RECORDS_SQL + "\nSELECT record_id, key FROM r3")
def q_station_key(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", station_key(F.col("state"), F.col("ctr_id"), F.col("src_stnid"), F.col("direction")).alias("key"))


@query("station_summary", duckdb_ctes("v_stations") + "\nSELECT state, count(aadt) AS n_aadt, count(heavy_vehicle_pct) AS n_hv, min(year) AS first_year, max(year) AS last_year, round_even(avg(aadt), 4) AS mean_aadt FROM v_stations GROUP BY state")
def station_summary(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_stations").groupBy("state").agg(F.count("aadt").alias("n_aadt"), F.count("heavy_vehicle_pct").alias("n_hv"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.bround(F.avg("aadt"), 4).alias("mean_aadt"))


@query("calibrate_aadt", duckdb_ctes("v_properties", "v_roads", "v_aadt") + """,
 ar AS (SELECT a.seg_id, a.aadt, a.x1 AS ax, a.y1 AS ay FROM v_aadt a),
 pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY dm, road_id) AS rn FROM (SELECT a.seg_id, a.aadt, r.road_id, r.class, sqrt((r.x1 - ax) ** 2 + (r.y1 - ay) ** 2) * 111320.0::double * cos(radians(ay)) AS dm FROM ar a JOIN v_roads r ON r.subtype = 'road' AND abs(r.x1 - ax) < 0.002 AND abs(r.y1 - ay) < 0.002) WHERE dm < 80) WHERE rn = 1)
SELECT class, median(aadt)::double AS median_aadt, count(*) AS n FROM pr GROUP BY class""")
def calibrate_aadt(spark: SparkSession, d: str) -> DataFrame:
    """Median measured traffic by class of the nearest road within 80 m of a measured line's start."""
    from siteline.operators import spatial

    lines = view(spark, d, "v_aadt").select(F.col("seg_id").alias("property_id"), F.col("y1").alias("lat"), F.col("x1").alias("lng"), "aadt")
    roads = view(spark, d, "v_roads").where("subtype = 'road'").select("road_id", "class", F.col("x1").alias("r_x"), F.col("y1").alias("r_y"))
    near = spatial.near_points(lines, roads, 80, "r_x", "r_y")
    best = near.groupBy("property_id").agg(F.min_by(F.struct("aadt", "class"), F.struct("dist_m", "road_id")).alias("b"))
    return best.groupBy(F.col("b.class").alias("class")).agg(F.median("b.aadt").alias("median_aadt"), F.count("*").alias("n"))


# -- rain and contours -----------------------------------------------------------------------------------------------


def rain_percentiles(daily: DataFrame, folder: str, years: int = 6, least: int = 30) -> DataFrame:
    """(cell_id, p95_mm, p99_mm, max_mm, rain_days_yr) of wet days; with fewer than ``least`` of them nulls and 0 days.

    Percentiles are the days at those places in their cell's order; no cell is held as a whole.
    """
    wet = ranks.ranked(daily.where("precipitation > 0").select("cell_id", "precipitation"), ["cell_id"], ["precipitation"], folder)
    at = lambda q: F.max(F.when(F.col("rank") == F.floor(F.col("n") * q), F.col("precipitation")))
    found = wet.groupBy("cell_id").agg(at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("precipitation").alias("most"), F.count("*").alias("n"))
    found = found.select(F.col("cell_id").alias("w_id"), "p95", "p99", "most", "n")
    out = daily.select("cell_id").distinct().join(found, F.col("cell_id").eqNullSafe(F.col("w_id")), "left")
    ok = F.coalesce(F.col("n"), F.lit(0)) >= least
    return out.select("cell_id", *[F.when(ok, F.bround(c, 1)).alias(n) for n, c in (("p95_mm", "p95"), ("p99_mm", "p99"), ("max_mm", "most"))], F.when(ok, F.bround(F.col("n") / years)).otherwise(F.lit(0.0)).alias("rain_days_yr"))


#: The derived days are too few for a cell of their own, so each fifteen neighbours are one; cells grow with the table.
RAIN_SQL = duckdb_ctes("v_climate") + """, rw AS (SELECT cell_id // 15 AS cell_id, list_sort(list(precipitation) FILTER (precipitation > 0)) AS s FROM v_climate GROUP BY 1)
SELECT cell_id, CASE WHEN n >= 30 THEN round_even(s[cast(trunc(n * 0.95::double) AS INT) + 1], 1) END AS p95_mm, CASE WHEN n >= 30 THEN round_even(s[cast(trunc(n * 0.99::double) AS INT) + 1], 1) END AS p99_mm, CASE WHEN n >= 30 THEN round_even(s[n], 1) END AS max_mm, CASE WHEN n >= 30 THEN round_even(n / 6, 0) ELSE 0.0::double END AS rain_days_yr FROM (SELECT *, coalesce(len(s), 0) AS n FROM rw)"""


def _rain(spark: SparkSession, d: str) -> DataFrame:
    return rain_percentiles(view(spark, d, "v_climate").withColumn("cell_id", F.expr("cell_id div 15")), shared_folder(spark))


@query("rain_percentiles", RAIN_SQL)
def q_rain_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rain(spark, d)


@query("rain_pipeline", RAIN_SQL.replace("SELECT cell_id, CASE", "SELECT cell_id, -44.0::double + cell_id % 34 AS lat, 112.0::double + cell_id // 34 AS lng, CASE", 1))
def rain_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each cell of the one-degree grid, with its place."""
    cell = F.col("cell_id")
    return _rain(spark, d).withColumn("lat", F.lit(-44.0) + cell % 34).withColumn("lng", F.lit(112.0) + F.floor(cell / 34))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors reach: below ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='siteline-')).rstrip('/')}/siteline-{spark._jvm.java.util.UUID.randomUUID()}"


def staged(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` written now, to a fresh folder or to ``path``, and read from there. The driver holds a query's plan and a
    description of it for every step that ends, so a long query is cut where several steps go on from one table. Joins with
    such a table go by shuffle."""
    path = path or shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).hint("merge")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``staged`` wrote."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def overwrite_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write the partitions that ``rows`` have, in place of those that are there; all others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def scan_timetable_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A timetable file as strings, quotes and blanks trimmed."""
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return raw.select(*[F.btrim(F.col(c), F.lit('" ')).alias(c) for c in columns])


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lng, properties): polygon features by the mean of their outer ring's vertices."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.geometry.type = 'Polygon'")
    ring = F.col("f.geometry.coordinates")[0]
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    return rows.select(mean(1).alias("lat"), mean(0).alias("lng"), F.col("f.properties").alias("properties"))


def scan_contours(spark: SparkSession, path: str) -> DataFrame:
    """(airfield, contour, anef_min, ring) of KML placemarks in folders whose name holds ``Polygon``; rings of fewer than
    three points are left out."""
    schema = "name string, Placemark array<struct<name:string,Polygon:struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>>>"
    folders = spark.read.format("xml").option("rowTag", "Folder").schema(schema).load(path).where(F.col("name").contains("Polygon"))
    marks = folders.select(F.explode("Placemark").alias("p"))
    text = F.trim(F.col("p.Polygon.outerBoundaryIs.LinearRing.coordinates"))
    points = F.transform(F.filter(F.split(text, r"\s+"), lambda s: s.contains(",")), lambda s: F.struct(F.split_part(s, F.lit(","), F.lit(1)).cast("double").alias("x"), F.split_part(s, F.lit(","), F.lit(2)).cast("double").alias("y")))
    airfield = F.regexp_extract("p.name", r"^(.+?) - Contour Range (.+)", 1)
    contour = F.regexp_extract("p.name", r"^(.+?) - Contour Range (.+)", 2)
    n = F.coalesce(F.nullif(F.regexp_extract(contour, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(20))
    return marks.select(F.when(airfield != "", F.trim(airfield)).otherwise(F.col("p.name")).alias("airfield"), F.when(contour != "", F.trim(contour)).otherwise("unknown").alias("contour"), n.alias("anef_min"), points.alias("ring")).where(F.size("ring") >= 3)


def scan_modelled(spark: SparkSession, path: str) -> DataFrame:
    """(building_pid, lat, lng, d, e, n) of modelled facades; empty levels count as 0."""
    names = ["geometry", "building_pid", "sp_rd_max_d", "sp_rd_max_e", "sp_rd_max_n"]
    raw = scan_timetable_csv(spark, path, names)
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    place = lambda k: F.regexp_extract("geometry", r"POINT \((\S+) (\S+)\)", k).try_cast("double")
    return raw.select("building_pid", place(1).alias("lat"), place(2).alias("lng"), num("sp_rd_max_d").alias("d"), num("sp_rd_max_e").alias("e"), num("sp_rd_max_n").alias("n"))


def scan_register(spark: SparkSession, path: str) -> DataFrame:
    """(name, issue, lat, lng) from landed pages of an attribute service."""
    schema = "features array<struct<attributes:map<string,string>,geometry:struct<x:double,y:double>>>"
    f = spark.read.schema(schema).json(path).select(F.explode("features").alias("f"))
    return f.select(F.col("f.attributes")["SiteName"].alias("name"), F.col("f.attributes")["Issue"].alias("issue"), F.col("f.geometry.y").alias("lat"), F.col("f.geometry.x").alias("lng"))


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One data set with a folder for each value; a later write replaces only the folders it has rows for.

    Rows are brought together by value, and values with many rows are spread over tasks by the size of their data.
    """
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


@query("scan_timetable_csv", "SELECT s_suppkey::varchar AS id, trim(s_name) AS name FROM supplier")
def q_scan_timetable_csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit(' "'), "s_name", F.lit('" ')).alias("name")).write.csv(path, header=True)
    return scan_timetable_csv(spark, path, ["id", "name"])


@query("write_by_state", duckdb_ctes("v_stations") + "\nSELECT state, count(*) AS n, cast(sum(aadt) AS BIGINT) AS total FROM v_stations GROUP BY state")
def write_by_state(spark: SparkSession, d: str) -> DataFrame:
    path, s = shared_folder(spark), view(spark, d, "v_stations")
    write_partitioned(s, path, "state")
    write_partitioned(s.where("state = 'WA'"), path, "state")
    return spark.read.parquet(path).groupBy("state").agg(F.count("*").alias("n"), F.sum("aadt").alias("total"))


@query("optional_source", "SELECT s_suppkey FROM supplier")
def optional_source(spark: SparkSession, d: str) -> DataFrame:
    there = optional_table(spark, f"{d}/supplier.parquet", "s_suppkey long")
    return there.unionByName(optional_table(spark, f"{d}/no_such_table.parquet", "s_suppkey long"))


#: Records of a page or file of a source that comes in pages.
PAGE = 50


@query("scan_register_pages", duckdb_ctes("v_epa") + "\nSELECT name, issue, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng FROM v_epa")
def scan_register_pages(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    f = F.struct(F.create_map(F.lit("SiteName"), F.col("name"), F.lit("Issue"), F.col("issue")).alias("attributes"), F.struct(F.col("lng").alias("x"), F.col("lat").alias("y")).alias("geometry"))
    view(spark, d, "v_epa").groupBy(F.floor(F.col("site_id") / PAGE).alias("page")).agg(F.collect_list(f).alias("features")).drop("page").write.json(path)
    return scan_register(spark, path).select("name", "issue", R4("lat", 6), R4("lng", 6))


@query("scan_geojson_areas", duckdb_ctes("v_water") + "\nSELECT round_even((sum(y1) + max(CASE WHEN i = 0 THEN y1 END)) / 9, 5) AS lat, round_even((sum(x1) + max(CASE WHEN i = 0 THEN x1 END)) / 9, 5) AS lng, class FROM v_water GROUP BY water_id, class")
def scan_geojson_areas(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    w = view(spark, d, "v_water").groupBy("water_id", "class").agg(F.sort_array(F.collect_list(F.struct("i", F.array("x1", "y1").alias("p")))).alias("s"))
    ring = F.transform("s", lambda x: x["p"])
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(ring, F.slice(ring, 1, 1))).alias("coordinates")).alias("geometry"), F.create_map(F.lit("class"), F.col("class")).alias("properties"))
    w.groupBy(F.floor(F.col("water_id") / PAGE).alias("file")).agg(F.collect_list(feature).alias("features")).drop("file").write.option("maxRecordsPerFile", 1).json(path)
    return scan_geojson(spark, path).select(R4("lat", 5), R4("lng", 5), F.col("properties")["class"].alias("class"))


def contours_as_kml(spark: SparkSession, d: str) -> str:
    """Derived aircraft contours written as KML folders; returns the path."""
    path = shared_folder(spark)
    o = view(spark, d, "v_overlays").where("theme = 'aircraft'").groupBy("overlay_id", "airfield", "code").agg(F.sort_array(F.collect_list(F.struct("i", F.concat_ws(",", "x1", "y1", F.lit("0")).alias("p")))).alias("s"))
    ring = F.struct(F.struct(F.struct(F.array_join(F.transform("s", lambda x: x["p"]), " ").alias("coordinates")).alias("LinearRing")).alias("outerBoundaryIs"))
    mark = F.struct(F.concat("airfield", F.lit(" - Contour Range "), F.regexp_replace("code", "ANEF ", "")).alias("name"), ring.alias("Polygon"))
    o.groupBy(F.floor(F.col("overlay_id") / PAGE).alias("folder")).agg(F.lit("ANEF Polygons").alias("name"), F.collect_list(mark).alias("Placemark")).drop("folder").write.format("xml").option("rowTag", "Folder").option("rootTag", "kml").save(path)
    return path


CONTOURS_SQL = duckdb_ctes("v_overlays") + "\nSELECT DISTINCT overlay_id, airfield, replace(code, 'ANEF ', '') AS contour, cast(regexp_extract(code, '(\\d+)', 1) AS INT) AS anef_min FROM v_overlays WHERE theme = 'aircraft'"


@query("scan_contour_kml", f"SELECT airfield, contour, anef_min, 8 AS points FROM ({CONTOURS_SQL})")
def scan_contour_kml(spark: SparkSession, d: str) -> DataFrame:
    return scan_contours(spark, contours_as_kml(spark, d)).select("airfield", "contour", "anef_min", F.size("ring").alias("points"))


@query("contour_pipeline", f"SELECT airfield, count(*) AS n, max(anef_min) AS worst FROM ({CONTOURS_SQL}) GROUP BY airfield")
def contour_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Number of contours and the worst level of each airfield."""
    return scan_contours(spark, contours_as_kml(spark, d)).groupBy("airfield").agg(F.count("*").alias("n"), F.max("anef_min").alias("worst"))


@query("scan_modelled_csv", duckdb_ctes("v_measured") + "\nSELECT property_id::varchar AS building_pid, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng, laeq AS d, CASE WHEN property_id % 3 = 0 THEN 0.0::double ELSE laeq - 4 END AS e FROM v_measured")
def scan_modelled_csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    m = view(spark, d, "v_measured")
    m.select(F.concat(F.lit("POINT ("), F.col("lat").cast("string"), F.lit(" "), F.col("lng").cast("string"), F.lit(")")).alias("geometry"), F.col("property_id").cast("string").alias("building_pid"), F.col("laeq").alias("sp_rd_max_d"), F.when(F.col("property_id") % 3 != 0, F.col("laeq") - 4).alias("sp_rd_max_e"), F.lit(None).cast("string").alias("sp_rd_max_n")).write.csv(path, header=True)
    return scan_modelled(spark, path).select("building_pid", R4("lat", 6), R4("lng", 6), "d", "e")


