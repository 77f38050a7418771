"""Spatial column functions on WGS84 coordinates; plain arithmetic that stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_DEG = 111_320.0
#: A window of degrees for a radius in metres: radius / 111 000, half as wide again.
WINDOW_M, WINDOW_FACTOR = 111_000.0, 1.5
SINUSOIDAL_R = 6371007.181

# Bounding boxes (state, min lng, min lat, max lng, max lat), in the order in which they are tried.
STATE_BOXES = [
    ("ACT", 148.7, -35.93, 149.4, -35.1),
    ("TAS", 143.5, -43.7, 148.5, -39.5),
    ("VIC", 140.9, -39.2, 150.0, -33.9),
    ("SA", 129.0, -38.1, 141.0, -26.0),
    ("NSW", 140.9, -37.6, 153.7, -28.1),
    ("QLD", 137.9, -29.2, 153.6, -10.0),
    ("WA", 112.9, -35.2, 129.0, -13.7),
    ("NT", 129.0, -26.0, 138.0, -10.9),
]
#: The set that flood, bushfire and contamination use: other limits, and Victoria before Tasmania.
HAZARD_STATE_BOXES = [
    ("ACT", 148.76, -35.93, 149.40, -35.12),
    ("VIC", 140.96, -39.20, 149.98, -33.98),
    ("TAS", 143.50, -43.65, 148.50, -39.60),
    ("SA", 129.00, -38.10, 141.00, -25.95),
    ("NSW", 140.99, -37.55, 153.64, -28.15),
    ("QLD", 137.95, -29.18, 153.55, -10.05),
    ("WA", 112.92, -35.13, 129.00, -13.69),
    ("NT", 129.00, -26.00, 138.00, -10.97),
]


def window_deg(radius_m: float) -> float:
    """Half the width of the degree window for a radius."""
    return radius_m / WINDOW_M * WINDOW_FACTOR


def lng_scale(lat: Column) -> Column:
    """Metres per degree of longitude."""
    return F.lit(M_PER_DEG) * F.cos(F.radians(lat))


def dist_isotropic(lat: Column, lng: Column, y: Column, x: Column) -> Column:
    """Metres to a point with both axes scaled as longitude: north-south distances come out short, as in planar
    degree distances."""
    return F.sqrt((x - lng) * (x - lng) + (y - lat) * (y - lat)) * lng_scale(lat)


def dist_anisotropic(lat: Column, lng: Column, y: Column, x: Column) -> Column:
    """Metres to a point, each axis by its own scale."""
    dx, dy = (x - lng) * lng_scale(lat), (y - lat) * M_PER_DEG
    return F.sqrt(dx * dx + dy * dy)


def along_segment(lat: Column, lng: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on a segment the nearest point is: 0 at its start, 1 at its end."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lng - x1) * dx + (lat - y1) * dy) / F.when(size == 0, F.lit(1.0)).otherwise(size))))


def crosses_ray(lat: Column, lng: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether an edge crosses the ray from a point to the east; an odd number of edges means inside."""
    return ((y1 > lat) != (y2 > lat)) & (lng < (x2 - x1) * (lat - y1) / F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1) + x1)


def state_of(lat: Column, lng: Column, boxes: list[tuple[str, float, float, float, float]] = STATE_BOXES) -> Column:
    """The first state whose box holds the point; null outside all."""
    out = F.lit(None).cast("string")
    for name, x1, y1, x2, y2 in reversed(boxes):
        out = F.when(lng.between(x1, x2) & lat.between(y1, y2), F.lit(name)).otherwise(out)
    return out


def bearing(lat: Column, lng: Column, y: Column, x: Column) -> Column:
    """Radians clockwise from north, from 0 to 2 pi."""
    turn = F.atan2((x - lng) * F.cos(F.radians((lat + y) / 2)), y - lat)
    return F.when(turn < 0, turn + 2 * math.pi).otherwise(turn)


def sector(turn: Column, sectors: int = 8) -> Column:
    """Number of the sector that a bearing falls into; sector 0 starts at north."""
    return (F.floor(turn / (2 * math.pi / sectors)) % sectors).cast("int")


def coarse_tile(lat: Column, lng: Column) -> Column:
    """Name of the ten-degree tile of southern water rasters; null outside the landed tiles."""
    x, y = (F.floor(lng / 10) * 10).cast("int"), (F.floor(F.abs(lat) / 10) * 10).cast("int")
    name = F.concat(x.cast("string"), F.lit("E_"), y.cast("string"), F.lit("S"))
    return F.when(x.isin(110, 120, 130, 140, 150) & y.isin(10, 20, 30, 40), name)


def fine_tile(lat: Column, lng: Column) -> Column:
    """Name of the one-degree tile of drainage rasters, by its upper left corner."""
    south = F.when(lat < 0, F.lit("S")).otherwise(F.lit("N"))
    y, x = F.ceil(F.abs(lat)).cast("string"), F.floor(lng).cast("string")
    return F.concat(south, F.lpad(y, 2, "0"), F.lit("_00_E"), F.lpad(x, 3, "0"), F.lit("_00"))


def sinusoidal(lat: Column, lng: Column) -> tuple[Column, Column]:
    """(x, y) in metres of the sinusoidal projection."""
    y = F.radians(lat)
    return F.lit(SINUSOIDAL_R) * F.radians(lng) * F.cos(y), F.lit(SINUSOIDAL_R) * y


def ray_project(src_lat: Column, src_lng: Column, lat: Column, lng: Column, b_lat: Column, b_lng: Column) -> tuple[Column, Column, Column]:
    """(path length, metres along, metres off) of a building on the way from a source to a receiver."""
    scale = F.lit(M_PER_DEG) * F.cos(F.radians((src_lat + lat) / 2))
    dx, dy = (lng - src_lng) * scale, (lat - src_lat) * M_PER_DEG
    size = F.sqrt(dx * dx + dy * dy)
    safe = F.when(size == 0, F.lit(1.0)).otherwise(size)
    bx, by = (b_lng - src_lng) * scale, (b_lat - src_lat) * M_PER_DEG
    return size, (bx * dx + by * dy) / safe, F.abs(by * dx - bx * dy) / safe


def vertex_mean(ring: Column) -> tuple[Column, Column]:
    """(x, y): mean of the vertices of an array of (x, y), the closing one counted too."""
    total = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k])
    return total("x") / F.size(ring), total("y") / F.size(ring)


def polygon_centroid(ring: Column) -> tuple[Column, Column]:
    """(x, y): centroid by area of a closed ring of (x, y); coordinates are taken from its first vertex for precision."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct((p["x"] - x0).alias("x1"), (p["y"] - y0).alias("y1"), (q["x"] - x0).alias("x2"), (q["y"] - y0).alias("y2")))
    cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    area = F.aggregate(pairs, F.lit(0.0), lambda t, s: t + cross(s))
    x = F.aggregate(pairs, F.lit(0.0), lambda t, s: t + (s["x1"] + s["x2"]) * cross(s))
    y = F.aggregate(pairs, F.lit(0.0), lambda t, s: t + (s["y1"] + s["y2"]) * cross(s))
    safe = F.when(area == 0, F.lit(1.0)).otherwise(area)
    return x0 + x / (3 * safe), y0 + y / (3 * safe)
