"""Noise levels in dB as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the level formulas.
GROUND_DB, MIN_DISTANCE_M, AMBIENT_DB = 3.0, 10.0, 35.0
ROAD_EXCESS, RAIL_EXCESS, CONTINUOUS_FLOW = 0.06, 0.04, 15_000
WINDOW_DB, MAX_ROADS, MAX_RAILS, DEFAULT_SPEED = 6, 8, 4, 60
L10_TO_LEQ = 3.0
WAVELENGTH, BARRIER_CAP, BARRIERS_CAP, TERRAIN_CAP = 0.34, 20.0, 25.0, 15.0
DAY_ADJ, EVE_ADJ, NIGHT_ADJ = (10 * math.log10(share * 24 / hours) for share, hours in ((0.80, 12), (0.12, 4), (0.08, 8)))
# Daily vehicles by speed limit, by road class, and by both.
SPEED_TO_AADT = {110: 70_000, 100: 53_000, 90: 35_000, 80: 16_000, 70: 12_000, 60: 8_000, 50: 6_000, 40: 7_000, 30: 4_000, 20: 2_000, 10: 500, 5: 100}
CLASS_TO_AADT = {"motorway": 50_000, "trunk": 19_000, "primary": 11_000, "secondary": 6_000, "tertiary": 3_000, "residential": 400, "unclassified": 300, "living_street": 100, "service": 150}
CLASS_SPEED_AADT = {
    "motorway": {100: 70_000, 80: 50_000, 60: 30_000},
    "trunk": {80: 30_000, 70: 20_000, 60: 15_000},
    "primary": {70: 18_000, 60: 13_000, 50: 9_000},
    "secondary": {70: 14_000, 60: 10_000, 50: 7_000},
    "tertiary": {60: 5_000, 50: 3_500, 40: 2_500},
    "residential": {50: 800, 40: 500, 30: 300},
}
# (peak level, its distance, seconds of a passing), and levels for rails without timetable.
RAIL_EMISSION = {"train": (90.0, 25.0, 15.0), "vline": (92.0, 25.0, 30.0), "tram": (80.0, 7.5, 10.0)}
RAIL_FALLBACK = {"standard_gauge": (72.0, 25.0), "narrow_gauge": (68.0, 25.0), "tram": (65.0, 7.5)}


def lg10(x: Column) -> Column:
    """Ten times the decimal logarithm; null where x isn't positive."""
    return 10 * F.log10(F.when(x > 0, x))


def energy(level: Column) -> Column:
    """10^(level / 10), and 0 for levels of 0 and less."""
    return F.when(level > 0, F.pow(F.lit(10.0), level / 10)).otherwise(F.lit(0.0))


def level_of(total: Column) -> Column:
    """The level of a sum of energies; 0 if there is none."""
    return F.coalesce(lg10(total), F.lit(0.0))


def energy_sum(*levels: Column) -> Column:
    """Levels added by energy."""
    total = energy(levels[0])
    for x in levels[1:]:
        total = total + energy(x)
    return level_of(total)


def lookup(key: Column, table: dict, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def aadt_of_class(road_class: Column) -> Column:
    """Daily vehicles that a road class stands for."""
    return lookup(road_class, CLASS_TO_AADT, 400)


def estimate_aadt(road_class: Column, speed: Column) -> Column:
    """Daily vehicles by class and speed limit in steps of ten, else by the nearest speed limit, else by class."""
    bucket = (F.bround(speed / 10) * 10).cast("int")
    joint = F.lit(None).cast("int")
    for c, by in CLASS_SPEED_AADT.items():
        joint = F.when(road_class == c, lookup(bucket, by)).otherwise(joint)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.lit(float(k)) - speed).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, (k, v) in enumerate(SPEED_TO_AADT.items())]))["v"]
    return F.when(speed > 0, F.coalesce(joint, nearest)).otherwise(aadt_of_class(road_class))


def crtn_level(aadt: Column, dist: Column, hv_pct: Column | float = 0.0, speed: Column | float = 0.0) -> Column:
    """Road level from daily vehicles and distance, with the share of heavy vehicles where a speed is known."""
    hv, v = (x if isinstance(x, Column) else F.lit(float(x)) for x in (hv_pct, speed))
    heavy = F.when((hv > 0) & (v > 0), lg10(1 + 5 * hv / F.when(v > 0, v))).otherwise(F.lit(0.0))
    d = F.greatest(dist, F.lit(MIN_DISTANCE_M))
    level = 42.2 + lg10(aadt) + heavy - lg10(d / 13.5) - GROUND_DB - F.greatest(d - 50, F.lit(0.0)) * ROAD_EXCESS + lg10(F.least(F.lit(1.0), aadt / CONTINUOUS_FLOW))
    return F.when(aadt > 0, F.greatest(level, F.lit(0.0))).otherwise(F.lit(0.0))


def rail_level(kind: Column, dist: Column, per_hour: Column) -> Column:
    """Rail level from the services per hour; 0 for other kinds or no service."""
    peak, ref, secs = (lookup(kind, {k: v[i] for k, v in RAIL_EMISSION.items()}) for i in range(3))
    d = F.greatest(dist, F.lit(MIN_DISTANCE_M))
    level = peak + lg10(secs) + lg10(per_hour / 3600) - lg10(d / ref) - GROUND_DB - F.greatest(d - 50, F.lit(0.0)) * RAIL_EXCESS
    return F.when((per_hour > 0) & peak.isNotNull(), F.greatest(level, F.lit(0.0))).otherwise(F.lit(0.0))


def rail_level_fallback(rail_class: Column, dist: Column) -> Column:
    """Rail level by class alone."""
    level, ref = (lookup(rail_class, {k: v[i] for k, v in RAIL_FALLBACK.items()}) for i in range(2))
    d = F.greatest(dist, F.lit(MIN_DISTANCE_M))
    out = level - lg10(d / ref) - GROUND_DB - F.greatest(d - 50, F.lit(0.0)) * RAIL_EXCESS
    return F.coalesce(F.greatest(F.when(level.isNotNull(), out), F.when(level.isNotNull(), F.lit(0.0))), F.lit(0.0))


def lden(day: Column, eve: Column, night: Column) -> Column:
    """Day-evening-night level."""
    p = lambda x: F.pow(F.lit(10.0), x / 10)
    return 10 * F.log10((12 * p(day) + 4 * p(eve + 5) + 8 * p(night + 10)) / 24)


def period_levels(road: Column, rail: Column, aircraft: Column) -> dict[str, Column]:
    """Leq of day, evening, night and 24 h; no rail at night, and no period below the ambient level."""
    road_leq = F.when(road > 0, road - L10_TO_LEQ).otherwise(F.lit(0.0))
    shifted = lambda adj: F.when(road_leq > 0, road_leq + adj).otherwise(F.lit(0.0))
    eve_rail = F.when(rail > 0, F.greatest(rail - 5, F.lit(0.0))).otherwise(F.lit(0.0))
    floor = lambda *x: F.greatest(energy_sum(*x), F.lit(AMBIENT_DB))
    return {"leq_day": floor(shifted(DAY_ADJ), rail, aircraft), "leq_eve": floor(shifted(EVE_ADJ), eve_rail, aircraft), "leq_night": floor(shifted(NIGHT_ADJ), aircraft), "leq_24h": floor(road_leq, rail, aircraft)}


def maekawa(detour: Column, cap: float) -> Column:
    """Loss behind a barrier for a detour in metres; null for no detour."""
    n = 2 * detour / WAVELENGTH
    return F.when(detour > 0, F.least(10 * F.log10(3 + 20 * n * n), F.lit(cap)))


def barrier_loss(along: Column, off: Column, path: Column, dist: Column, height: Column, src_height: float = 0.5, ear: float = 1.5) -> Column:
    """Loss by one building between source and receiver; null if it is none."""
    over = lambda d, h: F.sqrt(d * d + h * h)
    detour = over(along, height - src_height) + over(dist - along, height - ear) - dist
    between = (dist >= 20) & (path >= 1) & (along >= 5) & (along <= dist - 5) & (off <= 30)
    return F.when(between, maekawa(detour, BARRIER_CAP))


def modelled_lden(d: Column, e: Column, n: Column) -> Column:
    """Lden of published levels; a missing evening or night is 5 or 10 dB under the day, a missing day makes 0."""
    some = lambda x, y: F.when(F.coalesce(x, F.lit(0.0)) > 0, x).otherwise(y)
    return F.when(d > 0, lden(d, some(e, d - 5), some(n, d - 10))).otherwise(F.lit(0.0))
