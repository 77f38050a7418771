"""Ladders: scores, factors and labels that go by thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (least score, label), from the top; the last label takes the rest.
LABELS: dict[str, list[tuple[int | None, str]]] = {
    "noise": [(80, "Very Quiet"), (60, "Quiet"), (40, "Moderate"), (20, "Loud"), (None, "Very Loud")],
    "walkability": [(90, "Walker's Paradise"), (70, "Very Walkable"), (50, "Somewhat Walkable"), (25, "Car-Dependent"), (None, "Almost All Errands Require a Car")],
    "solar": [(80, "Excellent Solar Potential"), (60, "Good Solar Potential"), (40, "Moderate Solar Potential"), (20, "Low Solar Potential"), (None, "Poor Solar Potential")],
    "flood": [(90, "Very Low Risk"), (70, "Low Risk"), (40, "Moderate Risk"), (20, "High Risk"), (None, "Very High Risk")],
    "bushfire": [(80, "Very Low Risk"), (60, "Low Risk"), (40, "Moderate Risk"), (20, "High Risk"), (None, "Very High Risk")],
    "heat": [(80, "Very Cool"), (60, "Cool"), (40, "Moderate Heat"), (20, "Hot"), (None, "Extreme Heat")],
    "view": [(85, "Exceptional Views"), (70, "Great Views"), (55, "Good Views"), (40, "Average Views"), (25, "Limited Views"), (None, "Obstructed Views")],
    "contamination": [(90, "Very Clean"), (70, "Clean"), (50, "Low Risk"), (30, "Moderate Risk"), (15, "High Risk"), (None, "Very High Risk")],
}
FLOOD_SEVERITY = {"floodway": (10, 20), "flood": (20, 40), "moderate": (40, 60)}
FIRE_SEVERITY = {"extreme": (5, 15), "high": (15, 30), "moderate": (30, 50), "low": (50, 65)}
#: Land cover class: fuel, label.
FUEL = {10: (0.95, "Tree cover"), 20: (0.80, "Shrubland"), 30: (0.60, "Grassland"), 40: (0.30, "Cropland"), 50: (0.10, "Built-up"), 60: (0.25, "Bare/sparse"), 70: (0.00, "Snow/ice"), 80: (0.00, "Water"), 90: (0.40, "Wetland"), 95: (0.50, "Mangroves"), 100: (0.15, "Moss/lichen")}


def steps(x: Column, below: list[tuple[float, object]], rest: object) -> Column:
    """The value of the first bound that x is below, else rest; null stays null."""
    out = F.lit(rest)
    for bound, value in reversed(below):
        out = F.when(x < bound, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def at_least(x: Column, bounds: list[tuple[float | None, object]]) -> Column:
    """The value of the first bound that x reaches; a bound of None takes the rest."""
    out = F.lit(None)
    for bound, value in reversed(bounds):
        out = F.lit(value) if bound is None else F.when(x >= bound, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def label(kind: str, score: Column) -> Column:
    return at_least(score, LABELS[kind])


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """x rounded half to even, within limits, as an integer."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(x))).cast("int")


def ranked(key: Column, order: list[str]) -> Column:
    """Place of a key in a list; null if it isn't there."""
    out = F.lit(None).cast("int")
    for i, k in enumerate(order):
        out = F.when(key == k, F.lit(i)).otherwise(out)
    return out


def bound(key: Column, table: dict[str, tuple[int, int]], i: int) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v[i])).otherwise(out)
    return out


def flood_overlay(severity: Column, hits: Column, layers: Column, unreachable: Column) -> Column:
    """Score of flood overlays: within the severity's limits, three less for each further zone up to three; 90 without a
    hit, 80 if a layer was out of reach, null where the state has no layers."""
    lo, hi = bound(severity, FLOOD_SEVERITY, 0), bound(severity, FLOOD_SEVERITY, 1)
    return F.when(severity.isNotNull(), F.greatest(lo, hi - F.least(hits - 1, F.lit(3)) * 3)).when(layers == 0, F.lit(None)).when(unreachable > 0, F.lit(80)).otherwise(F.lit(90)).cast("int")


def fire_overlay(severity: Column, layers: Column) -> Column:
    """Score of bushfire overlays: middle of the severity's limits, 90 without a hit, null without layers."""
    middle = F.bround((bound(severity, FIRE_SEVERITY, 0) + bound(severity, FIRE_SEVERITY, 1)) / 2).cast("int")
    return F.when(severity.isNotNull(), middle).when(layers > 0, F.lit(90))


def water_component(wet: Column, flood: Column, nearest: Column) -> Column:
    """Score of water cells around a point: few or none, a river's edge, or a flood plain."""
    ratio = flood / F.greatest(wet, F.lit(1))
    near = lambda m: F.coalesce(nearest < m, F.lit(False))
    return (
        F.when(wet == 0, 95)
        .when((flood == 0) & near(200), 70)
        .when(flood == 0, 85)
        .when((flood >= 10) & near(200), 15)
        .when(flood >= 10, 30)
        .when((flood >= 5) & (ratio > 0.5) & near(250), 25)
        .when((flood >= 5) & (ratio > 0.5), 40)
        .when(flood >= 5, 55)
        .when((ratio > 0.7) & near(200), 55)
        .otherwise(75)
    )


def drainage_component(hand: Column) -> Column:
    return steps(hand, [(1, 15), (3, 30), (5, 50), (10, 70), (20, 85)], 95)


def drainage_rain_modifier(score: Column, hand: Column, p95: Column, evidence: Column) -> Column:
    """A flood score after height above drainage and extreme rain, 0 to 100."""
    low = F.least(score, F.lit(55)) - F.greatest(F.lit(0), ((2 - hand) * 10).cast("int"))
    out = (
        F.when(hand.isNull(), score)
        .when((hand < 2) & evidence, low)
        .when(hand < 2, F.least(score, F.lit(70)))
        .when((hand < 5) & evidence, F.least(score, F.lit(65)))
        .when(hand < 5, F.least(score, F.lit(80)))
        .when(hand > 20, F.greatest(score, F.least(score + 10, F.lit(95))))
        .otherwise(score)
    )
    out = F.when(evidence & F.coalesce(p95 > 25, F.lit(False)), F.greatest(F.lit(0), out - 5)).otherwise(out)
    return F.greatest(F.lit(0), F.least(F.lit(100), out)).cast("int")


def fuel_of(cover: Column) -> tuple[Column, Column]:
    """(fuel, label) of a land cover class."""
    fuel, name = F.lit(0.3), F.lit("Unknown")
    for k, (f, n) in FUEL.items():
        fuel, name = F.when(cover == k, F.lit(f)).otherwise(fuel), F.when(cover == k, F.lit(n)).otherwise(name)
    return fuel, name


def satellite_component(fuel: Column, slope: Column, seasons: Column) -> Column:
    """Bushfire score of fuel, mean slope in degrees and seasons with fire; null without fuel and slope."""
    factor = at_least(F.coalesce(slope, F.lit(5.0)), [(25, 1.0), (15, 0.7), (8, 0.4), (3, 0.2), (None, 0.1)])
    score = clamp((1 - (F.coalesce(fuel, F.lit(0.3)) * 0.7 + factor * 0.3)) * 100)
    fire = F.coalesce(seasons, F.lit(0))
    capped = F.when(fire >= 3, F.least(score, F.lit(15))).when(fire >= 2, F.least(score, F.lit(25))).when(fire >= 1, F.least(score, F.greatest(score - 15, F.lit(20)))).otherwise(score)
    return F.when(fuel.isNotNull() | slope.isNotNull(), capped)


def register_component(nearest: Column, n: Column) -> Column:
    """Score of registered sites by the rounded distance of the nearest and their number."""
    return (
        F.when(n == 0, 95).when(nearest < 100, 10).when(nearest < 250, 25).when((nearest < 500) & (n > 2), 30).when(nearest < 500, 45)
        .when((nearest < 1000) & (n > 3), 50).when(nearest < 1000, 65).when(nearest < 2000, 80).otherwise(90)
    )


def industrial_component(nearest: Column, n: Column) -> Column:
    """Score of industrial places within 500 m."""
    near = F.coalesce(nearest < 100, F.lit(False))
    return F.when(n == 0, 95).when(near & (n > 3), 30).when(near, 45).when(n > 5, 40).when(n > 3, 55).when(n > 1, 70).otherwise(80)


def walk_decay(dist: Column, n: Column, reach: float = 1500.0) -> Column:
    """Worth of the nearest place of a kind by its distance, less if there are only one or two."""
    d = F.when(dist < reach, 1 - dist / reach).otherwise(F.lit(0.0))
    return d * F.when(n <= 1, F.lit(0.7)).when(n <= 2, F.lit(0.85)).otherwise(F.lit(1.0))


def slope_multiplier(mean_rise: Column) -> Column:
    """Walking worth by the mean rise over 500 m; null counts as flat."""
    return F.coalesce(steps(mean_rise / 500 * 100, [(3, 1.0), (6, 0.9), (10, 0.75)], 0.6), F.lit(1.0))


def heat_components(lst: Column, delta: Column, night: Column, mean: Column, p90: Column) -> tuple[Column, Column]:
    """(score, penalty) of surface temperatures where measured, else of summer air temperatures."""
    part = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(100.0), (42.0 - t) / 20.0 * 100))
    measured = F.coalesce(lst > 0, F.lit(False))
    score = F.when(measured, part(lst)).when(mean.isNotNull(), part(mean * 0.4 + p90 * 0.6))
    hot_night = F.when(night > 18, F.least((night - 18) * 1.5, F.lit(10.0))).otherwise(F.lit(0.0))
    return score, F.when(measured, F.greatest(F.lit(0.0), delta) * 3 + hot_night).when(mean.isNotNull(), F.lit(0.0))


def ocean_factor(d: Column) -> Column:
    far = F.greatest(F.lit(0.0), 0.15 * (1 - (d - 5000) / 5000))
    return F.when(d < 5000, steps(d, [(200, 1.0), (500, 0.90), (1000, 0.75), (2000, 0.55)], 0.30)).when(d.isNotNull(), far)


def inland_factor(d: Column) -> Column:
    return steps(d, [(100, 1.0), (300, 0.80), (500, 0.60), (1000, 0.35), (2000, 0.15)], 0.0)


def elevation_factor(advantage: Column, elevation: Column) -> Column:
    decay = F.when(advantage >= 0, at_least(advantage, [(50, 1.0), (30, 0.85), (15, 0.65), (5, 0.45), (None, 0.25)])).when(advantage.isNotNull(), F.greatest(F.lit(0.0), 0.15 + advantage / 80))
    bonus = F.when(elevation > 50, F.least(elevation / 600.0, F.lit(0.15))).otherwise(F.lit(0.0))
    return F.when(decay.isNotNull(), F.least(F.lit(1.0), decay + bonus))


def green_factor(nearest: Column, n: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1.0 - nearest / 1000)
    return F.when(n > 0, F.bround(near * 0.6 + F.least(n / 15.0, F.lit(1.0)) * 0.4, 3)).otherwise(F.lit(0.0))


def openness_factor(n: Column, tall: Column) -> Column:
    base = F.when(n == 0, 1.0).when(n <= 10, 0.95).when(n <= 40, 0.80).when(n <= 100, 0.65).when(n <= 200, 0.45).when(n <= 350, 0.25).otherwise(0.10)
    less = F.when(tall > 5, F.least((tall - 5) * 0.04, F.lit(0.30))).otherwise(F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), base - less), 3)


def horizon_factor(open_dirs: Column, downhill: Column) -> Column:
    """From 0 to 1; null without heights (``least`` alone would pass over the null)."""
    return F.when(open_dirs.isNotNull(), F.bround(F.least(F.lit(1.0), open_dirs / 8 + F.least(downhill * 0.05, F.lit(0.15))), 3))


def anef_penalty(anef: Column) -> Column:
    """dB for a noise contour."""
    return F.coalesce(at_least(anef, [(40, 15.0), (35, 12.0), (30, 10.0), (25, 7.0), (20, 5.0), (15, 3.0), (None, 0.0)]), F.lit(0.0))


def anef_impact(anef: Column) -> Column:
    texts = [(30, "Severe aircraft noise. Only commercial/industrial recommended."), (25, "Significant aircraft noise. Residential not recommended."), (20, "Moderate aircraft noise. Acoustic treatment required for dwellings."), (15, "Noticeable aircraft noise."), (None, "Minimal aircraft noise impact.")]
    return F.coalesce(at_least(anef, texts), F.lit("No aircraft noise overlay applies to this location."))


def confidence(lden: Column, measured: Column) -> tuple[Column, Column, Column]:
    """(plus or minus, low, high) dB around a level; wider without measured traffic."""
    ci = steps(lden, [(50, 8.0), (60, 5.0)], 4.0) + F.when(measured > 0, F.lit(0.0)).otherwise(F.lit(3.0))
    return ci, F.greatest(lden - ci, F.lit(35.0)), lden + ci
