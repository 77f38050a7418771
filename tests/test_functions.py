"""Formulas at known values and at the edges of their ladders."""

import math

import pytest
from pyspark.sql import functions as F
from siteline.functions import acoustics as ac
from siteline.functions import geo, ladders, places
from siteline.plans.q_etl import annual_to_daily, reference_date, service_year


@pytest.fixture(scope="module")
def one(spark):
    def value(*cols):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return value


lit = F.lit


def test_road_level_falls_with_distance_and_rises_with_traffic(one):
    near, far, busy, none = one(ac.crtn_level(lit(10000), lit(20.0)), ac.crtn_level(lit(10000), lit(200.0)), ac.crtn_level(lit(50000), lit(20.0)), ac.crtn_level(lit(0), lit(20.0)))
    assert near > far and busy > near and none == 0
    assert 60 < near < 85


def test_heavy_vehicles_add_noise(one):
    a, b = one(ac.crtn_level(lit(8000), lit(30.0), 10.0, 60.0), ac.crtn_level(lit(8000), lit(30.0)))
    assert a - b == pytest.approx(10 * math.log10(1 + 50 / 60))


def test_three_equal_levels_add_five_db(one):
    assert one(ac.energy_sum(lit(60.0), lit(60.0), lit(60.0))) == pytest.approx(60 + 10 * math.log10(3))
    assert one(ac.energy_sum(lit(0.0), lit(-3.0))) == 0


def test_lden_of_a_flat_day_is_above_it(one):
    assert one(ac.lden(lit(50.0), lit(50.0), lit(50.0))) == pytest.approx(56.4, abs=0.1)


def test_estimated_traffic(one):
    assert one(ac.estimate_aadt(lit("residential"), lit(60.0))) == 8000
    assert one(ac.estimate_aadt(lit("tertiary"), lit(None).cast("double"))) == 3000
    assert one(ac.estimate_aadt(lit("primary"), lit(60.0))) == 13000
    assert one(ac.estimate_aadt(lit("canal"), lit(0.0))) == 400


def test_period_floor_keeps_the_score_under_96(one):
    p = ac.period_levels(lit(0.0), lit(0.0), lit(0.0))
    assert one(*p.values()) == (35.0, 35.0, 35.0, 35.0)
    assert one(ladders.clamp((75 - ac.lden(lit(35.0), lit(35.0), lit(35.0))) / 35 * 100)) == 96


def test_rail_kinds(one):
    assert one(ac.rail_level(lit("train"), lit(30.0), lit(0.0))) == 0
    assert one(ac.rail_level(lit("ferry"), lit(30.0), lit(5.0))) == 0
    assert one(ac.rail_level(lit("vline"), lit(30.0), lit(5.0))) > one(ac.rail_level(lit("train"), lit(30.0), lit(5.0)))
    assert one(ac.rail_level_fallback(lit("monorail"), lit(30.0))) == 0


@pytest.mark.parametrize("kind", sorted(ladders.LABELS))
def test_labels_change_at_their_bounds(one, kind):
    bounds = [(b, t) for b, t in ladders.LABELS[kind] if b is not None]
    for i, (b, text) in enumerate(bounds):
        below = ladders.LABELS[kind][i + 1][1]
        assert one(ladders.label(kind, lit(b)), ladders.label(kind, lit(b - 1))) == (text, below)
    assert one(ladders.label(kind, lit(None).cast("int"))) is None


def test_ladders_at_their_edges(one):
    e = 1e-9
    for f, b, low, high in ((ladders.inland_factor, 100, 1.0, 0.8), (ladders.ocean_factor, 200, 1.0, 0.9), (ladders.drainage_component, 3, 30, 50), (ladders.slope_multiplier, 15, 1.0, 0.9)):
        assert one(f(lit(b - e)), f(lit(float(b)))) == (low, high)
    assert one(ladders.elevation_factor(lit(-12.0), lit(20.0))) == 0
    assert one(ladders.fire_overlay(lit("high"), lit(1)), ladders.fire_overlay(lit("low"), lit(1))) == (22, 58)  # halves to even
    assert one(ladders.flood_overlay(lit("flood"), lit(9), lit(4), lit(0))) == 31


def test_missing_values_have_defined_results(one):
    null = lit(None).cast("double")
    assert one(ladders.ocean_factor(null)) is None
    assert one(ladders.anef_penalty(null)) == 0.0
    assert one(places.match_group(lit(None).cast("string"))) is None
    assert one(places.is_industrial(lit(None).cast("string"))) is False
    assert one(places.is_motor(lit(None).cast("string"))) is True
    assert one(ac.maekawa(lit(-1.0), 20.0)) is None


def test_first_keyword_wins(one):
    assert one(places.match_group(lit("Seafood Restaurant"))) == "restaurant"
    assert one(places.match_group(lit("food store"))) == "grocery"
    assert one(places.is_industrial(lit("commercial_industrial_chemical"))) is False


def test_states_overlap_in_order(one):
    at = lambda lat, lng: geo.state_of(lit(lat), lit(lng))
    assert one(at(-35.3, 149.1), at(-37.8, 145.0), at(-35.0, 147.0), at(-33.8, 151.2), at(0.0, 0.0)) == ("ACT", "VIC", "VIC", "NSW", None)


def test_isotropic_distance_is_short_north_south(one):
    iso, aniso = one(geo.dist_isotropic(lit(-37.8), lit(145.0), lit(-37.81), lit(145.0)), geo.dist_anisotropic(lit(-37.8), lit(145.0), lit(-37.81), lit(145.0)))
    assert aniso == pytest.approx(1113.2) and iso == pytest.approx(1113.2 * math.cos(math.radians(37.8)), rel=1e-6)


def test_dates(one):
    assert str(one(reference_date(F.to_date(lit("2024-01-03"))))) == "2024-01-10"
    assert str(one(reference_date(F.to_date(lit("2024-01-04"))))) == "2024-01-17"
    assert one(service_year(lit("2023-1/2024 Financial Year")), service_year(lit("2019 Calendar Year")), service_year(lit("nothing"))) == (2024, 2019, None)
    assert one(annual_to_daily(lit(366.0), lit(2020), lit(False)), annual_to_daily(lit(365.0), lit(2020), lit(True))) == (1, 1)
