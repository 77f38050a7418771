"""Queries that left out a part of their job."""

from siteline.plans.q_serve import SCORES
from siteline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_eight_scores_are_side_by_side(spark):
    found = QUERIES["compose_scores"](spark, SF)
    assert found.columns == ["property_id", *SCORES] and len(SCORES) == 8
    assert all(f"{c}.score AS {c}" in ORACLES["compose_scores"] for c in SCORES)


def test_cities_are_measured_all_around_and_at_the_loudest_facade(spark):
    rows = {r.city: r for r in QUERIES["benchmark_cities"](spark, SF).collect()}
    facades = {r.city: r for r in QUERIES["benchmark_facades"](spark, SF).collect()}
    assert set(rows) == set(facades) and None in rows
    for city, r in rows.items():
        f = facades[city]
        assert (r.n, r.facade_bias, r.facade_mae, r.facade_w5) == (f.n, f.bias, f.mae, f.w5)
    assert any(r.bias != r.facade_bias for r in rows.values())
