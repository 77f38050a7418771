"""Joins with tables that grow with the properties go by shuffle, however small Spark takes these tables for."""

import pytest
from siteline.queries import QUERIES

SF = "/root/testdata/sf0.1"  # plans only, nothing runs
#: Queries and how many tables of bounded size they may broadcast: the states' layers.
BY_SHUFFLE = dict.fromkeys(["elevation_profile", "horizon_angles", "burn_seasons", "join_raster_samples", "lst_delta", "ring_medians", "slope_multiplier", "join_nearest_grid_flood", "join_nearest_grid_noise", "join_within_roads", "score_solar", "water_cells", "rail_features", "energy_sum", "join_nearest_rain"], 0) | {"grid_flood": 1}


@pytest.mark.parametrize("name", BY_SHUFFLE)
def test_no_growing_table_is_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
    # rail shapes, at most twenty, have their timetable broadcast
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[shape_id" not in line]
    assert len(joins) <= BY_SHUFFLE[name], joins


def test_walkability_broadcasts_nothing(spark):
    plan = QUERIES["score_walkability"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
