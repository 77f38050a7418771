"""A query's plan stays short: the driver holds it, and a description of it, for every step that ends."""

import pytest
from pyspark.sql import functions as F
from siteline.plans import q_noise
from siteline.queries import QUERIES
from siteline.sources.views import view

SF = "/root/testdata/sf0.001"
#: Queries and the most characters of a plan. Before noise tables and scores were written on the way, ``score_noise`` had 2.7 million.
MOST = {"energy_sum": 50_000, "score_noise": 500_000, "noise_features": 400_000, "compose_scores": 50_000}


@pytest.mark.parametrize("name", MOST)
def test_plan_is_short(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < MOST[name]


def test_noise_parts_are_written_when_asked_for_and_given_up(spark, tmp_path):
    parts = q_noise.parts_of(spark, SF)
    assert not parts
    assert parts["levels"].count() == parts["sources"].count() > 0
    assert set(parts) == {"aadt", "stations", "roads", "rail", "tracks", "sources", "levels"}
    levels = parts["levels"]
    q_noise.release(parts)
    assert not parts
    with pytest.raises(Exception, match="(?i)exist"):
        levels.count()


@pytest.mark.parametrize("name", ["v_raster", "v_grid", "v_lattice"])
def test_cells_of_boxes_are_made_in_many_tasks(spark, name):
    made = view(spark, SF, name).select(F.spark_partition_id().alias("p")).distinct().count()
    assert made == 4  # the session's partitions; one before, as a few boxes went to one task


@pytest.mark.parametrize("name", ["join_within_roads", "sector_stats"])
def test_distances_to_segments_are_worked_out_after_the_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_cy#" in line and "xmin#" in line]
    assert joins and not any("SQRT" in line.upper() or "LOG10" in line.upper() for line in joins), joins
