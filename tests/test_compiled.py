"""Code for pairs and sources is short enough to be compiled: the JVM leaves methods of over 8,000 bytes to its interpreter."""

import re

import pytest
from siteline.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def planned_at_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["road_energy_features", "sector_stats", "facade_sectors"])
def test_methods_are_compiled(spark, planned_at_once, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["road_energy_features", "join_corridor_buildings"])
def test_lines_meet_buildings_by_their_cells_alone(spark, name):
    """With the way between the two in the join's condition, the join took 673 of 800 CPU seconds at 6 x sf0.1."""
    from siteline.plans import q_model, q_noise
    from siteline.sources.views import view

    props, buildings = view(spark, SF, "v_properties"), view(spark, SF, "v_buildings")
    sources = q_model.road_levels(q_noise.parts_of(spark, SF)["roads"]) if name == "road_energy_features" else q_noise.parts_of(spark, SF)["sources"]
    plan = q_noise.corridor(sources, props, buildings, 500)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_fy#" in line and "_py#" in line]
    assert joins and not any("*" in line or "SQRT" in line.upper() for line in joins), joins
