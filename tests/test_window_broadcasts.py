"""Tables of windows grow with the raster, so none goes through the driver, whatever Spark guesses of its size."""

from siteline.queries import QUERIES


def test_windows_broadcast_nothing(spark):
    plan = QUERIES["raster_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
