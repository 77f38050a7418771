"""Searches among vectors send nothing of the index through the driver."""

import numpy as np
import pytest
from siteline.llm import topk, vantage


@pytest.mark.parametrize("search", [topk.top_k, vantage.nearest])
def test_searches_broadcast_nothing(spark, monkeypatch, search):
    """Spark takes vectors for far fewer bytes than they are where the file is small, as with many copies, and sent the whole
    index through the driver: at 615,360 vectors in 11 MB both searches failed."""
    monkeypatch.setattr(topk, "BLOCK", 100)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(500)], "vec_id long, embedding array<double>")
    more = {"shard": 100} if search is vantage.nearest else {}
    plan = search(df, **more)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 1  # the first pass is written
