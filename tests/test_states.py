"""Hazard scores of properties in other states and outside all."""

import os

import pytest
from siteline.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["score_flood", "score_bushfire", "score_contamination"])
def test_all_states_are_scored(spark, tmp_path, name):
    for t in os.listdir(SF):
        if t != "customer.parquet":
            os.symlink(f"{SF}/{t}", tmp_path / t)
    first = spark.read.parquet(f"{SF}/customer.parquet").limit(1)
    keys = {1: "VIC", 400_000: "NSW", 1_000_000: "QLD", 3_000_000: None}
    first.drop("c_custkey").crossJoin(spark.createDataFrame([(k,) for k in keys], "c_custkey long")).select(first.columns).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.property_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert {k: r.state for k, r in got.items()} == keys
    for k, state in keys.items():
        assert (got[k].score is None) == (state is None)
        assert (got[k].label == "Outside Australia") == (state is None)
    spark.catalog.clearCache()
