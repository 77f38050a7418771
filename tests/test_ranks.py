"""Places in groups against a plain sort: large and small groups, nulls, ties, empty tables."""

import random

from pyspark.sql import functions as F
from siteline.operators import ranks
from siteline.plans.q_etl import rain_percentiles
from siteline.plans.q_model import systematic_sample


def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("ranks"))


def test_places_in_groups(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random()])) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, city string, level double").repartition(7)
    got = ranks.ranked(df, ["city"], ["level", "id"], folder(tmp_path_factory)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"id", "city", "level", "rank", "n"}
    for city in ("hot", "a", "b", None):
        own = sorted((r for r in rows if r[1] == city), key=lambda r: (r[2] is not None, r[2] or 0.0, r[0]))
        assert {r.id: (r["rank"], r.n) for r in got if r.city == city} == {r[0]: (k, len(own)) for k, r in enumerate(own)}
    assert ranks.ranked(df.limit(0), ["city"], ["level", "id"], folder(tmp_path_factory)).count() == 0


def test_no_window_holds_a_group_of_rows(spark, tmp_path_factory):
    df = spark.range(1000).withColumn("city", F.lit("one"))
    plan = ranks.ranked(df, ["city"], ["id"], folder(tmp_path_factory))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    window = text.index("Window")
    assert "Aggregate" in text[window:]  # windows stand on counts by partition


def test_percentiles_of_wet_days(spark, tmp_path_factory):
    rng = random.Random(5)
    days = [(c, round(rng.choice([0.0, rng.random() * 40]), 3)) for c, n in ((1, 900), (2, 50), (3, 20), (4, 80)) for _ in range(n)] + [(5, 0.0), (6, None)]
    got = {r.cell_id: tuple(r)[1:] for r in rain_percentiles(spark.createDataFrame(days, "cell_id long, precipitation double"), folder(tmp_path_factory)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for c in got:
        wet = sorted(p for k, p in days if k == c and p)
        if len(wet) < 30:
            assert got[c] == (None, None, None, 0.0)
        else:
            want = [wet[int(len(wet) * 0.95)], wet[int(len(wet) * 0.99)], wet[-1]]
            assert all(abs(g - w) <= 0.0501 for g, w in zip(got[c], want)) and got[c][3] == round(len(wet) / 6)


def test_even_sample_of_large_and_small_groups(spark):
    rows = [(i, "big" if i < 700 else "small", float(i * 37 % 701)) for i in range(712)]
    got = systematic_sample(spark.createDataFrame(rows, "id long, city string, level double"), "city", "level", "id", 20).collect()
    big = sorted((r for r in rows if r[1] == "big"), key=lambda r: (r[2], r[0]))
    assert {r.id for r in got if r.city == "big"} == {big[int(j * 700 / 20)][0] for j in range(20)}
    assert sum(r.city == "small" for r in got) == 12
