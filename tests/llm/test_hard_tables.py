"""Operators and stages on hard tables: nulls in any column, repeated rows, clashing column names, empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from siteline.llm import decontam, langid, mixing, secrets, simhash, suffixdedup, tokens, topk, toxicity, url_filters

SF = "/root/testdata/sf0.001"
#: Names that operators use themselves.
NAMES = ["row", "at", "same", "node", "spans", "items", "size", "target", "taken", "copies", "token", "key", "component", "less", "carry", "score", "k", "h_id", "f_id", "k_id", "p_at", "order", "part", "left"]


@pytest.fixture(scope="module")
def hard(spark, docs):
    """Rows with a null doc_id, lang, source or text, with a repeated doc_id, and in three copies; clashing columns."""
    base = docs.drop("size", "token").where("doc_id < 60 or doc_id > 100000")
    odd = base.limit(6)
    rows = base.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.withColumn("doc_id", F.lit(7).cast("long")))
    rows = rows.unionByName(odd.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")))
    rows = rows.unionByName(rows).unionByName(rows)
    return rows.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES))).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


STAGES = {
    "language": lambda df, bench: langid.keep_identified(df),
    "near_copies": lambda df, bench: simhash.keep_one(df),
    "decontamination": lambda df, bench: decontam.decontaminate(df, bench),
    "decontamination in blocks": lambda df, bench: decontam.decontaminate(df, bench, max_words=500),
    "secrets": lambda df, bench: secrets.redact(df),
    "mixing": lambda df, bench: mixing.sampled(df),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stage(stage, hard, bench):
    out = STAGES[stage](hard, bench)
    names = [c for c in hard.columns if stage != "mixing" or c not in ("taken", "copies")]
    assert out.columns == names + ["taken", "copies"] * (stage == "mixing")
    got, rows = out.collect(), hard.collect()
    assert {r.row for r in got} == {0} and {r.left for r in got} == {len(NAMES) - 1}
    empty = STAGES[stage](hard.limit(0), bench)
    assert empty.columns == out.columns and empty.count() == 0
    if stage == "near_copies":
        assert len(got) == len({(r.doc_id, r.text) for r in got})
    elif stage == "language":
        judged = Counter(map(key, rows))
        kept = Counter(map(key, got))
        assert kept and all(n == judged[k] for k, n in kept.items())
        assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in got)
    elif stage == "mixing":
        want = Counter((r.doc_id, r.source, r.taken) for r in mixing.mix(hard).where("taken > 0").collect())
        assert Counter((r.doc_id, r.source, r.taken) for r in got) == want
    else:
        ids = Counter(r.doc_id for r in rows)
        assert all(n <= ids[i] for i, n in Counter(r.doc_id for r in got).items())
        assert len(got) == len(rows) if stage == "secrets" else len(got) > 0.8 * len(rows)
    if stage.startswith("decontamination"):
        assert decontam.removal_spans(out, bench).where(F.size("spans") > 0).count() == 0
        whole = STAGES["decontamination"](hard, bench).collect()
        assert sorted(map(key, got)) == sorted(map(key, whole))


OPERATORS = {
    "secrets": lambda df: secrets.digest(secrets.scan(df)),
    "simhash": simhash.near_duplicates,
    "decontamination": lambda df: decontam.digest(decontam.removal_spans(df, df.sparkSession.read.parquet(f"{SF}/benchmark.parquet"))),
    "repeats": lambda df: suffixdedup.digest(suffixdedup.repeats(df)),
    "mixing": mixing.mix,
    "toxicity": lambda df: toxicity.predicted(toxicity.score(df, toxicity.learn(df, df.sparkSession.read.parquet(f"{SF}/labels.parquet")))),
    "language": langid.identify,
    "tokens": tokens.token_counts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, hard):
    """One row for each row, repeated and null doc_ids among them; none for an empty table."""
    got = OPERATORS[name](hard)
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r.doc_id for r in hard.select("doc_id").collect())
    none = OPERATORS[name](hard.limit(0))
    assert none.columns == got.columns and none.count() == 0


def test_keep_identified_without_labels(spark, docs):
    rows = docs.drop("size", "token")
    letters = rows.where(F.col("text").rlike(r"\p{L}")).count()
    assert langid.keep_identified(rows.drop("lang")).count() == letters
    assert langid.keep_identified(rows.withColumn("lang", F.lit(None).cast("string"))).count() == letters


def test_empty_partners(spark, docs, bench):
    assert decontam.removal_spans(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).count() == docs.count()
    vectors = spark.createDataFrame([(100, None)], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.entries_from_pages(pages).count() == 0
