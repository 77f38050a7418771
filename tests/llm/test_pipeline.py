"""The whole pipeline on the smallest documents: each stage on its own input, against what its decisions should be."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from siteline.llm import decontam, mixing, secrets

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages_and_run(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontamination", "secrets", "mixing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        kept[name] = after
        assert set(after) <= set(before) and (name == "mixing" or docs.columns == columns), name
        if name in ("language", "near_copies"):
            assert all(after[i] == before[i] for i in after)
        if name == "language":
            assert all(re.search(r"[^\W\d_]", r.text or "") for r in after.values()) and len(before) - len(after) < 0.02 * len(before)
        elif name == "near_copies":
            sets = {i: shingles(r.text) for i, r in before.items()}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])  # noqa: B023, E731
            for i in set(before) - set(after):  # one of the group stays
                group, open_ = {i}, [i]
                while open_:
                    a = open_.pop()
                    more = {b for b in before if b not in group and near(a, b)}
                    group |= more
                    open_ += more
                assert len(group) > 1 and group & set(after) == {min(group)}
            ids = sorted(after)
            assert not any(near(a, b) for a in ids for b in ids if a < b)
        elif name == "decontamination":
            assert decontam.removal_spans(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("spans") > 0).count() == 0
        elif name == "secrets":
            again = secrets.scan(docs).where(F.size("base") > 0).count()
            assert again == 0 and all(after[i].text == before[i].text or "[secret]" in after[i].text for i in after)
        else:
            plan = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(list(before.values()), columns and docs.select(columns).schema)).collect()}
            assert {i: r.taken for i, r in after.items()} == {i: n for i, n in plan.items() if n}
            assert all(r.copies == r.taken // len(words(r.text)) for r in after.values())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == kept["mixing"]
