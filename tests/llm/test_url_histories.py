"""URL filters as a merge by time: against a plain reading of the log, and on one key with a long history."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F
from siteline.llm import url_filters


def frame(spark, rows, names, kinds):
    """Rows of which the columns ``names``, in epoch seconds, become times."""
    df = spark.createDataFrame(rows, kinds)
    return df.select(*(F.timestamp_seconds(c).alias(c) if c in names else F.col(c) for c in df.columns))


def plain(captures, log):
    out = []
    for page, url, at in captures:
        host = url.split("://")[1].split("/")[0] if url and "://" in url else None
        found = []
        if host and at is not None:
            parts, path = host.split("."), "/" + "/".join(url.split("://")[1].split("/")[1:]) if "/" in url.split("://")[1] else ""
            keys = ["d:" + ".".join(parts[i:]) for i in range(max(len(parts) - 1, 1))] + [f"u:{host}{path}"] + ([f"p:{host}/{path.split('/')[1]}"] if len(path) > 1 else [])
            for name in {e[0] for e in log}:
                for key in keys:
                    past = [e for e in log if e[0] == name and e[2] == key and e[4] is not None and e[4] <= at and e[3] in ("add", "remove")]
                    if past:
                        last = max(e[4] for e in past)
                        now = [e for e in past if e[4] == last]
                        if all(e[3] == "add" for e in now):
                            found.append((len(key), min(e[1] for e in now) == "block", name, key, last, min(e[1] for e in now)))
        best = max(found, default=None)
        out.append((page, at, host, len(found), best[5] if best else "none", best[2] if best else None, best[3] if best else None, best[4] if best else None))
    return Counter(out)


def test_verdicts_are_those_of_the_log(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.com", "other.org", "x.y.other.org"]
    keys = ["d:example.com", "d:a.example.com", "d:other.org", "p:other.org/news", "u:b.example.com/news/1", None]
    log = [(rng.choice(["l1", "l2", "l3"]), rng.choice(["block", "allow"]), rng.choice(keys), rng.choice(["add", "add", "remove", "bad"]), rng.choice([None, *range(0, 40)]), "clash") for _ in range(160)]
    log += log[:20]
    captures = [(i, f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/news', '/news/1'])}", rng.choice([None, *range(0, 45)])) for i in range(300)]
    captures += [(7, "https://a.example.com/news", 20)] * 5 + [(None, "no url", 3), (None, None, 4), (None, None, None)]
    c = frame(spark, [(*r, "clash") for r in captures], {"fetched_at"}, "page_id long, url string, fetched_at long, key string")
    e = frame(spark, log, {"at"}, "list_name string, verdict string, key string, action string, at long, url string")
    out = url_filters.evaluate(c, e)
    got = Counter((r.page_id, r.f, r.host, r.n_active, r.verdict, r.list_name, r.key, r.s) for r in out.select("*", F.unix_timestamp("fetched_at").alias("f"), F.unix_timestamp("since").alias("s")).collect())
    assert got == plain(captures, [r for r in log if r[2] is not None]) and sum(v for k, v in got.items() if k[3] > 1) > 20


def test_a_long_history_meets_many_captures(spark):
    """A key added and removed 50,000 times each, and 100,000 captures of it: seconds, not 10^10 candidates."""
    log = spark.range(100_000).select(F.lit("l").alias("list_name"), F.lit("block").alias("verdict"), F.lit("d:hot.com").alias("key"), F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("action"), F.timestamp_seconds(F.col("id") * 10).alias("at"))
    captures = spark.range(100_000).select(F.col("id").alias("page_id"), F.lit("https://hot.com/x").alias("url"), F.timestamp_seconds(F.col("id") * 7919 % 1_000_000).alias("fetched_at"))
    began = time.time()
    out = url_filters.evaluate(captures, log).select("page_id", F.unix_timestamp("fetched_at").alias("f"), "n_active", F.unix_timestamp("since").alias("s"))
    wrong = out.where((F.col("n_active") != F.when(F.col("f") % 20 < 10, 1).otherwise(0)) | (F.col("s") != F.col("f") - F.col("f") % 20))
    assert out.count() == 100_000 and wrong.count() == 0
    assert time.time() - began < 60
