"""URL filters against dated lists, by temporal joins.

A list is a log of dated entries (add or remove a key). Entries become validity intervals, and an as-of join evaluates
each capture against the entries that were active when it was fetched. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key that holds more than one row in HOT of all is dealt out over SALTS partitions.
HOT, SALTS = 200, 64


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def keys_of(url: Column) -> Column:
    """Keys that a list can name a URL by: ``d:`` its host and parent domains, ``p:`` host and first path segment,
    ``u:`` host and path. Empty for a URL without host."""
    host = host_of(url)
    label = F.split(host, r"\.")
    n = F.size(label)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(label, i, n), ".")))
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*(/[^?#]*)?", 1)
    first = F.regexp_extract(path, r"^/([^/]+)", 1)
    more = F.array(F.when(first != "", F.concat(F.lit("p:"), host, F.lit("/"), first)), F.concat(F.lit("u:"), host, path))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.concat(domains, more)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, verdict, key, since, until) from a log (list_name, verdict, key, action, at).

    An ``add`` is valid from its time, included, to the next entry for the same list and key, excluded; without one,
    until is null. Where both actions come at one time, ``remove`` counts. Entries with a null key, time or action are
    void; repeated ones count once.
    """
    log = entries.where("key is not null and at is not null and action in ('add', 'remove')")
    log = log.groupBy("list_name", "key", "at").agg(F.max("action").alias("action"), F.min_by("verdict", F.struct("action", "verdict")).alias("verdict"))
    nxt = F.lead("at").over(Window.partitionBy("list_name", "key").orderBy("at"))
    return log.withColumn("until", nxt).where("action = 'add'").select("list_name", "verdict", "key", F.col("at").alias("since"), "until")


def as_of(keyed: DataFrame, valid: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched_at, key, salt) with each interval (key, list_name, salt, since, until, verdict) that holds
    their time; of one list and key at most one does.

    Both go in order of time, and the last interval that began is carried forward: work is near that of sorting them,
    however long a key's history is. A capture takes part once for each list that names its key.
    """
    named = valid.select("key", "list_name", "salt").distinct()
    asked = keyed.join(named, ["key", "salt"]).select("key", "list_name", "salt", F.col("fetched_at").alias("at"), F.struct("page_id", "url").alias("capture"))
    began = valid.select("key", "list_name", "salt", F.col("since").alias("at"), F.struct("since", "until", "verdict").alias("entry"))
    # an entry counts from its time on, so it goes before captures of that time
    order = Window.partitionBy("key", "salt", "list_name").orderBy(F.col("at"), F.col("capture").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = asked.unionByName(began, allowMissingColumns=True).withColumn("held", F.last("entry", ignorenulls=True).over(order))
    holds = F.col("capture").isNotNull() & F.col("held").isNotNull() & (F.col("held.until").isNull() | (F.col("at") < F.col("held.until")))
    return merged.where(holds).select("capture.page_id", "capture.url", F.col("at").alias("fetched_at"), "key", "list_name", "held.since", "held.verdict")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched_at): host, n_active, verdict, list_name, key, since.

    The most specific active entry decides, that is the one with the longest key; among equals ``block`` beats
    ``allow``, then the later list name. Without an active entry, with a null time or without a host the verdict is
    ``none``. Captures that repeat each get a row. Without captures there are no rows; without entries all are ``none``.
    """
    rows = captures.select("page_id", "url", "fetched_at")
    keyed = rows.where("fetched_at is not null").select("page_id", "url", "fetched_at", F.explode(keys_of(F.col("url"))).alias("key"))
    valid = intervals(entries)
    total = rows.count()
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * HOT > F.lit(total)).select("key", F.lit(True).alias("hot"))  # fewer than HOT x keys of a URL
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(SALTS))).otherwise(F.lit(0))
    keyed = keyed.join(F.broadcast(hot), "key", "left").select("page_id", "url", "fetched_at", "key", share.cast("int").alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    valid = valid.join(F.broadcast(hot), "key", "left").select("key", "list_name", F.explode(salts).alias("salt"), "since", "until", "verdict")
    merged = as_of(keyed, valid)
    match = F.struct(F.length("key").alias("size"), (F.col("verdict") == "block").alias("block"), "list_name", "key", "since", "verdict").alias("match")
    found = merged.select("page_id", "url", "fetched_at", match)
    every = rows.withColumn("base", F.lit(1)).unionByName(found, allowMissingColumns=True)
    out = every.groupBy("page_id", "url", "fetched_at").agg(F.max("match").alias("best"), F.count("match").alias("active"), F.count("base").alias("copies"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "page_id",
        "url",
        "fetched_at",
        host_of(F.col("url")).alias("host"),
        F.expr("active div copies").alias("n_active"),
        F.coalesce("best.verdict", F.lit("none")).alias("verdict"),
        F.col("best.list_name").alias("list_name"),
        F.col("best.key").alias("key"),
        F.col("best.since").alias("since"),
    )


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """A dated list log made from the hosts and paths of ``pages``, for a data set that comes without lists.

    Hosts are blocked from a day drawn from the key's MD5, released after 60 days, half of them blocked again after 120;
    first path segments are allowed, and some pages blocked one by one.
    """
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    key = F.explode(keys_of(F.col("url")))
    keys = pages.select("page_id", key.alias("key")).groupBy("key").agg(F.min("page_id").alias("first_page"))
    keys = keys.withColumn("m", F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")).withColumn("kind", F.substring("key", 1, 1))
    entry = lambda name, verdict, action, at: F.struct(F.lit(name).alias("list_name"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), at.alias("at"))
    m = F.col("m")
    hosts = F.array(entry("hosts", "block", "add", day(m % 200)), entry("hosts", "block", "remove", day(m % 200 + 60)), F.when(m % 2 == 0, entry("hosts", "block", "add", day(m % 200 + 120))))
    log = F.when((F.col("kind") == "d") & (m % 3 != 2), hosts).when((F.col("kind") == "p") & (m % 5 == 0), F.array(entry("sections", "allow", "add", day(m % 150)))).when((F.col("kind") == "u") & (F.col("first_page") % 97 == 0), F.array(entry("pages", "block", "add", day(m % 300))))
    return keys.select("key", F.inline(F.array_compact(log)))
