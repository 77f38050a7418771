"""Mixing sources to target weights by capped water-filling.

A source's target is its weight times a common level, but no more than ``max_epochs`` times its size; the level is raised
until the targets add up to the mix. Documents are repeated whole ``floor(target / size)`` times; for the rest, documents
of the source are taken in a seeded order until the target is reached, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteline.llm.common import cut, keyed_rows, partitions, word_count

#: A source's documents are dealt to this many parts of the seeded order, so that no task holds a whole source.
PARTS_HEX = 3


def weights_by_order(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, weight): weights repeat along the sources by code point, null last.

    Sources are sorted by ranges, so that no task holds them all; a range's places start after those before it.
    """
    n = partitions(sources)
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order)).cast("long")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # at most n rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("range", before.alias("before")))
    place = (inside + F.col("before") - 1) % len(cycle)
    rows = ranged.join(starts, "range").withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place + 1).cast("int")).cast("long"))
    return rows.drop("range", "before")


def fill(sources: DataFrame, share: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``, capped water-filling of share[0]/share[1] of all sizes.

    Sources at their cap are clamped and the excess is shared by weight among the others, until no target is above its
    cap. Only the sums of each round reach the driver. A mix of more than all caps ends with every source at its cap; a
    weight of null, zero or less makes a target of zero.
    """
    num, den = share
    rows = cut(sources.withColumn("weight", F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0)).cast("long")))
    cap = F.col("source_size") * max_epochs
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    a, b = 0, 1  # the level as a fraction
    clamped = F.lit(False)
    while True:
        free, caps = rows.agg(F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0))).first()
        if free == 0:
            break
        a, b = max(0, num * total - den * caps), den * free
        over = clamped | (F.col("weight").cast("decimal(38,0)") * a >= cap.cast("decimal(38,0)") * b) & (F.col("weight") > 0)
        more = rows.agg(F.sum(F.when(over & ~clamped, 1))).first()[0]
        clamped = over
        if not more:
            break
    level = F.col("weight") * F.lit(float(a)) / F.lit(float(b))
    return rows.withColumn("target", F.when(clamped, cap.cast("double")).when(F.col("source_size") > 0, level).otherwise(F.lit(0.0)))


def seeded(doc_id: Column, seed: str) -> Column:
    """A document's place in the seeded order: hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, share: tuple[int, int] = (3, 2), max_epochs: int = 2, cycle: tuple[int, ...] = (3, 1, 2), seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, and the columns ``source`` and ``carry``) of each row.

    Size is the number of words, null and empty texts having none; taken is the number of words that the mix takes of
    the document, repeats counted. The words taken of a source are its target, rounded down; no document exceeds
    ``max_epochs`` times its size. Reruns agree: the order depends on seed, doc_id and size alone. A null source is a
    source of its own. Rows that repeat a doc_id are documents of their own; equal ones among them are in any order.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), *carry)
    rows = cut(rows.withColumn("order", seeded(F.col("doc_id"), seed)).withColumn("part", F.substring("order", 1, PARTS_HEX)))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = fill(weights_by_order(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), cycle), share, max_epochs)
    whole = F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    sources = sources.withColumn("whole", F.coalesce(F.least(whole, F.lit(max_epochs)), F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = parts.withColumn("before", before).alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    plan = plan.select(F.col("p.source").alias("p_source"), F.col("part").alias("p_part"), "source_size", "target", "whole", (F.col("rest") - F.col("before")).alias("left"), "part_size")
    at = (F.col("part") == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source"))
    dealt = rows.join(plan, at).select("doc_id", "source", "size", "source_size", "target", "whole", "left", "part_size", "order", "part", *carry)
    edge = (F.col("left") > 0) & (F.col("left") < F.col("part_size"))
    inside = Window.partitionBy("source", "part").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    cutting = dealt.where(edge).withColumn("more", F.greatest(F.least(F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0)), F.col("size")), F.lit(0)))
    clear = dealt.where(~edge).withColumn("more", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0)))
    return clear.unionByName(cutting).select("doc_id", "source", *carry, "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``taken`` and ``copies`` (whole repetitions), which take the place of columns of these names;
    documents of which nothing is taken go.

    ``taken`` beyond ``copies`` times the document's words is a last, partial repetition of its first words. Rows that
    repeat doc_id, source and text are documents of their own; which of them is the one taken in part is left open.
    """
    rows = keyed_rows(docs).withColumn("source", F.col("row.source").cast("string"))
    key = ["doc_id", "source", "at"]
    plan = mix(rows.select(*key, F.col("row.text").alias("text")), carry=("at",), **options).select(*key, "taken", F.expr("taken div nullif(size, 0)").alias("copies"))
    plan = cut(plan)
    again = cut(plan.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    right = plan.where("taken > 0").select(*(F.col(c).alias(f"p_{c}") for c in key), "taken", "copies")
    on = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in key]
    if again.isEmpty():
        out = rows.join(right, on)
    else:  # repeated rows are numbered on both sides, so that each meets one row of the plan
        twice = again.select(*(F.col(c).alias(f"t_{c}") for c in key))
        is_twice = lambda t, prefix: [F.col(f"{prefix}{c}").eqNullSafe(F.col(f"t_{c}")) for c in key]
        number = lambda prefix: F.row_number().over(Window.partitionBy(*(f"{prefix}{c}" for c in key)).orderBy(F.lit(0)))
        one = rows.join(twice, is_twice(rows, ""), "left_anti").join(right, on)
        many = rows.join(twice, is_twice(rows, ""), "left_semi").withColumn("k", number(""))
        theirs = plan.select(*(F.col(c).alias(f"p_{c}") for c in key), "taken", "copies").join(twice, is_twice(plan, "p_"), "left_semi").withColumn("p_k", number("p_")).where("taken > 0")
        out = one.unionByName(many.join(theirs, [*on, F.col("k") == F.col("p_k")]).drop("k", "p_k"))
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("taken", "copies")), "taken", "copies")
