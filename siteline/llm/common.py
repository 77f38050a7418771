"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as the contracts name it: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    The folder is the session's ``spark.checkpoint.dir``, which all executors share; see ``shared_folder``.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path is None and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or tempfile.mkdtemp(prefix="spark-checkpoint-")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_blocks(xs: Column, zero: Column, add: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """An array's elements in blocks of about the root of their number: structs of ``xs``, and of ``before`` and ``after``, the
    running state (``add`` an element to it, ``join`` two of it) at either end.

    What grows an array by an element at a time copies it each time; within a block these copies are short.
    """
    def states(blocks: Column) -> Column:
        return F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, add)), F.array(zero), lambda acc, s: F.concat(acc, F.array(join(F.element_at(acc, -1), s))))

    def ends(blocks: Column, at: Column) -> Column:
        return F.transform(blocks, lambda b, i: F.struct(b.alias("xs"), at[i].alias("before"), at[i + 1].alias("after")))

    def cut_up(v: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), size), lambda i: F.slice(v, i, size))

    size = lambda v: F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))
    return _let(xs, lambda v: _let(size(v), lambda k: _let(cut_up(v, k), lambda blocks: _let(states(blocks), lambda at: ends(blocks, at)))))


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, as expressions in lambdas are for each element."""
    return F.transform(F.array(x), use)[0]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _toward_least(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step over (u, v), u > v: ties each node's larger (upward) or smaller neighbours to its least neighbour."""
    if upward:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        out = out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as edges (u long, v long).

    Returns (node, component), component being the smallest node reachable, for every node of an edge between two
    different nodes. Alternating star steps (large and small) shrink each component to a star in a logarithmic number
    of rounds; each round is a few joins and is checkpointed, and nothing but two counters reaches the driver.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    said = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == said:
            break
        said = found
        edges = cut(_toward_least(_toward_least(edges, True), False))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, at): the row as a struct, so that no column of the caller's clashes, and its key.

    at is a hash of the text, which tells rows of one doc_id apart.
    """
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("at"))


def with_text(rows: DataFrame, text: Column, docs: DataFrame) -> DataFrame:
    """The rows (struct ``row``) of ``docs`` with another text where ``text`` isn't null; n_chars, if there, is counted anew
    for these."""

    def value(c: str) -> Column:
        new = {"text": text, "n_chars": F.length(text)}.get(c)
        old = F.col(f"row.`{c}`")
        return old if new is None else F.coalesce(new.cast(docs.schema[c].dataType), old).alias(c)

    return rows.select(*(value(c) for c in docs.columns))


def distinct_rows(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The callers' rows of ``keyed_rows``, one of each of the keys in ``repeated`` (doc_id, at), which are few as a rule."""
    again = repeated.select(F.col("doc_id").alias("r_id"), F.col("at").alias("r_at"))
    on = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("at") == F.col("r_at"))
    once = rows.join(again, on, "left_anti").select("row")
    if repeated.isEmpty():
        return rows.select("row.*")
    return once.unionByName(rows.join(again, on, "left_semi").dropDuplicates(["doc_id", "at"]).select("row")).select("row.*")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(table, starts, ends) of whole groups of rows equal in ``keys``, from batches of a partition sorted by these.

    The last group of a batch waits for the rest of its rows.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        names = [b.schema.get_field_index(k) for k in keys]
        cols = [b.column(i).to_numpy() for i in names]
        new = np.zeros(b.num_rows, dtype=bool)
        for c, before in zip(cols, last or [None] * len(keys), strict=True):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= before is None or c[0] != before
        last = [c[-1] for c in cols]
        cut_at = np.flatnonzero(new)
        if len(cut_at) and (cut_at[-1] or held):
            k = int(cut_at[-1])
            ready = [*held, b.slice(0, k)] if k else held
            yield _bounds(ready, keys)
            held = [b.slice(k)]
        else:
            held.append(b)
    if held:
        yield _bounds(held, keys)


def _bounds(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    new = np.zeros(len(t), dtype=bool)
    new[0] = True
    for k in keys:
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return t, starts, np.append(starts[1:], len(t))


def search_blocks(vectors: DataFrame, asked: DataFrame, blocks: int, build: Callable[[np.ndarray, np.ndarray], object], search: Callable, schema: str) -> DataFrame:
    """Blocks of vectors searched by the queries sent to them. vectors: (block, vec_id, v); asked: (block, vec_id, v, bound).

    Each block's vectors (of one number of dimensions) come before its queries in one sorted partition, a row each: ``build`` (ids, matrix)
    makes the index where it is used, and ``search`` (index, ids, matrix, bounds) answers some queries with arrays of the
    schema's columns. So no row, batch or broadcast grows with the tables, and an index isn't copied for each query.
    """
    kind = asked.schema["bound"].dataType
    rows = [vectors.select("block", F.size("v").alias("dim"), F.lit(0).alias("asks"), "vec_id", "v", F.lit(None).cast(kind).alias("bound")), asked.select("block", F.size("v").alias("dim"), F.lit(1).alias("asks"), "vec_id", "v", "bound")]
    dealt = union_all(rows).repartition(max(partitions(vectors), blocks), "block", "dim").sortWithinPartitions("block", "dim", "asks", "vec_id")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).to_numpy() for i in range(3)]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for start, end in zip([0, *new], [*new, b.num_rows], strict=True):
                part, (block, dim, asks) = b.slice(start, end - start), (int(k[start]) for k in keys)
                if here != (block, dim):
                    here, held, index = (block, dim), [], None
                # copies: slices would keep the whole batch
                ids, m = part.column(3).to_numpy().copy(), part.column(4).flatten().to_numpy().reshape(-1, dim).copy()
                if not asks:
                    held.append((ids, m))
                elif held:
                    if index is None:
                        index = build(*map(np.concatenate, zip(*held, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in search(index, ids, m, part.column(5).to_pylist())], names=names)

    return dealt.mapInArrow(run, schema)
