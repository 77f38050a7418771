"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks; each block keeps, for each dimension, its vectors' numbers sorted by that component.
For a query the lists are read from the end that its component's sign favours, deeper where the product at the current
depth is larger; every vector met is scored. These products add up to a bound on what is not yet met, and reading stops
as soon as the bound is below the k-th best score. Queries meet one block of vectors each first, some hundreds the same one; the
k-th best score there is taken along to the other blocks, and the best of all are merged per query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteline.llm.common import cut, search_blocks

BLOCK, QUERIES, START = 4096, 256, 16
_LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component as doubles that hold integers.

    Null vectors, empty ones and those with null or non-finite components are left out, and rows without vec_id.
    """
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    # beyond 2^53 every double is an integer; the largest are held to the range of double
    whole = lambda y: F.when(F.abs(y) < float(1 << 62), F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(1.7e308)), F.lit(-1.7e308)))
    v = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    return rows.select(F.col("vec_id").cast("long"), v.alias("v"))


def sorted_lists(m: np.ndarray) -> np.ndarray:
    """For each dimension the numbers of the rows, in descending order of that component."""
    return np.argsort(-m, axis=0, kind="stable").T.astype(np.int32)


def _scores(m: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products, kept within the range of long; ``exact``: doubles can hold them."""
    if exact:
        return (m @ q).astype(np.int64)
    w = [int(x) for x in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, w, strict=True)), _LONG[0]), _LONG[1]) for row in m], dtype=np.int64)


def threshold_top_k(ids: np.ndarray, m: np.ndarray, lists: np.ndarray, query: int, q: np.ndarray, k: int, floor: int = _LONG[0]) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, rows scored) of the query's k best of a block, the query's own row left out; ties go to the smaller id.

    ids ascend; lists[d] holds the rows in descending order of component d. Rows that score less than ``floor`` need not
    be found. Once half of the block is met the rest is scored at once.
    """
    n, used = len(ids), np.flatnonzero(q)
    exact = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 1 << 53
    met, down = ids == query, q[used] > 0
    best, score, scored = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    done, depth = np.zeros(len(used), dtype=np.int64), np.full(len(used), min(START, n))
    while True:
        now = np.zeros(n, dtype=bool)
        for i, d in enumerate(used):
            now[lists[d, done[i] : depth[i]] if down[i] else lists[d, n - depth[i] : n - done[i]]] = True
        if not len(used) or 2 * (met | now).sum() >= n:
            now[:] = True
        new = np.flatnonzero(now & ~met)
        met |= now
        scored += len(new)
        best, score = np.concatenate((best, new)), np.concatenate((score, _scores(m[new], q, exact)))
        order = np.lexsort((best, ~score))[:k]  # ~ keeps within the range where - would not
        best, score = best[order], score[order]
        if met.all():
            break
        rows = np.where(down, lists[used, np.minimum(depth, n - 1)], lists[used, np.maximum(n - depth - 1, 0)])
        edge = [int(a) * int(b) for a, b in zip(m[rows, used], q[used], strict=True)]
        if sum(edge) < max(floor, int(score[-1]) if len(best) == k else floor):
            break
        done = depth
        depth = np.where(np.array(edge, dtype=float) >= sum(edge) / len(edge), np.minimum(depth * 2, n), depth)
    return ids[best], score, scored


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all vectors for each query, a row whose vec_id ``every`` divides.

    Score: inner product of the scaled integers, held to the range of long. A query meets the vectors of its own number
    of dimensions, but not those with its own vec_id; rows that repeat another vec_id are candidates each.
    """
    rows = cut(scaled(vectors))
    n = rows.count()
    blocks, q_blocks = 1 + n // BLOCK, 1 + n // (every * QUERIES)
    deal = lambda b: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(b)).cast("long")
    index = rows.withColumn("block", deal(blocks))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("home", F.pmod(F.xxhash64(deal(q_blocks)), F.lit(blocks)).cast("long"))

    def search(block: tuple[np.ndarray, np.ndarray, np.ndarray], q_ids: np.ndarray, q_m: np.ndarray, floors: list[int | None]) -> list[np.ndarray]:
        out = [threshold_top_k(*block, int(i), q, k, _LONG[0] if f is None else f)[:2] for i, q, f in zip(q_ids, q_m, floors, strict=True)]
        found, score = map(np.concatenate, zip(*out, strict=True))
        return [np.repeat(q_ids, [len(x) for x, _ in out]), found, score]

    def searched(asked: DataFrame) -> DataFrame:
        return search_blocks(index, asked, blocks, lambda ids, m: (ids, m, sorted_lists(m)), search, "query_id long, vec_id long, score long")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = searched(asked.select(F.col("home").alias("block"), "vec_id", "v", F.lit(None).cast("long").alias("bound")))
    if blocks > 1:
        found = cut(found)
        # rows that repeat a query's vec_id have queries of their own: the least of their scores holds for all
        kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") == k).drop("n")
        every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        others = asked.join(kth.hint("merge"), "vec_id", "left").withColumn("block", every_block).where("block <> home")
        found = found.unionByName(searched(others))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
