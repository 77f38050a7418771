"""Nearest neighbours by Euclidean distance with vantage-point trees, one per shard of vectors.

A shard holds some thousands of vectors, dealt evenly. Each node of its tree has a vantage point and splits its vectors at
their median distance from it. By the triangle inequality a query at distance d from the vantage point is at least
d - hi or lo - d away from vectors at distances lo to hi; a side is left out once that bound, multiplied by ``relax``, exceeds
the k-th best distance so far. At 1 the search is exact; larger factors leave out more. Queries meet one shard each
first, a thousand the same one; the k-th distance found there bounds their search of all other shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteline.llm.common import cut, search_blocks

#: Vectors of a shard, queries that share their first shard, and vectors of a leaf, all on average.
SHARD, QUERIES, LEAF = 4096, 1024, 128
#: Rounding of distances, in parts of their size.
SLACK = 1e-12


def distances(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a vector; squares are added in the order of the dimensions, so that equal vectors
    have equal distances whatever stands beside them."""
    d = m - q
    with np.errstate(over="ignore"):
        return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


class Tree:
    """A vantage-point tree over the rows of a matrix, which are put in the order of its leaves.

    Of node i: ``ends[i]``, the rows it covers; ``vantage[i]``, the row of its vantage point (-1: a leaf); ``reach[i]``, the
    nearest and farthest distance from that point on the near side, then on the far side; ``sides[i]``, its two nodes.
    """

    PARTS = {"ids": np.int64, "m": np.float64, "ends": np.int32, "vantage": np.int32, "reach": np.float64, "sides": np.int32}

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def build(cls, ids: np.ndarray, m: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(m))
        ends, vantage, reach, sides = [(0, len(m))], [-1], [(0.0,) * 4], [(-1, -1)]
        todo = [0]
        while todo:
            node = todo.pop()
            start, end = ends[node]
            if end - start <= leaf:
                continue
            rows = order[start:end]
            v = rows[np.argmax(distances(m[rows], m[rows[0]]))]  # a corner of the cloud parts it better than its middle
            d = distances(m[rows], m[v])
            near = d <= np.median(d)
            if near.all():
                near = d < d.max()
            if not near.any():  # copies of one vector: they stay a leaf
                continue
            order[start:end] = np.concatenate((rows[near], rows[~near]))
            middle = start + int(near.sum())
            vantage[node], sides[node] = int(v), (len(ends), len(ends) + 1)
            reach[node] = (d[near].min(), d[near].max(), d[~near].min(), d[~near].max())
            todo += sides[node]
            for part in ((start, middle), (middle, end)):
                ends.append(part)
                vantage.append(-1)
                reach.append((0.0,) * 4)
                sides.append((-1, -1))
        place = np.append(np.argsort(order), -1)
        return cls(ids=ids[order], m=m[order], ends=np.array(ends, np.int32), vantage=place[vantage].astype(np.int32), reach=np.array(reach), sides=np.array(sides, np.int32))

    def packed(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k), dtype=t).tobytes() for k, t in self.PARTS.items()}

    @classmethod
    def unpacked(cls, row: dict) -> Tree:
        parts = {k: np.frombuffer(row[k], dtype=t) for k, t in cls.PARTS.items()}
        return cls(**{k: x.reshape(n, -1) if (n := {"m": len(parts["ids"]), "ends": len(parts["vantage"]), "reach": len(parts["vantage"]), "sides": len(parts["vantage"])}.get(k)) else x for k, x in parts.items()})

    def search(self, own: int, q: np.ndarray, k: int, relax: float = 1.0, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances, rows looked at) of the k nearest to q without those of id ``own``, ties to smaller ids.

        Rows farther than ``bound`` need not be found.
        """
        best, dist, seen = np.empty(0, dtype=np.int64), np.empty(0), 0
        limit = bound * (1 + SLACK)
        todo = [(0.0, 0)]
        while todo:
            least, node = todo.pop()
            if least > limit:
                continue
            v = self.vantage[node]
            if v < 0:
                start, end = self.ends[node]
                d = distances(self.m[start:end], q)
                seen += int(end - start)
                ids = self.ids[start:end]
                keep = (d <= limit) & (ids != own)
                best, dist = np.concatenate((best, ids[keep])), np.concatenate((dist, d[keep]))
                order = np.lexsort((best, dist))[:k]
                best, dist = best[order], dist[order]
                if len(best) == k:
                    limit = min(limit, float(dist[-1]) * (1 + SLACK))
                continue
            d = float(distances(self.m[v : v + 1], q)[0])
            near_lo, near_hi, far_lo, far_hi = self.reach[node].tolist()
            slack = SLACK * (d + far_hi)
            near, far = max(0.0, near_lo - d, d - near_hi) - slack, max(0.0, far_lo - d, d - far_hi) - slack
            a, b = (max(least, near * relax), self.sides[node][0]), (max(least, far * relax), self.sides[node][1])
            todo += (b, a) if d - near_hi < far_lo - d else (a, b)  # the likelier side is popped first
        return best, dist, seen


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors as doubles; left out are null vectors, those of zeros or no component, those with null or
    non-finite components, and rows without vec_id."""
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).where(some)
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, relax: float = 1.0, leaf: int = LEAF, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all vectors for each query, a row whose vec_id ``every`` divides.

    Score: Euclidean distance in double precision, ties to the smaller vec_id. ``relax``: 1 finds all k nearest, larger
    factors look at fewer vectors and may miss some; distances returned are exact in either case. A query meets vectors of
    its own number of dimensions but not those with its own vec_id; rows that repeat another vec_id are candidates each, and
    rows that repeat a query's vec_id ask together: the k best of their pairs. An empty table gives none.
    """
    if relax < 1:
        raise ValueError("relax must be 1 or more")
    rows = cut(usable(vectors)).withColumn("dealt", F.monotonically_increasing_id())  # deals rows out evenly, whatever repeats
    n, asking = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    count, q_count = 1 + n // shard, 1 + asking // QUERIES
    deal = lambda b: F.pmod(F.xxhash64("dealt"), F.lit(b)).cast("long")
    index = rows.withColumn("block", deal(count))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("home", F.pmod(F.xxhash64(deal(q_count)), F.lit(count)).cast("long"))

    def search(tree: Tree, q_ids: np.ndarray, q_m: np.ndarray, bounds: list[float | None]) -> list[np.ndarray]:
        out = [tree.search(i, q, k, relax, np.inf if x is None else x)[:2] for i, q, x in zip(q_ids.tolist(), q_m, bounds, strict=True)]
        near, d = map(np.concatenate, zip(*out, strict=True))
        return [np.repeat(q_ids, [len(x) for x, _ in out]), near, d]

    def searched(asked: DataFrame) -> DataFrame:
        return search_blocks(index, asked, count, lambda ids, m: Tree.build(ids, m, leaf), search, "query_id long, vec_id long, score double")

    found = searched(asked.select(F.col("home").alias("block"), "vec_id", "v", F.lit(None).cast("double").alias("bound")))
    if count > 1:
        found = cut(found)
        kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.max("score").alias("bound")).where(F.col("n") >= k).drop("n")
        every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        others = asked.join(kth.hint("merge"), "vec_id", "left").withColumn("block", every_shard).where("block <> home")
        found = found.unionByName(searched(others))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
