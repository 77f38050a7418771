"""Near-duplicate detection with SimHash fingerprints, joined over per-segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits. The bit counts of the segments (0, 1 or 2 each) embed it in
a grid, where the Manhattan distance never exceeds the number of differing bits. Written in unary (00, 01, 11), the
counts fill 64 bits again and the Manhattan distance is the number of differing bits of that code.

Range join: the segments form ``max_bits + agree`` grid coordinates. Points within ``max_bits`` of each other differ in at
most so many coordinates, so they agree in at least ``agree`` of them; each point is put into one grid cell for each
choice of so many coordinates. The more points, the more coordinates a key takes, so that chance puts ``OCCUPANCY``
points into a cell at most. In a cell the Manhattan bound is tested first, then the exact number of bits.
A cell returns no more than ``forests`` spanning forests of its links, those of fewest bits first, so a family of
thousands of near copies costs a few links per member and loses no component. Cells beyond ``LIMIT`` points (dense ones)
are cut into blocks, and every two blocks meet in a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteline.llm.common import connected_components, cut, distinct_rows, keyed_rows, partitions, sorted_groups

SEED = 42
OCCUPANCY, LIMIT = 16384, 65536
#: Hot cells up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
FEW = 100_000
EVEN = 0x5555555555555555
_TILE = 1 << 18
#: Bits of a set's sketch, a power of two, and pairs of sketches held against each other at a time.
SKETCH, _PAIRS = 2048, 1 << 14


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def shingle_hashes(w: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; fewer words are one shingle, none make none."""
    if not w:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    length = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(w) - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprints_of(w: list[bytes], words: int, variants: int = 1) -> list[int]:
    """The signed 64-bit fingerprints of a text's words; no words: zero.

    The first takes the shingles' hashes as they are, each further one mixes them anew.
    """
    h = shingle_hashes(w, words)
    if not len(h):
        return [0] * variants
    out = []
    for k in range(variants):
        x = h
        if k:
            with np.errstate(over="ignore"):
                x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = x ^ (x >> np.uint64(31))
        x = x.astype(">u8")
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(x), 4096):
            ones += np.unpackbits(x[i : i + 4096].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x)).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 4, variants: int = 1) -> DataFrame:
    """(doc_id, at, same, fps) of each row: at is a hash of the text as it is, same one of its words, fps the fingerprints.

    A-Z is lower-cased, shingles of ``words`` words are hashed by XXH64, and a bit is the majority of their bits. Null
    and empty texts have no words and the fingerprint zero; fewer words than ``words`` make one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, fps = [], []
            for x in b.column(2).cast(pa.binary()):  # one text at a time
                w = words_of(x.as_py())
                same.append(xxhash.xxh3_128_digest(b" ".join(w)))
                fps.append(fingerprints_of(w, words, variants))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "at", "same", "fps"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("at"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, at long, same binary, fps array<long>")


def embed(fp: Column) -> Column:
    """Bit counts of the 32 segments in unary: the sum of differences of two embeddings is bit_count(a xor b)."""
    half = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(half), fp.bitwiseOR(half)
    return F.shiftleft(both.bitwiseAND(F.lit(EVEN)), 1).bitwiseOR(any_.bitwiseAND(F.lit(EVEN)))


def _embedded(fp: np.ndarray) -> np.ndarray:
    """``embed`` of an array of unsigned fingerprints."""
    half, even = fp >> np.uint64(1), np.uint64(EVEN)
    return ((fp & half & even) << np.uint64(1)) | ((fp | half) & even)


def agreeing(n: int, max_bits: int) -> int:
    """How many coordinates a key takes for n points: so many that chance puts OCCUPANCY points into a cell at most.

    Two segments have the same count by chance in three of eight cases.
    """
    for agree in range(1, 32 - max_bits):
        least = sum(sorted(len(x) for x in np.array_split(np.arange(32), max_bits + agree))[:agree])
        if n * 0.375**least <= OCCUPANCY:
            return agree
    return 32 - max_bits


def _masks(max_bits: int, agree: int) -> list[int]:
    """For each choice of ``agree`` grid coordinates the mask of their segments' bits."""
    at = np.array_split(np.arange(32), max_bits + agree)
    return [_signed(sum(c)) for c in combinations([sum(3 << (2 * int(i)) for i in g) for g in at], agree)]


def _cells(points: DataFrame, max_bits: int, agree: int, variants: int) -> DataFrame:
    """(key, node, fp): each point once for each fingerprint and choice of coordinates that two near ones can agree in."""
    masks = _masks(max_bits, agree)
    i = F.explode(F.sequence(F.lit(0), F.lit(variants * len(masks) - 1)))
    rows = points.select("node", "fps", i.alias("i")).select("node", "i", F.get("fps", F.expr(f"i div {len(masks)}").cast("int")).alias("fp"))
    mask = F.get(F.array(*map(F.lit, masks)), F.col("i") % len(masks))
    return rows.select(F.xxhash64("i", embed(F.col("fp")).bitwiseAND(mask)).alias("key"), "node", "fp")


def _in_blocks(cells: DataFrame, limit: int) -> DataFrame:
    """Cells of more than ``limit`` points cut into blocks of about half of that; every two blocks make a group."""
    hot = cut(cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    n_hot = hot.count()
    if not n_hot:
        return cells
    few = F.broadcast(hot) if n_hot <= FEW else hot
    rest = cells.join(few.select("key"), "key", "left_anti")
    blocks = F.ceil(F.col("n") * 2 / limit).cast("int")
    dealt = cells.join(few, "key").withColumn("k", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.xxhash64("key", F.least("k", "other"), F.greatest("k", "other"))
    return rest.unionByName(dealt.where("k <> other").select(pair.alias("key"), "node", "fp"))


def links_within(fp: np.ndarray, max_bits: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bits, linked) of a cell: pairs of row numbers within max_bits, and which rows have such a pair.

    The Manhattan bound is tested on tiles of the cell, the number of bits on what passes. Beyond ``most`` pairs no more
    are gathered, and a, b and bits are empty.
    """
    u, n, linked = _embedded(fp), len(fp), np.zeros(len(fp), dtype=bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total, i = 0, 0
    while i < n:
        step = max(1, min(n - i, _TILE // (n - i)))
        a, b = np.nonzero(np.bitwise_count(u[i : i + step, None] ^ u[None, i:]) <= max_bits)
        a, b = a[b > a] + i, b[b > a] + i
        bits = np.bitwise_count(fp[a] ^ fp[b])
        near = bits <= max_bits
        a, b = a[near], b[near]
        linked[a] = linked[b] = True
        total += len(a)
        if total <= most:
            found.append((a, b, bits[near]))
        i += step
    if total > most or not found:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))]
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), linked)


def spanning(fp: np.ndarray, max_bits: int, forests: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): row numbers of ``forests`` spanning forests of fewest bits without a common edge, by Prim's rule.

    Distances are made a row at a time, so memory is in proportion to the points.
    """
    n, out = len(fp), []
    used: list[list[int]] = [[] for _ in range(n)]
    for _ in range(forests):
        best, parent, todo = np.full(n, 255, np.uint8), np.zeros(n, np.int64), np.ones(n, bool)
        v = 0
        for _ in range(n):
            todo[v] = False
            bits = np.bitwise_count(fp ^ fp[v])
            bits[bits > max_bits] = 255
            bits[used[v]] = 255
            better = (bits < best) & todo
            best[better], parent[better] = bits[better], v
            best[v] = 255
            nearest = int(best.argmin())
            if best[nearest] < 255:
                p, v = int(parent[nearest]), nearest
                used[p].append(v)
                used[v].append(p)
                out.append((p, v))
            else:  # the next tree
                v = int(todo.argmax())
    a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return a, b


def _met(points: DataFrame, max_bits: int, forests: int, limit: int | None, members: bool) -> DataFrame:
    """(u, v, key, fp): the links of ``near_links``, repeats included, with null key and fp; with ``members`` also a row (node,
    null, key, fp) for each linked point of each cell that returned spanning forests only."""
    if not 1 <= max_bits <= 12:
        raise ValueError("max_bits must be from 1 to 12")
    n, variants = points.agg(F.count("*"), F.coalesce(F.max(F.size("fps")), F.lit(1))).first()
    limit = limit or LIMIT
    cells = _cells(points, max_bits, agreeing(n, max_bits), variants)
    cells = _in_blocks(cells, limit) if n > limit else cells
    none = lambda k: pa.nulls(k, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in sorted_groups(batches, ["key"]):
            node, fp, key = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64), t.column("key").to_numpy()
            us, vs, dense = [], [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                x = fp[s:e]
                a, b, _, linked = links_within(x, max_bits, forests * (e - s))
                of = np.flatnonzero(linked)
                if len(a) > forests * len(of) or len(of) and not len(a):
                    a, b = (of[k] for k in spanning(x[of], max_bits, forests))
                    dense.append(s + of)
                us.append(node[s + a])
                vs.append(node[s + b])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), none(len(u)), none(len(u))], names=["u", "v", "key", "fp"])
            if members and dense:
                of = np.concatenate(dense)
                yield pa.RecordBatch.from_arrays([pa.array(node[of]), none(len(of)), pa.array(key[of]), pa.array(fp[of].view(np.int64))], names=["u", "v", "key", "fp"])

    dealt = cells.repartition(partitions(cells), "key").sortWithinPartitions("key", "node").select("key", "node", "fp")
    return dealt.mapInArrow(run, "u long, v long, key long, fp long")


def near_links(points: DataFrame, max_bits: int = 4, forests: int = 1, limit: int | None = None) -> DataFrame:
    """Links (u, v), u > v, between points (``node`` long, ``fps`` array of fingerprints, equal numbers of them).

    Two points are near if for one of the numbers their fingerprints differ in at most ``max_bits`` bits. A cell with up
    to ``forests`` near pairs per linked point returns them all, a denser one so many spanning forests; so links have
    the same components as all near pairs. ``limit``: points of a cell beyond which it is cut into blocks.
    """
    return _met(points, max_bits, forests, limit, False).select("u", "v").where("u <> v").distinct()


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Of each of ``SKETCH`` buckets whether an odd number of a set's 64-bit hashes falls into it.

    Two sketches differ in no more bits than their sets have elements that are not in both.
    """
    n = np.bincount((shingles.view(np.uint64) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits(n & 1).tobytes()


def _may_be_similar(size: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a, b) of row numbers those whose sizes and sketches leave a Jaccard similarity of ``similarity`` possible, and
    in how many bits their sketches differ. A set's sketch is a row of ``sketch``."""
    alike = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
    a, b = a[alike], b[alike]
    differ = np.empty(len(a), dtype=np.int64)
    for i in range(0, len(a), _PAIRS):
        differ[i : i + _PAIRS] = np.bitwise_count(sketch[a[i : i + _PAIRS]] ^ sketch[b[i : i + _PAIRS]]).sum(axis=1)
    # |a ^ b| <= (1 - s) / (1 + s) * (|a| + |b|) is the same as a similarity of s or more; one is for rounding
    may = differ <= (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1
    return np.stack([a[may], b[may]]), differ[may]


def links_across(members: DataFrame, labels: DataFrame, max_bits: int, similarity: float, first: bool = False) -> DataFrame:
    """All near pairs (u, v), u > v, of points (key, node, fp) of one cell whose ``labels`` (node, label, size, sketch) differ.

    Pairs whose sizes or sketches of sets rule out a Jaccard similarity of ``similarity`` are left out in the cell. With
    ``first`` only the pair of fewest different bits of sketches is returned for each two labels of a tile. A cell with one
    label takes no further step, and pairs leave a tile at a time.
    """
    rows = members.join(labels, "node")
    parted = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in sorted_groups(batches, ["key"]):
            node, label, size = (t.column(c).to_numpy() for c in ("node", "label", "size"))
            fp = t.column("fp").to_numpy().view(np.uint64)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                sketch = np.frombuffer(b"".join(t.column("sketch")[s:e].to_pylist()), dtype=np.uint64).reshape(e - s, -1)
                # points of a label lie one after the other and meet all behind them
                after = s + np.searchsorted(label[s:e], label[s:e], side="right")
                i = s
                while i < e and (behind := int(after[i - s])) < e:
                    last = min(behind, i + max(1, _TILE // (e - behind)))
                    a, b = np.nonzero(np.bitwise_count(fp[i:last, None] ^ fp[None, behind:e]) <= max_bits)
                    (a, b), differ = _may_be_similar(size[s:e], sketch, a + i - s, b + behind - s, similarity)
                    a, b = a + s, b + s
                    if first and len(a):  # a tile has one label on its left side
                        order = np.lexsort((differ, label[b]))
                        order = order[np.flatnonzero(np.diff(label[b][order], prepend=-1))]
                        a, b = a[order], b[order]
                    u, v = node[a], node[b]
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])
                    i = last

    dealt = rows.join(parted, "key", "left_semi").repartition(partitions(rows), "key").sortWithinPartitions("key", "label").select("key", "node", "fp", "label", "size", "sketch")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, limit: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id reachable over links.

    Equal fingerprints, those of null and empty texts among them, are linked. Rows that repeat a doc_id each get a row
    and are linked by their texts alone; a component without doc_id has a null component_id. An empty table gives none.
    Copies are reduced to one point before the join and only take the point's component afterwards.
    """
    fps = cut(fingerprints(docs, words).select("doc_id", F.get("fps", F.lit(0)).alias("fp")))
    points = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"))).withColumn("node", F.monotonically_increasing_id())
    found = connected_components(near_links(points.select("node", F.array("fp").alias("fps")), max_bits, limit=limit))
    of = points.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(of.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _similar(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between nodes whose ``sets`` (node, shingles) have a Jaccard similarity of ``similarity`` or more."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_u", "s_v"))
    # |a & b| / |a | b|, without the union
    return links.join(side("u"), "u").join(side("v"), "v").where(both >= similarity * (F.size("s_u") + F.size("s_v") - both)).select("u", "v")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 8, variants: int = 4, forests: int = 3) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, null last.

    Candidates differ in at most ``max_bits`` bits in one of ``variants`` fingerprints; they are linked if the sets of
    their shingles of ``words`` words have a Jaccard similarity of ``similarity`` or more, and a group is a component of
    links. Texts of the same words are one point from the start, those without words (null, empty) among them. Rows that
    repeat doc_id and text count as one; those that repeat a doc_id with another text are documents of their own.

    Dense cells give ``forests`` spanning forests of candidates first. Once these are tested, all other candidates of such a
    cell between two groups are tested too, so groups are those of all candidates. Sketches of their sets, which never rule
    out a similar pair, come before the sets, and the likeliest candidate of two groups comes before the others.
    """
    fps = cut(fingerprints(docs, words, variants))
    one = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("at"))
    texts = cut(fps.groupBy("same").agg(F.first("fps").alias("fps"), F.min(one).alias("one")).select("fps", "one")).withColumn("node", F.monotonically_increasing_id())
    met = cut(_met(texts.select("node", "fps"), max_bits, forests, None, True))
    links = cut(met.where("v is not null and u <> v").select("u", "v").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(words_of(x.as_py()), words)).view(np.int64) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(map(odd_sketch, sets), pa.binary())], names=["node", "shingles", "sketch"])

    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rows = keyed_rows(docs)
    wanted = texts.join(ends, "node").select("node", F.col("one.doc_id").alias("w_id"), F.col("one.at").alias("w_at"))
    same_row = lambda i, at: F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("at") == F.col(at))
    asked = rows.select("doc_id", "at", F.col("row.text").cast("string").alias("text")).join(wanted, same_row("w_id", "w_at"))
    sets = cut(asked.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, shingles array<long>, sketch binary"))
    found = connected_components(_similar(links, sets, similarity))
    members = met.where("v is null").select("key", F.col("u").alias("node"), "fp")
    for first in (True, False):  # two groups that one pair links need no second
        labels = sets.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("label"), F.size("shingles").alias("size"), "sketch")
        across = cut(links_across(members, labels, max_bits, similarity, first))
        if across.isEmpty():
            break
        found = connected_components(found.toDF("u", "v").unionByName(_similar(across, sets, similarity)))
    of = texts.join(found, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("one").alias("one"))
    kept = of.select(F.col("one.doc_id").alias("k_id"), F.col("one.at").alias("k_at"))
    return distinct_rows(rows.join(kept, same_row("k_id", "k_at"), "left_semi"), fps.groupBy("doc_id", "at").agg(F.count("*").alias("n")).where("n > 1"))
