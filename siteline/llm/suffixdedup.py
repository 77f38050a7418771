"""Repeated passages by sparse suffix arrays.

Of a text's suffixes only those are kept that start at a minimiser: the ``K`` words with the least hash among all that
start in a stretch of ``length - K + 1`` words. Two copies of a passage of ``length`` words keep the same ones, and each
stretch keeps one. Suffixes whose first words come up more than once are dealt out by these words and sorted by what
follows; neighbours are compared and their matches extended right and left. Suffixes with very frequent first words are
dealt out further by a hash, so a neighbour may be missed there; and a third text can hide a match of two others. So
stretches that no neighbour settled are hashed and counted among all stretches with the same first words, settled ones
included: in the task where these are together, else over the whole corpus. Together this marks exactly the words
that lie in a stretch of ``length`` words that occurs at least twice.

Words are compared by 32 bits of a 64-bit hash each, over ``length`` words, after equal 64-bit hashes of the first words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteline.llm.common import cut, partitions

K = 10
#: Suffixes with the same first words are sorted together up to this number.
TOGETHER = 2000
MANY = 1000
_BASE = 0x9E3779B97F4A7C15
_MOD = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_memo: dict[bytes, int] = {}


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, between ASCII white space."""
    words = (text or b"").split()
    if len(_memo) > 500_000:
        _memo.clear()
    get, digest = _memo.get, xxhash.xxh64_intdigest
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = digest(w, 7)
            if len(w) < 64:
                _memo[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k words in a row, along the last axis."""
    n = h.shape[-1]
    if n < k:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros((*h.shape[:-1], 1), np.uint64), np.cumsum(h * _powers(_BASE, n), axis=-1, dtype=np.uint64)), axis=-1)
        x = (sums[..., k:] - sums[..., :-k]) * _powers(_INVERSE, n - k + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def minimisers(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of the K words there, first and last stretch that it stands for), for stretches of ``length``."""
    grams = rolling(h, K)
    if len(h) < length:
        none = np.empty(0, dtype=np.int64)
        return none, np.empty(0, dtype=np.uint64), none, none
    at = np.lib.stride_tricks.sliding_window_view(grams, length - K + 1).argmin(axis=1) + np.arange(len(h) - length + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return at[first], grams[at[first]], first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("at"), text.alias("text"))


def _sparse(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, at, n_words, keys, places): one row per document with its kept suffixes; at is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, keys, places = [], [], []
            for x in b.column(2).cast(pa.binary()):
                h = word_hashes(x.as_py())
                at, gram, _, _ = minimisers(h, length)
                n_words.append(len(h))
                keys.append(_signed(gram))
                places.append(at.astype(np.int32))
            lists = [pa.array(v, pa.list_(t)) for v, t in ((keys, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), *lists], names=["doc_id", "at", "n_words", "keys", "places"])

    return _keyed(docs).mapInArrow(run, "doc_id long, at long, n_words long, keys array<long>, places array<int>")


_SUFFIX = "key long, n long, doc long, at int, before int, after int, context binary"


def _suffixes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Suffixes of the texts (doc, doc_id, at) at the wanted places with their context: words after the first K, words before backwards, numbers of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - K
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, x, wants in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                h = word_hashes(x.as_py())
                short = np.maximum(h >> np.uint64(32), np.uint64(1)).astype(">u4")  # 0 stands for no word
                at, gram, first, last = minimisers(h, length)
                count = {w["at"]: w["n"] for w in wants}
                for p, g, lo, hi in zip(at.tolist(), _signed(gram).tolist(), first.tolist(), last.tolist(), strict=True):
                    if p in count:
                        right = short[p + K : p + length].tobytes().ljust(4 * reach, b"\0")
                        left = short[max(0, p - reach) : p][::-1].tobytes().ljust(4 * reach, b"\0")
                        ends = min(len(h) - p - K, reach)
                        for c, v in zip(cols, (g, count[p], doc, p, p - lo, p - hi, right + left + bytes([min(p, reach), ends])), strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "n", "doc", "at", "before", "after", "context"])

    theirs = wanted.select("doc", F.col("doc_id").alias("w_id"), F.col("at").alias("w_at"), "wants")
    rows = _keyed(docs).join(theirs, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("at") == F.col("w_at")))
    return rows.select("doc", "text", "wants").mapInArrow(run, _SUFFIX)


_MATCH = "doc long, a int, b int, hash long"


def _compare(suffixes: DataFrame, length: int) -> DataFrame:
    """Spans (doc, a, b) of repeats within a group of suffixes; of keys over more groups, (doc, a, null, hash) of the
    stretches without a copy in their group and (doc, null, null, hash) once for each stretch with one."""
    reach = length - K

    def same(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        differ = x != y
        return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), reach), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b, final in _with_end(batches):
            t = pa.concat_tables([x for x in (held, pa.Table.from_batches([b])) if x is not None])
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
            # the last group waits for the rest of its rows
            end = len(t) if final else int(starts[-1])
            held, t = t.slice(end).combine_chunks(), t.slice(0, end)
            if not end:
                continue
            key, doc, at, before, after, n = (t.column(c).to_numpy() for c in ("key", "doc", "at", "before", "after", "n"))
            starts = starts[starts < end]
            together = np.ones(end, dtype=bool)
            together[starts] = False
            raw = np.frombuffer(b"".join(t.column("context").to_pylist()), dtype=np.uint8).reshape(end, 2 + 8 * reach)
            words = raw[:, :-2].copy().view(">u4")
            left_n, right_n = raw[:, -2].astype(np.int64), raw[:, -1].astype(np.int64)
            r = K + same(words[1:, :reach], words[:-1, :reach], np.minimum(right_n[1:], right_n[:-1]))
            lft = same(words[1:, reach:], words[:-1, reach:], np.minimum(left_n[1:], left_n[:-1]))
            r, lft = np.where(together[1:], r, 0), np.where(together[1:], lft, 0)
            zero = np.zeros(1, dtype=np.int64)
            spans = [(np.concatenate((zero, r)), np.concatenate((zero, lft))), (np.concatenate((r, zero)), np.concatenate((lft, zero)))]
            out: list[list[np.ndarray]] = [[], [], [], []]

            def put(*values: np.ndarray) -> None:
                for c, v in zip(out, values, strict=True):
                    c.append(v)

            for rr, ll in spans:
                ok = rr + ll >= length
                put(doc[ok], at[ok] - ll[ok], at[ok] + rr[ok], np.zeros(ok.sum(), np.int64))
            o = np.arange(reach + 1)[None, :]  # how far before the suffix a stretch starts
            fits = (after[:, None] <= o) & (o <= before[:, None])
            open_ = fits & (n > 2)[:, None]
            for rr, ll in spans:
                open_ &= ~((o <= ll[:, None]) & (length - o <= rr[:, None]))
            spread = n > TOGETHER
            open_ &= spread[:, None] | (length - o <= np.maximum(spans[0][0], spans[1][0])[:, None])
            # copies of an open stretch may be settled ones, so all stretches of its group count; of spread keys always
            rows = np.flatnonzero(spread | np.repeat(np.logical_or.reduceat(open_.any(axis=1), starts), np.diff(np.append(starts, end))))
            if len(rows):
                line = np.concatenate((words[rows, reach:][:, ::-1].astype(np.uint64), np.ascontiguousarray(key[rows]).view(np.uint64)[:, None], words[rows, :reach].astype(np.uint64)), axis=1)
                # the K first words stand as one symbol, so a stretch is length - K + 1 symbols
                grams = _signed(rolling(line, reach + 1)[:, ::-1])
                i, k = np.nonzero(fits[rows])
                hashes, first, of, times = np.unique(grams[i, k], return_index=True, return_inverse=True, return_counts=True)
                is_open, again = open_[rows][i, k], times[of] > 1
                i, k, hashed = rows[i], k, grams[i, k]
                ok = is_open & again
                put(doc[i[ok]], at[i[ok]] - k[ok], at[i[ok]] - k[ok] + length, np.zeros(ok.sum(), np.int64))
                ok = is_open & ~again & spread[i]
                put(doc[i[ok]], at[i[ok]] - k[ok], np.full(ok.sum(), -1), hashed[ok])
                ok = first[(times > 1) & spread[i[first]]]
                put(doc[i[ok]], np.full(len(ok), -1), np.full(len(ok), -1), hashed[ok])
            cols = [np.concatenate(c) for c in out]
            a_col, b_col = (pa.array(c.astype(np.int32), mask=c < 0) for c in cols[1:3])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), a_col, b_col, pa.array(cols[3], pa.int64())], names=["doc", "a", "b", "hash"])

    spread = F.when(F.col("n") <= TOGETHER, 0).otherwise(F.pmod(F.xxhash64("doc", "at"), F.ceil(F.col("n") / TOGETHER))).cast("int")
    rows = suffixes.withColumn("salt", spread)
    rows = rows.repartition(partitions(rows), "key", "salt").sortWithinPartitions("key", "salt", "context", "doc", "at")
    return rows.select("key", "salt", "doc", "at", "before", "after", "n", "context").mapInArrow(run, _MATCH)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        if last is not None:
            yield last, False
        last = b
    if last is not None:
        yield last, True


def repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_words, spans) of each row: merged half-open ranges of word numbers in repeated passages.

    A passage is repeated if its ``length`` words, between ASCII white space and to the letter, occur elsewhere in the
    corpus or again in the text. Null, empty and shorter texts have no spans. Each row is a text of its own, be its
    doc_id repeated or null; so rows that repeat a long text are repeats of each other. An empty table gives no rows.
    """
    if not K < length <= 250:
        raise ValueError(f"length must be from {K + 1} to 250")
    sparse = cut(_sparse(docs, length))
    # rows equal in doc_id and text are taken together here, and come apart again where they meet their texts
    texts = sparse.groupBy("doc_id", "at").agg(F.first("keys").alias("keys"), F.first("places").alias("places"), F.count("*").alias("copies"))
    texts = cut(texts).withColumn("doc", F.monotonically_increasing_id())
    flat = texts.select("doc", "copies", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("at"))))
    twice = cut(flat.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1"))
    # keys that hold more than 1/MANY of all suffixes are fewer than MANY: they are joined without a shuffle
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(twice.where(F.col("n") * MANY > F.lit(total)))
    rest = flat.join(hot, "key", "left_anti").join(twice, "key")
    wanted = flat.join(hot, "key").unionByName(rest).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("wants"))
    names = texts.select("doc", "doc_id", "at")
    found = cut(_compare(_suffixes(docs, wanted.join(names, "doc"), length), length))
    open_ = found.where("b is null").select("doc", "a", "hash")
    again = open_.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    spans = found.where("b is not null").select("doc", "a", "b").unionByName(open_.where("a is not null").join(again, "hash").select("doc", "a", (F.col("a") + length).cast("int").alias("b")))
    empty = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    last = lambda m: F.element_at(m, -1)
    grow = lambda m, s: F.when((F.size(m) > 0) & (last(m)["b"] >= s["a"]), F.concat(F.slice(m, 1, F.size(m) - 1), F.array(F.struct(last(m)["a"].alias("a"), F.greatest(last(m)["b"], s["b"]).alias("b"))))).otherwise(F.concat(m, F.array(s)))
    merged = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("s")).select("doc", F.aggregate("s", empty, grow).alias("spans"))
    merged = merged.join(names, "doc").select(F.col("doc_id").alias("m_id"), F.col("at").alias("m_at"), "spans")
    out = sparse.select("doc_id", "at", "n_words").join(merged, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("at") == F.col("m_at")), "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of repeated words and the spans as text."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ",")
    return found.select("doc_id", "n_words", n.alias("n_repeated"), text.alias("spans"), (F.size("spans") > 0).alias("repeated"))
