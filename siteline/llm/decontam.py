"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of about ``SHARD_BYTES`` of text and indexes the words of each: suffix array,
Burrows-Wheeler transform, a wavelet matrix for ranks, and every ``SAMPLE``-th suffix position. All windows of the
benchmark are searched backwards at once, occurrences are located through the sampled positions, and overlapping
occurrences become removal spans. A window holds only words of the benchmark, so a shard indexes only those runs of a
document's words that consist of such words and are no shorter than the shortest window; others can't hold one.

The phrases reach the tasks in blocks of benchmark items of at most ``max_words`` words each; more items make more passes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from siteline.llm.common import cut, keyed_rows, union_all, with_text

SHARD_BYTES = 8 << 20
SAMPLE = 4
#: Bytes of words: digits, letters of ASCII and all bytes of other characters.
_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z; null has none."""
    return (text or b"").lower().translate(_WORDS).split()


class Phrases:
    """The distinct windows of benchmark items, as numbered words, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.word: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, words in items:
            ids = [self.word.setdefault(w, len(self.word) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                holders[tuple(ids[i : i + window])].update([] if item is None else [item])
        self.items = [sorted(x) for x in holders.values()]
        self.length = np.array([len(k) for k in holders], dtype=np.int64)
        self.ids = np.zeros((len(holders), window), dtype=np.int64)
        for i, k in enumerate(holders):
            self.ids[i, : len(k)] = k
        self.least = int(self.length.min()) if len(holders) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of an integer array in order, by prefix doubling."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2
        if rank[order[-1]] == n or step >= n:
            return order


class Bits:
    """A bit vector with ranks: the bits themselves, and the number of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before place i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """FM-index of an integer array that ends in its only 0, the least symbol.

    Kept are a bit vector for each level of the wavelet matrix, one that marks the sampled rows, and their positions.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = suffix_array(text)
        level = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.levels - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.levels))))
        self.sampled = Bits(order % SAMPLE == 0)
        self.at = order[order % SAMPLE == 0].astype(np.int32)
        self.n = n

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol comes in the transform before place i."""
        start = np.zeros_like(i)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k].rank(start), self.ones[k].rank(i)
            start = np.where(one, self.zeros[k] + a, start - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - start

    def step(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier."""
        symbol, place, start = np.zeros_like(i), i, np.zeros_like(i)
        for k in range(self.levels):
            a, b, one = self.ones[k].rank(start), self.ones[k].rank(place), self.ones[k][place]
            symbol = symbol * 2 + one
            start = np.where(one, self.zeros[k] + a, start - a)
            place = np.where(one, self.zeros[k] + b, place - b)
        return self.before[symbol] + place - start

    def search(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases: the numbers of those that occur and their ranges of rows."""
        which = np.arange(len(length))
        lo, hi = np.zeros(len(length), dtype=np.int64), np.full(len(length), self.n, dtype=np.int64)
        for k in range(ids.shape[1]):
            left = length[which] - 1 - k
            go = left >= 0
            c = ids[which, np.maximum(left, 0)]
            ok = go & (c < 1 << self.levels)
            c = np.where(ok, c, 0)
            lo = np.where(ok, self.before[c] + self.rank(c, lo), np.where(go, 0, lo))
            hi = np.where(ok, self.before[c] + self.rank(c, hi), np.where(go, 0, hi))
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: steps back to a sampled row."""
        out, open_, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(open_):
            known = self.sampled[rows]
            out[open_[known]] = self.at[self.sampled.rank(rows[known])] + steps
            rows, open_ = self.step(rows[~known]), open_[~known]
            steps += 1
        return out


def _search_shard(docs: list[tuple[int, list[int]]], phrases: Phrases) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """For each document (number, word numbers) with occurrences: spans of hit words and the items."""
    symbols, places = [], []
    for k, ids in docs:
        x = np.array(ids, dtype=np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (x > 0).astype(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= phrases.least:
                symbols += [x[a:b] + 1, [1]]  # 1 parts the runs
                places += [np.stack((np.full(b - a + 1, k), np.arange(a, b + 1)))]
    if not symbols:
        return {}
    text = np.concatenate([*symbols, [0]]).astype(np.int64)
    place = np.concatenate([*places, [[-1], [-1]]], axis=1)
    index = FMIndex(text)
    which, lo, hi = index.search(np.where(phrases.ids > 0, phrases.ids + 1, 0), phrases.length)
    count = hi - lo
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else lo
    at = index.locate(rows)
    phrase = np.repeat(which, count)
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    doc, first = place[0][at], place[1][at]
    for i in np.lexsort((first, doc)):
        spans, items = out.setdefault(int(doc[i]), ([], set()))
        a, b = int(first[i]), int(first[i] + phrases.length[phrase[i]])
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
        items.update(phrases.items[phrase[i]])
    return out


def _one_pass(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """``rows`` (carry, text) as (carry, n_words, spans, items, less), carry being any column, for the phrases that were sent.

    less: the text without the spans, null without any. Without ``text``, that of the struct carry is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        get = phrases.word.get
        for b in batches:
            texts = (b.column(1) if b.num_columns > 1 else b.column(0).field("text")).cast(pa.binary())
            n_words, shard, size = [], [], 0
            found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
            for k, x in enumerate(texts):
                words = words_of(t := x.as_py())
                n_words.append(len(words))
                ids = [get(w, 0) for w in words]
                shard.append((k, ids))
                size += len(t or b"")
                if size >= SHARD_BYTES:
                    found |= _search_shard(shard, phrases)
                    shard, size = [], 0
            found |= _search_shard(shard, phrases)
            spans = [[{"a": a, "b": z} for a, z in found[k][0]] if k in found else [] for k in range(len(n_words))]
            items = [sorted(found[k][1]) if k in found else [] for k in range(len(n_words))]
            less = [without_spans(texts[k].as_py().decode(), found[k][0]) if k in found else None for k in range(len(n_words))]
            kinds = (pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip((n_words, spans, items, less), kinds, strict=True))], names=["carry", "n_words", "spans", "items", "less"])

    span = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))
    out = [rows.schema["carry"], StructField("n_words", LongType()), StructField("spans", span), StructField("items", ArrayType(StringType())), StructField("less", StringType())]
    return rows.mapInArrow(run, StructType(out))


def _blocks(benchmark: DataFrame, max_words: int) -> tuple[DataFrame, int]:
    """The benchmark as (item_id, text) of strings, and in how many blocks it is searched."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bench, 1 + size // (4 * max_words)


def _sent(bench: DataFrame, window: int, blocks: int, k: int) -> Broadcast:
    """The phrases of block k of the benchmark, on all executors."""
    some = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
    phrases = Phrases([(r.item_id, words_of((r.text or "").encode())) for r in some.toLocalIterator()], window)
    return bench.sparkSession.sparkContext.broadcast(phrases)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, max_words: int) -> DataFrame:
    """``removal_spans`` with at, a hash of the text that tells rows of one doc_id apart."""
    bench, blocks = _blocks(benchmark, max_words)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("at")).alias("carry")
    rows, passes = docs.select(key, F.col("text").cast("string").alias("text")), []
    for k in range(blocks):
        sent = _sent(bench, window, blocks, k)
        one = _one_pass(rows, sent).select("carry.doc_id", "carry.at", "n_words", "spans", "items")
        if blocks == 1:
            return one
        passes.append(cut(one))  # a block's phrases go before those of the next are made
        sent.destroy()
    # equal texts have equal spans, so copies of a row are counted and written out again
    rows = union_all(passes).groupBy("doc_id", "at").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    )

    step = lambda m, s: F.when((F.size(m) > 0) & (F.element_at(m, -1)["b"] >= s["a"]), F.concat(F.slice(m, 1, F.size(m) - 1), F.array(F.struct(F.element_at(m, -1)["a"].alias("a"), F.greatest(F.element_at(m, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(m, F.array(s)))

    rows = rows.withColumn("spans", F.aggregate("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)"), step))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of ``docs``.

    spans: merged half-open ranges of word numbers inside occurrences of windows of benchmark items; items: item_ids (as
    strings, sorted) with an occurrence. An item of fewer words than ``window`` is one window; an item or document
    without words, null included, has none. Items that repeat an item_id are taken together; items without one give
    spans only. Each document gives a row, be its doc_id repeated or null; an empty table gives none, and an empty
    benchmark no spans. Phrases are searched in passes of about ``max_words`` words of the benchmark, one in memory at
    a time.
    """
    return _found(docs, benchmark, window, max_words).drop("at")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the digest of items of ``removal_spans``."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (sorted, apart) and the marks between them; a line break stands for each."""
    out, done, word = [], 0, enumerate(_WORD.finditer(text))
    for a, b in spans:
        for i, m in word:
            if i == a:
                out += [text[done : m.start()], "\n"]
            if i == b - 1:
                done = m.end()
                break
    return "".join(out) + text[done:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 2_000_000) -> DataFrame:
    """``docs`` with the removal spans taken out of the texts; n_chars, if there, is counted anew.

    Documents without a span keep their text to the byte; one of which no word is left goes. Rows with a null or
    repeated doc_id are treated by their texts, each on its own. With one block of phrases this is a single pass without
    a shuffle; spans of more blocks are put together by document first.
    """
    bench, blocks = _blocks(benchmark, max_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    if blocks == 1:
        rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("carry"))
        out = _one_pass(rows, _sent(bench, window, 1, 0)).where((F.size("spans") == 0) | (n_hit < F.col("n_words"))).withColumnRenamed("carry", "row")
        return with_text(out, F.col("less"), docs)
    hit = _found(docs, benchmark, window, max_words).where(F.size("spans") > 0).dropDuplicates(["doc_id", "at"])
    hit = hit.select(F.col("doc_id").alias("h_id"), F.col("at").alias("h_at"), "spans", (n_hit == F.col("n_words")).alias("gone"))
    rows = keyed_rows(docs).join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("at") == F.col("h_at")), "left").where("not coalesce(gone, false)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and without_spans(t, [(x["a"], x["b"]) for x in s or ()]) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "less"])

    rows = rows.select("row", F.when(F.col("spans").isNotNull(), F.col("row.text").cast("string")).alias("text"), "spans")
    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("less", StringType())]))
    return with_text(out, F.col("less"), docs)
