"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes homoglyphs of other scripts, full-width forms, invisible characters and digits that stand for letters.
The lexicon (words, and beginnings of words) with its weights and the exception phrases, in which an entry doesn't count,
are learned from labelled rows. A document's weight is set against its length, and a logistic curve makes the score.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteline.llm.langid import held_out

# Look-alikes of Latin letters in Cyrillic and Greek, and what digits and marks stand for.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = (
    {c: " " for c in range(128) if not chr(c).isalnum()}
    | {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()}
    | {0xFF41 + i: chr(97 + i) for i in range(26)}
    | {0xFF10 + int(a): b for a, b in SUBSTITUTES.items() if a.isdigit()}
    | dict.fromkeys(map(ord, INVISIBLE))
    | {c: " " for c in (0xA0, 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x2026)}
)
PREFIXES = (4, 5, 6)
#: The greatest weight of a text, which keeps one very long text from bending the curve of the score.
MOST_WEIGHT = 30.0


def fold(text: str | None) -> str:
    """Lower-cased, folded text: words between single blanks, with one at either end."""
    return f" {' '.join((text or '').lower().translate(_FOLD).split())} "


def entries_of(folded: str) -> set[str]:
    """What of a text may become an entry: words as `` word `` and beginnings of words as `` wor``."""
    words = {w for w in folded.split() if 3 <= len(w) <= 24}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the coefficients of the score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k in self.exceptions:
            a.add_word(k, (len(k), 0.0, True))
        for k, w in self.weights.items():
            a.add_word(k, (len(k), w, False))
        a.make_automaton()
        return a

    def hits(self, a: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of matched entries outside exception phrases."""
        if not len(a):
            return []
        found = [(end - n + 1, end + 1, w, x) for end, (n, w, x) in a.iter(folded)]
        excepted = sorted((s, e) for s, e, _, x in found if x)
        starts, reach = [s for s, _ in excepted], list(accumulate((e for _, e in excepted), max))

        def inside(s: int, e: int) -> bool:  # the phrases that begin at s or before reach as far as e
            k = bisect_right(starts, s)
            return k > 0 and e <= reach[k - 1] + 1

        return [(s, e, w) for s, e, w, x in found if not x and not inside(s, e)]

    def measures(self, a: ahocorasick.Automaton, text: str | None) -> tuple[float, float]:
        """A text's weight, and its weight for its length: by the root of the number of words.

        All entries count; a weight beyond MOST_WEIGHT counts as that, where the score is 1 to many digits anyway.
        """
        folded = fold(text)
        total = min(sum(w for _, _, w in self.hits(a, folded)), MOST_WEIGHT)
        return total, total / math.sqrt(max(1, folded.count(" ") - 1)) * 10

    def score(self, weight: float, density: float) -> float:
        z = self.curve[0] + self.curve[1] * weight + self.curve[2] * density
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        yield b, b.column(b.schema.get_field_index("text")).to_pylist()


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 9000) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of a bounded sample of labelled rows outside the held-out fold, and each label's weight.

    A third of ``max_rows`` at most are toxic and two thirds not, drawn by a hash; a weight is how many rows one stands for.
    A doc_id with several labels counts as toxic if one of them is.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, max_rows * part / max(1, counts.get(y, 0))) for y, part in ((1, 1 / 3), (0, 2 / 3))}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) / 1e6
    sample = known.where(drawn < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).limit(2 * max_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    return rows, {y: 1 / max(s, 1e-9) for y, s in share.items()}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 9000, max_entries: int = 400, max_exceptions: int = 200) -> Lexicon:
    """Lexicon from a bounded sample of labelled rows (``max_rows``): the ``max_entries`` entries of most documents, and
    the ``max_exceptions`` most frequent exception phrases. Without labelled rows of both kinds there is no entry.

    An entry is taken if its documents are toxic far more often than the sample's (likelihood ratio above 30, a tenth as
    frequent among others); of beginnings and words with the same documents the longest is. Words before an entry that
    mark it as harmless make an exception phrase.
    """
    rows, stands_for = training_rows(docs, labels, max_rows)
    rows = rows.repartition(max(2, min(16, rows.sparkSession.sparkContext.defaultParallelism))).persist()
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        rows.unpersist()
        return Lexicon({}, [], (-30.0 if not pos else 30.0, 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches):
            by = (Counter(), Counter())
            for t, y in zip(texts, b.column(b.schema.get_field_index("toxic")).to_pylist(), strict=True):
                by[y].update(entries_of(fold(t)))
            keys = [k for k, n in by[1].items() if n]
            if keys or by[0]:
                rest = [k for k in by[0] if k not in by[1]]
                both = keys + rest
                yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([by[1][k] for k in both], pa.int64()), pa.array([by[0][k] for k in both], pa.int64())], names=["entry", "a", "b"])

    stats = rows.mapInArrow(count, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    share = F.lit(pos / (pos + neg))
    gain = 2 * (a * F.ln((a + 1e-9) / ((a + b) * share)) + b * F.ln((b + 1e-9) / ((a + b) * (1 - share))))
    better = stats.where((a >= 4) & (b / neg <= 0.1 * a / pos)).withColumn("gain", gain).where("gain > 30")
    top = better.orderBy(F.desc("a"), F.desc(F.length("entry")), "entry").limit(10 * max_entries).collect()
    weights: dict[str, float] = {}
    covered: set[tuple[str, int]] = set()  # beginnings of entries, with the entry's documents
    for r in top:
        if len(weights) < max_entries and (r.entry, r.a) not in covered and not any(r.entry[:n] in weights for n in range(4, len(r.entry) + 1)):
            covered |= {(r.entry[:n], r.a) for n in range(4, len(r.entry))}
            weights[r.entry] = math.log((r.a + 0.5) / (pos + 1)) - math.log((r.b + 0.5) / (neg + 1))
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(rows, lexicon, max_exceptions)
    lexicon.curve = _curve(rows, lexicon, stands_for)
    rows.unpersist()
    return lexicon


def _exceptions(rows: DataFrame, lexicon: Lexicon, most: int) -> list[str]:
    """Pairs of a word and an entry after it that are mostly seen in harmless documents."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for b, texts in _texts(batches):
            by = (Counter(), Counter())
            for t, y in zip(texts, b.column(b.schema.get_field_index("toxic")).to_pylist(), strict=True):
                folded = fold(t)
                by[y].update({folded[folded.rfind(" ", 0, s) : e] for s, e, _ in lexicon.hits(auto, folded) if s > 0})
            keys = list(by[0] | by[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()), pa.array([by[0][k] for k in keys], pa.int64())], names=["entry", "a", "b"])

    found = rows.mapInArrow(pairs, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return [r.entry for r in found.where("b >= 5 and b > 4 * a").orderBy(F.desc("b"), "entry").limit(most).collect()]


def _curve(rows: DataFrame, lexicon: Lexicon, stands_for: dict[int, float]) -> tuple[float, ...]:
    """Logistic regression of the label on the two measures, rows weighted by what they stand for."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for b, texts in _texts(batches):
            x = [lexicon.measures(auto, t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("toxic")), pa.array([a for a, _ in x], pa.float64()), pa.array([d for _, d in x], pa.float64())], names=["toxic", "weight", "density"])

    t = rows.mapInArrow(measure, "toxic int, weight double, density double").toPandas().sort_values(["toxic", "weight", "density"])
    x = np.column_stack((np.ones(len(t)), t["weight"], t["density"]))
    y = t["toxic"].to_numpy(float)
    w = np.where(y == 1, stands_for[1], stands_for[0])
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + 1e-2 * np.eye(3) * w.mean()
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-2 * w.mean() * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of each row's whole text, rows that repeat a doc_id among them; null and empty texts get the score
    of a text without entries. An empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for b, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(*lexicon.measures(auto, t)) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def predicted(scored: DataFrame, at: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of scored rows."""
    low: Column = F.col("score") >= at
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", low.cast("int").alias("predicted"))
