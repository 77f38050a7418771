"""Language ID with a small convolutional network over bytes, trained in numpy.

A window of ``WINDOW`` bytes passes embeddings, filters of several widths, a rectifier, max pooling over the window and a
softmax. Texts are cut into such windows from end to end, the last one padded, and the windows' probabilities are
averaged by their bytes. At prediction a filter's products with the embeddings of byte pairs are read from tables, so
that a window is a few look-ups per byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the doc_id as text falls into the fold that no training row comes from; a null doc_id does."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == fold, F.lit(True))


@dataclass
class Model:
    """Languages and the network's weights: embeddings, filters by width, and the output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self) -> None:
        self._tables: tuple[np.ndarray, ...] | None = None

    def _look_ups(self) -> tuple[np.ndarray, ...]:
        if self._tables is None:
            part = [[self.embedding @ w[j * DIM : (j + 1) * DIM] for j in range(k)] for k, w in zip(WIDTHS, self.filters, strict=True)]
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
            first = np.concatenate([pair(p[0], p[1]) + b for p, b in zip(part, self.biases, strict=True)], axis=1)
            self._tables = first.astype(np.float32), part[1][2].astype(np.float32), pair(part[2][2], part[2][3]).astype(np.float32)
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, languages) of an (n, WINDOW) array of bytes."""
        first, third, second = self._look_ups()
        pooled = np.empty((len(windows), len(WIDTHS) * FILTERS), dtype=np.float32)
        for i in range(0, len(windows), 64):
            x = windows[i : i + 64].astype(np.int32)
            pair = x[:, :-1] * 256 + x[:, 1:]
            h = first[pair]
            h[:, :-1, FILTERS : 2 * FILTERS] += third[x[:, 2:]]
            h[:, :-2, 2 * FILTERS :] += second[pair[:, 2:]]
            for k in range(len(WIDTHS)):  # filters that stick out of the window don't count
                pooled[i : i + 64, k * FILTERS : (k + 1) * FILTERS] = h[:, : WINDOW - WIDTHS[k] + 1, k * FILTERS : (k + 1) * FILTERS].max(axis=1)
        return _softmax(np.maximum(pooled, 0) @ self.out + self.out_bias)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language of each non-empty text, and its probability."""
        sizes = np.array([len(t) for t in texts])
        n = -(-sizes // WINDOW)
        raw = b"".join(t.lower().ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist(), strict=True))
        p = self.probabilities(np.frombuffer(raw, dtype=np.uint8).reshape(-1, WINDOW))
        weight = np.full(len(p), WINDOW, dtype=np.float64)
        weight[np.cumsum(n) - 1] = sizes - (n - 1) * WINDOW
        whole = np.add.reduceat(p * weight[:, None], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / sizes[:, None]
        return whole.argmax(axis=1), np.clip(whole.max(axis=1), 0, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7, least_steps: int = 500) -> Model:
    """Train on (n, WINDOW) bytes and numbers of languages by Adam on the cross-entropy; few windows take more epochs, for
    ``least_steps`` in all."""
    epochs = max(epochs, -(-least_steps * batch // max(1, len(windows))))
    rng = np.random.default_rng(seed)
    init = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    p = [init(256, DIM, scale=0.5), *(init(w * DIM, FILTERS, scale=(2 / (w * DIM)) ** 0.5) for w in WIDTHS), *(np.zeros(FILTERS, np.float32) for _ in WIDTHS), init(len(WIDTHS) * FILTERS, len(languages), scale=0.1), np.zeros(len(languages), np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    k, step = len(WIDTHS), 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            x, y = windows[at], labels[at]
            e = p[0][x]
            rows = np.arange(len(at))[:, None]
            pooled, where = [], []
            for j, w in enumerate(WIDTHS):
                cols = np.concatenate([e[:, o : WINDOW - w + 1 + o] for o in range(w)], axis=2)
                h = cols @ p[1 + j] + p[1 + k + j]
                top = h.argmax(axis=1)
                where.append((cols[rows, top], top))
                pooled.append(np.take_along_axis(h, top[:, None, :], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1)
            a = np.maximum(z, 0)
            d = _softmax(a @ p[-2] + p[-1])
            d[np.arange(len(at)), y] -= 1
            d /= len(at)
            back = (d @ p[-2].T) * (z > 0)
            g = [np.zeros_like(q) for q in p]
            g[-2], g[-1] = a.T @ d, d.sum(axis=0)
            for j, w in enumerate(WIDTHS):
                b = back[:, j * FILTERS : (j + 1) * FILTERS]
                cols, top = where[j]
                g[1 + j] = np.einsum("bfc,bf->cf", cols, b)
                g[1 + k + j] = b.sum(axis=0)
                de = (b[:, :, None] * p[1 + j].T[None]).reshape(len(at), FILTERS, w, DIM)
                for o in range(w):
                    np.add.at(g[0], x[rows, top + o], de[:, :, o])
            step += 1
            slow = rate * (1 - epoch / epochs)
            for q, gq, mq, vq in zip(p, g, m, v, strict=True):
                mq += 0.1 * (gq - mq)
                vq += 0.001 * (gq * gq - vq)
                q -= slow * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.999**step)) + 1e-8)
    return Model(languages, p[0], p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[-2], p[-1])


def train(docs: DataFrame, max_windows: int = 12_000, per_document: int = 4, max_languages: int = 200) -> Model | None:
    """A model of the languages of ``docs``, from rows with text and lang outside the held-out fold.

    The sample is bounded: about ``max_windows`` windows in all, as many of each language, ``per_document`` at most of a
    document, from places in the whole text drawn by a hash; the ``max_languages`` most frequent languages are learned.
    None without training rows.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).where(F.col("text").cast("string").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("lang").cast("string")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not counts:
        return None
    each = max(20, max_windows // (len(counts) * per_document))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    rows = rows.where(drawn < F.try_element_at(share, F.col("lang").cast("string")))
    n = F.length("text")
    place = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(n - WINDOW, F.lit(0)) + 1).cast("int") + 1
    window = F.explode(F.array_distinct(F.array(*[F.substring(F.col("text").cast("string"), place(i), F.lit(WINDOW)) for i in range(per_document)])))
    sample = rows.select(F.col("lang").cast("string").alias("lang"), window.alias("w")).limit(4 * max_windows).toPandas().sort_values(["lang", "w"])
    languages = sorted(set(sample["lang"]))
    if not languages:
        return None
    raw = b"".join(w.encode().lower()[:WINDOW].ljust(WINDOW, b"\0") for w in sample["w"])
    labels = np.searchsorted(languages, sample["lang"].tolist())
    return fit(np.frombuffer(raw, dtype=np.uint8).reshape(-1, WINDOW), labels, languages)


def has_letter(text: bytes) -> bool:
    """Whether a UTF-8 text has a letter of any script."""
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode())


def _judged(rows: DataFrame, model: Model | None, chunk: int = 1 << 20) -> DataFrame:
    """(carry, lang_pred, score) of rows (carry, text), carry being any column; without ``text``, that of the struct carry."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = (b.column(1) if b.num_columns > 1 else b.column(0).field("text")).cast(pa.binary())
            pred, score = ["und"] * b.num_rows, [0.0] * b.num_rows

            def flush(group: list[tuple[int, bytes]]) -> None:
                if group:
                    for (i, _), k, s in zip(group, *model.predict([t for _, t in group]), strict=True):
                        pred[i], score[i] = model.languages[k], float(s)  # noqa: B023

            group, size = [], 0
            for i, x in enumerate(texts if model else []):
                t = x.as_py()
                if t and has_letter(t):
                    group.append((i, t))
                    size += len(t)
                    if size > chunk:
                        flush(group)
                        group, size = [], 0
            flush(group)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["carry", "lang_pred", "score"])

    out = StructType([rows.schema["carry"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, out)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text, rows that repeat a doc_id among them.

    ``und`` with score 0 where the text is null or has no letter, or where there is no model. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("carry"), F.col("text").cast("string").alias("text"))
    return _judged(rows, model).withColumnRenamed("carry", "doc_id")


def identify(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, by a model trained on its labelled rows."""
    found = predict(docs, train(docs, **options))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """``docs`` without rows whose text is in no language: ``und``, or no language with a probability of ``least``.

    Rows are judged by their texts alone, those without doc_id or with a repeated one too, and need no join. Without a
    column lang, or without labelled rows to learn from, only texts that are null or have no letter go.
    """
    model = train(docs) if "lang" in docs.columns else None
    if model is None:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    found = _judged(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("carry")), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("carry.*")
