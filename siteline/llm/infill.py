"""Fill-in-middle form of texts: cut points found in a compressed set of boundaries, then prefix, suffix and middle reordered.

A text's unit boundaries (offsets in code points after each unit) are kept as a Roaring-style set: a container for each
stretch of 2^16 offsets that holds one, of the smallest of three kinds (sorted array, bitmap, runs), with the number of
boundaries up to its end. The k-th boundary is found by a binary search for its container and a select inside it. Only
counts and cut offsets leave Python; the texts are cut and joined by Spark's own functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets of a container, and the size from which an array takes more room than a bitmap.
SPAN, ARRAY_MOST = 1 << 16, 4096
#: Marks of the prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Types of the columns that ``transform`` adds.
COLUMNS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


class Array:
    """Offsets of a container as sorted 16-bit numbers."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """Offsets of a container as bits, with the count of bits up to each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.up_to = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.up_to, k, side="right"))
        before = int(self.up_to[w - 1]) if w else 0
        inside = np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little")
        return w * 64 + int(np.flatnonzero(inside)[k - before])


class Runs:
    """Offsets of a container as first offsets and lengths of runs, with the count up to the end of each."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first, self.up_to = first.astype(np.uint16), np.cumsum(length, dtype=np.int64)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.up_to, k, side="right"))
        return int(self.first[r]) + k - (int(self.up_to[r - 1]) if r else 0)


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of ascending offsets below ``SPAN``: 2 bytes an offset, 8 KiB of bits, or 4 bytes a run."""
    starts = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    if 4 * len(starts) < min(2 * len(low), SPAN // 8):
        return Runs(low[starts], np.diff(starts, append=len(low)))
    return Array(low) if len(low) <= ARRAY_MOST else Bitmap(low)


class BoundarySet:
    """Ascending offsets by container; ``up_to[i]`` counts the offsets of containers 0 to i."""

    def __init__(self, chunks: Iterator[np.ndarray]):
        self.keys: list[int] = []
        self.containers: list[Array | Bitmap | Runs] = []
        counts: list[int] = []
        for key, low in enumerate(chunks):
            if len(low):
                self.keys.append(key)
                self.containers.append(container(low))
                counts.append(len(low))
        self.up_to = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.up_to[-1]) if len(self.up_to) else 0

    def select(self, k: int) -> int:
        """The k-th offset, k from 0."""
        i = int(np.searchsorted(self.up_to, k, side="right"))
        before = int(self.up_to[i - 1]) if i else 0
        return self.keys[i] * SPAN + self.containers[i].select(k - before)


def _blank(points: np.ndarray) -> np.ndarray:
    return (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))


def _word_ends(points: np.ndarray, follows: int | None) -> np.ndarray:
    """Whether a word with its leading white space, or the white space at the end of the text, ends after each point."""
    blank = _blank(points)
    after = np.append(blank[1:], True if follows is None else _blank(np.array([follows]))[0])
    ends = ~blank & after
    if follows is None:
        ends[-1] = True
    return ends


def _line_ends(points: np.ndarray, follows: int | None) -> np.ndarray:
    ends = points == 0x0A
    if follows is None:
        ends[-1] = True
    return ends


def _char_ends(points: np.ndarray, follows: int | None) -> np.ndarray:
    return np.ones(len(points), dtype=bool)


#: Units that a text is cut into: where one ends, by the points of a stretch and the point that follows it.
UNITS: dict[str, Callable[[np.ndarray, int | None], np.ndarray]] = {"words": _word_ends, "lines": _line_ends, "chars": _char_ends}


def boundaries(text: str, units: str = "words") -> BoundarySet:
    """Offsets after each unit of a text, in code points; they go from 1 to the text's length, which is one of them.

    A text is read in stretches of ``SPAN`` offsets, so beside the text only one stretch is held as numbers.
    """
    ends = UNITS[units]

    def chunks() -> Iterator[np.ndarray]:
        n = len(text)
        for end in range(SPAN - 1, n + SPAN, SPAN):  # offset o, after point o - 1, belongs to container o >> 16
            at, to = max(0, end - SPAN), min(n, end)
            if at >= to:
                return
            points = np.frombuffer(text[at:to].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            follows = ord(text[to]) if to < n else None
            yield (np.flatnonzero(ends(points, follows)) + at + 1) % SPAN

    return BoundarySet(chunks())


def cut_offsets(text: str, first: int, second: int, units: str = "words") -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle) of a text; first and second are taken modulo n + 1, the smaller count
    of units ends the prefix."""
    found = boundaries(text, units)
    n = len(found)
    lo, hi = sorted((first % (n + 1), second % (n + 1)))
    return n, found.select(lo - 1) if lo else 0, found.select(hi - 1) if hi else 0


def _cutter(units: str) -> Callable:
    @F.pandas_udf("n long, lo long, hi long")
    def cuts(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, first, second in rows:
            yield pd.DataFrame([cut_offsets(t, a, b, units) for t, a, b in zip(texts, first, second, strict=True)], columns=["n", "lo", "hi"])

    return cuts


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, units: str = "words") -> DataFrame:
    """The rows of ``docs`` with n (units of the text), form, prefix_chars, middle_chars and output.

    ``fim_percent`` of the texts are reordered, ``spm_percent`` of these as suffix, prefix, middle (``spm``), the others as
    prefix, suffix, middle (``psm``); draws come from the SHA-256 of seed and doc_id, so reruns agree and rows that repeat a
    doc_id draw alike. A text stays whole (``plain``, lengths null) if it is empty or null (n = 0, output ''), or if it
    holds one of the marks. A null doc_id draws as an empty one. Columns of ``docs`` named like the new ones are replaced. An
    empty table gives none. ``units``: words with the white space before them, lines, or chars.
    """
    text = F.coalesce(F.col("_in.text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_in.doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("_hex", 1 + 8 * i, 8), 16, 10).cast("long")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_in")).select("_in", text.alias("_text"), digest.alias("_hex"))
    rows = rows.withColumn("_cut", _cutter(units)("_text", draw(0), draw(1)))
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    plain = (F.col("_text") == "") | marked | (draw(2) % 100 >= fim_percent)
    lo, hi = F.col("_cut.lo"), F.col("_cut.hi")
    part = lambda a, b: F.substring("_text", (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = part(F.lit(0), lo), part(lo, hi), part(hi, F.char_length("_text"))
    whole = {
        "plain": F.col("_text"),
        "psm": F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle),
        "spm": F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle),
    }
    rows = rows.withColumn("form", F.when(plain, "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    output = F.when(~cut, whole["plain"]).when(F.col("form") == "psm", whole["psm"]).otherwise(whole["spm"])
    new = {"n": F.col("_cut.n"), "form": F.col("form"), "prefix_chars": F.when(cut, lo), "middle_chars": F.when(cut, hi - lo), "output": output}
    return rows.select(*(F.col(f"_in.`{c}`") for c in docs.columns if c not in new), *(v.cast(COLUMNS[c]).alias(c) for c, v in new.items()))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from: its marks are the first of their kind, as no text with a
    mark is reordered."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
    back = lambda prefix, middle, suffix: F.concat(parts[prefix], parts[middle], parts[suffix])
    return F.when(form == "psm", back(1, 3, 2)).when(form == "spm", back(2, 3, 1)).otherwise(output)


def digest(infilled: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``transform``'s rows."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return infilled.select(F.col("doc_id").cast("long"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
