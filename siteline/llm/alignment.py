"""Alignment of two tokenizers over the same texts: which ids of one stand where ids of the other do.

Both tokenizers encode a text apart from one another at spaces after other characters, so a text is a row of pieces that
each align on their own; a worker aligns a piece once and remembers it. Where one token of A and one of B cover the same
bytes and B's id is the one that a table made beforehand names for A's id (the identity map), the pair is counted by A's id
in a vector as long as A's vocabulary. Only the other pairs are counted by a shuffle: first by block of documents, then over
all. A block asks for the counts of its own different pairs and is scored with its documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteline.llm.common import cut, shared_folder

#: Characters of a block of documents, pieces that a worker remembers, and characters of a run that is encoded at once.
BLOCK, MEMO, RUN = 2 << 20, 200_000, 1 << 14
#: Pieces are cut before a space that follows another character; neither tokenizer has a token over such a place.
_CUT, _UNSAFE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_EMPTY = np.empty(0, dtype=np.int64)
_DOC = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())])
_ENCODED = f"block long, doc {_DOC.simpleString()}, same array<int>, same_n array<int>, pair array<long>, pair_n array<int>, ids array<long>, docs array<long>, identical boolean"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes of Latin-1 stand for themselves, the
    others, in ascending order, for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.own.encode_special_tokens = True
        symbols, vocabulary = byte_of_symbol(), self.own.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_of[i] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()
        made = json.loads(self.own.to_str())
        pre = made.get("pre_tokenizer") or {}
        #: Splits by the library's own pattern and changes nothing, so the cuts of ``_CUT`` are safe.
        self.separable = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it adds the space that texts are taken to begin with."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        entries = [self.own.id_to_piece(i) for i in range(self.own.vocab_size())]
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in entries]
        self.space = [self.own.piece_to_id("▁")]
        odd = "ﬁ ①  ｱ\t x "
        self.separable = not any(re.search("[^▁]▁", p) for p in entries) and self.own.normalize(odd) == "▁" + odd.replace(" ", "▁")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        # the space before the end of a text is a piece of its own; the library adds none to an empty text
        return [ids or self.space for ids in self.own.encode([p[1:] for p in pieces], num_threads=1)]


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each id of A the id of B with the same bytes, -1 without one; of several the last, as the entries of single bytes
    come first in a vocabulary and texts use the ordinary ones."""
    ids = {t: i for i, t in enumerate(b) if t}
    return np.array([ids.get(t, -1) if t else -1 for t in a], dtype=np.int64)


class Aligner:
    """Aligns pieces of text and remembers them; both tokenizers and the identity map are loaded once per worker.

    A piece is named without the space it begins with. ``rows`` has its number in the table: ``sizes`` (tokens of A, of B,
    groups, links), ``groups`` (the groups as text; None where the tokens' bytes don't join to the piece), and its links,
    ``same`` (A ids of identity pairs) and ``pairs`` (a * size of B's vocabulary + b), from ``same_at`` and ``pairs_at`` on.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.separable = self.a.separable and self.b.separable
        self.b_of_a = identity_map(self.a.bytes_of, self.b.bytes_of)
        self.length_a, self.length_b = (np.array([len(t) for t in x.bytes_of], dtype=np.int64) for x in (self.a, self.b))
        self.names_a, self.names_b = ([str(i) for i in range(len(x.bytes_of))] for x in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.sizes = np.empty((0, 4), dtype=np.int64)
        self.same, self.pairs, self.same_at, self.pairs_at = _EMPTY, _EMPTY, np.zeros(1, np.int64), np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        """The pieces of space+text, each without its first space."""
        if not self.separable:
            return [text]
        if _UNSAFE.search(text) or text[:1] == " ":
            return [p[1:] for p in _CUT.split(" " + text)]
        return text.split(" ")

    def learn(self, pieces: list[str]) -> None:
        """Put new pieces in the table. They are encoded in runs, in which pieces follow each other as they do in texts."""
        runs: list[list[str]] = []
        size = RUN
        for p in sorted(pieces, key=lambda p: not p or p[-1].isspace()):
            if size >= RUN or not p or p[-1].isspace() or not self.separable:
                runs.append([])
                size = 0
            runs[-1].append(p)
            size += len(p) + 1
        todo = list(zip(runs, *self._encoded(runs), strict=True))
        odd = [[p] for run, a, _ in todo if a is None for p in run]  # bytes that don't join: which piece is it?
        todo = [x for x in todo if x[1] is not None] + list(zip(odd, *self._encoded(odd), strict=True))
        for run, _, _ in (x for x in todo if x[1] is None):
            self.rows[run[0]] = len(self.groups)
            self.groups.append(None)
        bad = len(self.groups) - len(self.sizes)
        self._append(np.zeros((bad, 4), np.int64), _EMPTY, np.zeros(bad, np.int64), _EMPTY, np.zeros(bad, np.int64))
        fine = [x for x in todo if x[1] is not None]
        if fine:
            self._aligned([p for run, _, _ in fine for p in run], *(np.fromiter(chain.from_iterable(x[k] for x in fine), dtype=np.int64) for k in (1, 2)))

    def _encoded(self, runs: list[list[str]]) -> tuple[list, list]:
        """Ids of both tokenizers for each run, None where their bytes don't join to it."""
        texts = [" " + " ".join(run) for run in runs]
        a, b = (x.encode(texts) if texts else [] for x in (self.a, self.b))
        for k, t in enumerate(texts):
            whole = t.encode()
            if any(b"".join(map(x.bytes_of.__getitem__, ids)) != whole for x, ids in ((self.a, a[k]), (self.b, b[k]))):
                a[k] = b[k] = None
        return a, b

    def _aligned(self, pieces: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Each place where a token of either ends is the end of one link; where both end, a group ends."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.union1d(end_a, end_b)
        link_a, link_b = a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)]
        both = end_a[np.isin(end_a, end_b, assume_unique=True)]
        of_piece = np.cumsum([len(p.encode()) + 1 for p in pieces])
        same = self.b_of_a[link_a] == link_b
        upto = [np.append(0, np.searchsorted(x, of_piece, side="right")) for x in (end_a, end_b, both, ends)]
        until_a, until_b = (np.append(0, np.searchsorted(x, both, side="right")).tolist() for x in (end_a, end_b))
        names_a, names_b = [self.names_a[i] for i in a.tolist()], [self.names_b[i] for i in b.tolist()]
        made = [f"{names_a[i]}|{names_b[k]}" if j == i + 1 and m == k + 1 else f"{','.join(names_a[i:j])}|{','.join(names_b[k:m])}" for i, j, k, m in zip(until_a, until_a[1:], until_b, until_b[1:])]
        first = upto[2].tolist()
        for p, i, j in zip(pieces, first, first[1:]):
            self.rows[p] = len(self.groups)
            self.groups.append(made[i] if j == i + 1 else ";".join(made[i:j]))
        n_same = np.diff(np.append(0, np.cumsum(same))[upto[3]])
        sizes = np.stack([np.diff(x) for x in upto], axis=1)
        self._append(sizes, link_a[same], n_same, (link_a * len(self.b.bytes_of) + link_b)[~same], sizes[:, 3] - n_same)

    def _append(self, sizes: np.ndarray, same: np.ndarray, n_same: np.ndarray, pairs: np.ndarray, n_pairs: np.ndarray) -> None:
        self.sizes = np.concatenate((self.sizes, sizes))
        self.same, self.pairs = np.concatenate((self.same, same)), np.concatenate((self.pairs, pairs))
        self.same_at = np.concatenate((self.same_at, self.same_at[-1] + np.cumsum(n_same)))
        self.pairs_at = np.concatenate((self.pairs_at, self.pairs_at[-1] + np.cumsum(n_pairs)))

    def numbers(self, pieces: list[list[str]]) -> np.ndarray:
        """Rows in the table of all pieces, those not yet there learnt first."""
        if len(self.rows) > MEMO or len(self.pairs) + len(self.same) > 8 * MEMO:
            self.forget()
        new = set(chain.from_iterable(pieces)) - self.rows.keys()
        if new:
            self.learn(list(new))
        return np.fromiter(map(self.rows.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=sum(map(len, pieces)))


_aligners: dict[tuple[str, str], Aligner] = {}


def _spread(flat: np.ndarray, at: np.ndarray, which: np.ndarray, times: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, value, n) of the different values below ``most`` that each owner's stretches of ``flat`` hold, each taken
    ``times`` over."""
    many = at[which + 1] - at[which]
    where = np.repeat(at[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    keys, n = np.repeat(owner, many) * most + flat[where], np.repeat(times, many)
    if not len(keys):
        return _EMPTY, _EMPTY, _EMPTY
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return *np.divmod(keys[first], most), np.add.reduceat(n, first)


def _lists(owner: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), pa.array(values, kind))


def align_block(aligner: Aligner, texts: list[str]) -> tuple[dict[str, list], tuple, tuple]:
    """Columns of ``_DOC`` but doc_id for each text, and (text, A id, n) and (text, pair, n) of its links."""
    pieces = [aligner.split(t) if t else [] for t in texts]
    what = aligner.numbers(pieces)
    groups = aligner.groups
    ends = np.cumsum([len(p) for p in pieces], dtype=np.int64) if pieces else _EMPTY
    who = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    odd = {i for i, g in enumerate(groups) if g is None}
    if odd:
        bad = np.unique(who[np.isin(what, list(odd))])
        keep = ~np.isin(who, bad)
        who, what = who[keep], what[keep]
        ends = np.searchsorted(who, np.arange(len(texts)), side="right")
    sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(aligner.sizes[what], axis=0)))
    sums = sums[ends] - sums[np.append(0, ends[:-1])] if len(ends) else sums[:0]
    docs = {c: sums[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    numbers, bounds = what.tolist(), [0, *ends.tolist()]
    docs["groups_sha256"] = [hashlib.sha256(";".join([groups[x] for x in numbers[i:j]]).encode()).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])]
    keys, times = np.unique(who * max(len(groups), 1) + what, return_counts=True)
    who, what = np.divmod(keys, max(len(groups), 1))
    sizes = len(aligner.a.bytes_of), len(aligner.a.bytes_of) * len(aligner.b.bytes_of)
    return docs, _spread(aligner.same, aligner.same_at, what, times, who, sizes[0]), _spread(aligner.pairs, aligner.pairs_at, what, times, who, sizes[1])


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of three kinds: a document (block, doc, its links by A id and by pair), the pairs of a block with the number of
    its documents that hold each (block, ids, docs), and a task's identity counts (ids, docs, identical)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (path_a, path_b)
        aligner = _aligners[key] if key in _aligners else _aligners.setdefault(key, Aligner(path_a, path_b))
        schema = pa.schema([("block", pa.int64()), ("doc", pa.struct([(f.name, pa.string() if f.name == "groups_sha256" else pa.int64()) for f in _DOC])), ("same", pa.list_(pa.int32())), ("same_n", pa.list_(pa.int32())), ("pair", pa.list_(pa.int64())), ("pair_n", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("identical", pa.bool_())])
        vector = np.zeros(len(aligner.b_of_a), dtype=np.int64)
        block = TaskContext.get().partitionId() << 32

        def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def one(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal block
            columns, (who, a, n), (p_who, pair, p_n) = align_block(aligner, texts)
            np.add.at(vector, a, 1)
            doc = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), *(pa.array(columns[f.name], schema.field("doc").type.field(f.name).type) for f in _DOC.fields[1:])], fields=list(schema.field("doc").type))
            rows = len(ids)
            here = pa.array(np.full(rows, block), pa.int64())
            yield batch(rows, block=here, doc=doc, same=_lists(who, a, rows, pa.int32()), same_n=_lists(who, n, rows, pa.int32()), pair=_lists(p_who, pair, rows, pa.int64()), pair_n=_lists(p_who, p_n, rows, pa.int32()))
            ids_of, count = np.unique(pair, return_counts=True)
            yield batch(1, block=here[:1], ids=pa.array([ids_of], pa.list_(pa.int64())), docs=pa.array([count], pa.list_(pa.int64())), identical=pa.array([False]))
            block += 1

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                ids.append(i)
                texts.append(t)
                size += len(t) + 64
                if size > BLOCK:
                    yield from one(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from one(ids, texts)
        some = np.flatnonzero(vector)
        yield batch(1, ids=pa.array([some], pa.list_(pa.int64())), docs=pa.array([vector[some]], pa.list_(pa.int64())), identical=pa.array([True]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ENCODED)


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/alignment-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def align(docs: DataFrame, tokenizer_a: str = "byte_bpe_50k.json", tokenizer_b: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, rows that repeat a doc_id or
    have none among them.

    A (.json, byte-level) encodes space+text, B (.model) the text, to which it adds the space itself. Byte offsets where
    tokens of both end cut a text into groups; a link is two tokens, one of each, that share a byte. The count of a pair of
    ids is the number of rows that hold it linked. n_best: links whose count is the highest of their A id; count_sum: sum of
    the links' counts. Null and empty texts, and those whose tokens don't join to space+text, have no tokens: zeros and an
    empty string. An empty table gives none. ``folder`` holds the tokenizers' files; by default the public ones.
    """
    if folder is None:
        import public_tokenizers

        path_a, path_b = public_tokenizers.path(tokenizer_a), public_tokenizers.path(tokenizer_b)
    else:
        path_a, path_b = f"{folder}/{tokenizer_a}", f"{folder}/{tokenizer_b}"
    rows = _written(docs.sparkSession, encoded(docs, path_a, path_b))
    return _scored(rows, len(ByteLevel(path_a).bytes_of), len(Pieces(path_b).bytes_of))


def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n) of the identity pairs, by A's id, and (id, n) of the others, by pair, over all documents."""
    one = rows.where("identical is not null").select("identical", F.explode(F.arrays_zip("ids", "docs")).alias("x")).select("identical", F.col("x.ids").alias("id"), F.col("x.docs").alias("n"))
    same, other = (one.where(some).groupBy("id").agg(F.sum("n").alias("n")) for some in ("identical", "not identical"))
    return same, other


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    """Rows (id, n) as a vector; there is one for each id of a vocabulary at most."""
    t, out = rows.toArrow(), np.zeros(size, dtype=np.int64)
    out[t.column("id").to_numpy()] = t.column("n").to_numpy()
    return out


def _scored(rows: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """The documents of ``encoded`` with n_best and count_sum."""
    same, other = counted(rows)
    other = cut(other)
    by_a = _vector(same, size_a)
    best = np.maximum(by_a, _vector(other.groupBy(F.floor(F.col("id") / size_b).cast("long").alias("id")).agg(F.max("n").alias("n")), size_a))
    vectors = rows.sparkSession.sparkContext.broadcast((by_a, best))
    asked = rows.where("identical = false").select(F.col("block").alias("of"), F.explode("ids").alias("id")).join(other, "id")
    docs = rows.where("doc is not null").select("block", "doc", "same", "same_n", "pair", "pair_n")
    names = [f.name for f in _DOC]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        by_a, best = vectors.value
        left = left.combine_chunks()
        ids, n = right.column("id").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        n_best, count_sum = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for links, times in (("same", "same_n"), ("pair", "pair_n")):
            column = left.column(links).combine_chunks()
            at = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
            value, times = (x.flatten().to_numpy().astype(np.int64) for x in (column, left.column(times).combine_chunks()))
            count = by_a[value] if links == "same" else n[np.searchsorted(ids, value)]
            highest = count == best[value if links == "same" else value // size_b]
            for out, x in ((n_best, times * highest), (count_sum, times * count)):
                upto = np.append(0, np.cumsum(x))
                out += upto[at[1:]] - upto[at[:-1]]
        doc = left.column("doc").combine_chunks()
        made = {name: doc.field(name) for name in names} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table({c: made[c] for c in (*names[:-1], "n_best", "count_sum", names[-1])})

    return docs.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(score, _RESULT)
