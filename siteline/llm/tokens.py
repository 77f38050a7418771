"""Token counts by a public tokenizer's library, in Arrow batches that return lengths only.

With a tokenizer that takes words apart as ``WORD_SPLIT`` does, a text is split at ASCII white space, which is dropped
and no token crosses, and a long piece of it where an ASCII digit stands beside another or a letter; so the counts of the
pieces add up. Each piece is encoded once per worker and remembered by its bytes, within ``MEMO`` pieces; the library is
called on the pieces not seen before, in batches of about ``BATCH_BYTES``. With any other tokenizer texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
MEMO = 1_000_000
LONG_PIECE = 64
#: Fixed value: the pattern of the pre-tokenizer that the splits here are safe for.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Longer pieces are split further, between an ASCII digit and an ASCII digit or letter: a digit is a token of its own.
SPLIT_OVER = 4096
_SAFE = re.compile(rb"(?<=[A-Za-z0-9])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Marks that the tokenizer never joins to a letter or digit of ASCII before them; the apostrophe is not one of them.
_TAIL = re.compile(rb"([A-Za-z0-9\x80-\xff]*[A-Za-z0-9])([.,;:!?]+)")


class Counter:
    """Counts tokens of byte strings with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo = {b"": 0}
        self.in_words = False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            own = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(e) for e in own.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        first = next(iter((json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
        self.in_words = (first.get("pattern") or {}).get("Regex") == WORD_SPLIT and first.get("behavior") == "Removed" and first.get("invert") is True

    def encode(self, pieces: list[bytes]) -> list[int]:
        out, batch, size = [], [], 0
        for p in [*pieces, None]:
            if p is None or size > BATCH_BYTES:
                out += self.lengths(batch) if batch else []
                batch, size = [], 0
            if p is not None:
                batch.append(p.decode())
                size += len(p)
        return out

    def look_up(self, pieces: set[bytes]) -> dict[bytes, int]:
        """Counts of new pieces; a piece that ends in marks is the sum of its word and the marks."""
        tails = {p: (m[1], m[2]) for p in pieces if len(p) <= LONG_PIECE and (m := _TAIL.fullmatch(p))}
        plain = list({x for p in pieces for x in tails.get(p, (p,))} - self.memo.keys())
        found = dict(zip(plain, self.encode(plain), strict=True))
        for p, parts in tails.items():
            found[p] = sum(found[x] if x in found else self.memo[x] for x in parts)
        return found

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.in_words:
            return self.encode(texts)
        split = [[y for p in t.split() for y in ((p,) if len(p) <= SPLIT_OVER else _SAFE.split(p))] for t in texts]
        memo = self.memo
        found = self.look_up({p for pieces in split for p in pieces if p not in memo})
        if len(memo) < MEMO:
            memo.update((p, n) for p, n in found.items() if len(p) <= LONG_PIECE)
        return [sum(memo[p] if p in memo else found[p] for p in pieces) for pieces in split]


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, rows that repeat a doc_id among them.

    ``tokenizer``: a file of the tokenizers library (.json) or of sentencepiece (.model). Null texts count as empty (0
    bytes, 0 tokens); an empty table gives none. A run of letters without white space or digits is encoded in one piece. Special strings inside a text are single tokens, as the library has
    them by default; they hold no white space, so no split cuts them. ``path`` overrides the file's place.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, Counter(path)) if path not in _counters else _counters[path]
        for b in batches:
            texts, n_tokens, group, size = b.column(1).cast(pa.binary()), [], [], 0
            for x in texts:  # groups of bounded size, whatever the rows of a batch hold
                t = x.as_py() or b""
                group.append(t)
                size += len(t)
                if size > 8 * BATCH_BYTES:
                    n_tokens += counter.count(group)
                    group, size = [], 0
            n_tokens += counter.count(group)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes")).alias("doc_id"), text.alias("text"))
    out = rows.mapInArrow(run, "doc_id struct<doc_id:long,n_bytes:long>, n_tokens long")
    return out.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
