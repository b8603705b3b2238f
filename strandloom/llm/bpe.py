"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

Every match of the vocabulary's split pattern is encoded by itself, so a match's ids are looked up in a
bounded per-worker memo and only unseen matches go to the library, a batch at a time.  Decoding maps ids back
to bytes through the inverse of the byte-to-character table that byte-level vocabularies are written in; a
character whose bytes are split over tokens comes back whole because bytes, not characters, are joined.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows give repeated rows;
a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import texts_of

#: Entries that a worker's memo of encoded matches may hold before it starts anew.
MEMO = 400_000
#: Longer matches are encoded but not remembered.
MEMO_CHARS = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the rest take
    the code points from 256 on, in order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Codec:
    """One worker's tokenizer, its memo, and its table of bytes by id."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already share the cores

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}  # native unsigned 32-bit ids
        back = {c: b for b, c in enumerate(byte_characters())}
        special = set(self.tokenizer.get_added_tokens_decoder())
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = token.encode() if i in special else bytes(back[c] for c in token)
        self.byte_length = np.fromiter(map(len, self.bytes_of), np.int64, size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        pieces = [self.split(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        new = list(set().union(*pieces).difference(memo))
        long: list[str] = []
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                memo[p] = array("I", e.ids).tobytes()
                if len(p) > MEMO_CHARS:
                    long.append(p)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, ps)), np.uint32) for ps in pieces]
        for p in long:
            del memo[p]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def character_spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the end of its last one; a token that begins inside a character
        starts at that character."""
        ends = np.cumsum(self.byte_length[ids])
        starts = ends - self.byte_length[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return starts, ends
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char_of[starts], char_of[ends - 1] + 1


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def small_groups(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters together, so that a batch of long texts stays in bounds."""
    group, size = [], 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > chars:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<bigint>, and ``decoded`` binary of every row of ``docs``; no shuffle."""
    ids_and_bytes = _over_batches(vocabulary, pattern, lambda c, t, ids: (ids.astype(np.int64), c.decode(ids.tolist())), [("ids", pa.list_(pa.int64())), ("decoded", pa.binary())])
    return _apply(docs, text_col, keep, ids_and_bytes, "ids array<bigint>, decoded binary")


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, the digests of the ids (little-endian, 32 bits) and of the decoded bytes, and
    the ids themselves (array<int>) if asked for."""

    def digest(c: Codec, text: str, ids: np.ndarray) -> tuple:
        out = len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids.tolist())).hexdigest()
        return (*out, ids.astype(np.int32)) if with_ids else out

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]
    fn = _over_batches(vocabulary, pattern, digest, fields)
    return _apply(docs, text_col, keep, fn, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``decoded`` binary, and ``text``: the bytes as UTF-8, bad sequences replaced.
    Null ids decode to no bytes; an id outside the vocabulary is an error."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            raw = [c.decode(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], [*b.schema.names[:-1], "decoded", "text"])

    kept = encoded.select(*keep, F.col(ids_col).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "decoded binary, text string"])
    return kept.mapInArrow(fn, schema)


def _over_batches(vocabulary: str, pattern: str, make, fields):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        names = [n for n, _ in fields]
        for b in batches:
            at = 0
            for group in small_groups(texts_of(b.column(b.num_columns - 1))):
                rows = [make(c, t, ids) for t, ids in zip(group, c.encode(group), strict=True)]
                made = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
                head = b.slice(at, len(group))
                yield pa.RecordBatch.from_arrays([*head.columns[:-1], *made], [*b.schema.names[:-1], *names])
                at += len(group)

    return fn


def _apply(docs: DataFrame, text_col: str | Column, keep: tuple[str, ...], fn, made: str) -> DataFrame:
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), made])
    return kept.mapInArrow(fn, schema)
