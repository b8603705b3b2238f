"""Byte-level BPE by rank arrays: merges of one vocabulary file, applied to many short words at a time.

A word is a row of part ids beside a row of ranks of adjacent parts.  Each step scans every row for its least rank
(the leftmost on a tie), deletes the boundary there, and looks up the two ranks beside the new part; rows without
a known pair leave.  Rows of one width stand in one array, so a step serves thousands of words.  Longer words use
the same rule with a heap of pairs, as scanning them again and again would take the square of their length.

Texts are cut at the file's added tokens first, then by the byte-level split pattern; a match's ids are remembered
by each worker within bounds.  Decoding maps ids to bytes and the bytes to text, bad sequences replaced.

Defined results: a null text counts as empty, which has no tokens; repeated rows give repeated rows; ids and other
columns may be null; a text of any length is encoded whole.  Extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bpe import byte_characters, small_groups

#: Bytes of the longest word that is merged in an array; longer ones use a heap.
SHORT = 48
#: Widths of the arrays.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, SHORT)
#: Words that a worker remembers before it starts anew, and the longest that it remembers, in characters.
MEMO, MEMO_CHARS = 600_000, 64
#: Words of one width merged at a time.
ROWS = 16_384
NO_RANK = np.int32(2**31 - 1)
#: Code points outside these long-settled blocks may be letters in one Unicode version and unassigned in another: texts
#: that hold one are split by the tokenizers library itself, whose classes count.
SETTLED = r"[^\x00-\u0557\u2010-\u2064\u20a0-\u20bf\u3001-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]"


class RankBPE:
    """Encoder and decoder of one vocabulary file (the JSON form of a byte-level BPE without a normalizer)."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        from tokenizers import pre_tokenizers

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{vocabulary} is no plain byte-level BPE")
        vocab: dict[str, int] = model["vocab"]
        chars = byte_characters()
        self.id_of_byte = np.array([vocab[c] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.bits = np.int64(max(1, int(max(vocab.values())).bit_length()))
        pair = np.array([(vocab[a] << int(self.bits)) | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._table(pair)
        self.rank_of = dict(zip(pair.tolist(), range(len(pair)), strict=True))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.plain_split, self.odd = regex.compile(pattern).findall, regex.compile(SETTLED).search
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        back = {c: b for b, c in enumerate(chars)}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of: list[bytes | None] = [None] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.memo: dict[str, bytes] = {}

    def _table(self, pair: np.ndarray) -> None:
        """Ranks by an open hash table: a pair stands within ``reach`` places after its home."""
        self.shift = np.uint64(64 - max(4, (4 * len(pair)).bit_length()))
        size = 1 << int(64 - int(self.shift))
        keys, ranks = [-1] * (size + 64), [int(NO_RANK)] * (size + 64)
        self.reach = 1
        for rank, (key, home) in enumerate(zip(pair.tolist(), self._home(pair).tolist(), strict=True)):
            at = home
            while keys[at] != -1 and keys[at] != key:
                at += 1
            if keys[at] == -1:  # a pair named twice keeps its first rank
                keys[at], ranks[at] = key, rank
                self.reach = max(self.reach, at - home + 1)
        self.keys, self.ranks = np.array(keys, np.int64), np.array(ranks, np.int32)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_RANK for unknown ones and where either is -1 (no part)."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), (left.astype(np.int64) << self.bits) | right)
        home = self._home(key)
        out = np.where(self.keys[home] == key, self.ranks[home], NO_RANK)
        open_ = np.flatnonzero((self.keys[home] != key) & (self.keys[home] != -1))
        for step in range(1, self.reach):
            if not len(open_):
                break
            at = home[open_] + step
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Native 32-bit ids of words of at most SHORT bytes."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for k in range(0, len(rows), ROWS):
                some = rows[k : k + ROWS]
                raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in some.tolist()]), np.uint8).reshape(len(some), width)
                ids = np.where(np.arange(width) < length[some, None], self.id_of_byte[raw], np.int32(-1))
                self._merge_rows(ids, some, out)
        return out

    def _merge_rows(self, ids: np.ndarray, names: np.ndarray, out: list[bytes]) -> None:
        """Merges each row of ``ids`` (parts, then -1) to its end and writes it to ``out`` under its name."""
        m, width = ids.shape
        ranks = np.full((m, width), NO_RANK, np.int32)  # ranks[:, i] is the pair of parts i and i + 1
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, width - 1)
        while len(ids):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(ids))
            least = ranks[rows, at]
            done = least == NO_RANK
            if done.any():
                ended = ids[done]
                n = (ended >= 0).sum(axis=1)
                flat, ends = ended[ended >= 0].tobytes(), np.cumsum(4 * n).tolist()
                for name, a, b in zip(names[done].tolist(), [0, *ends], ends, strict=False):
                    out[name] = flat[a:b]
                going = ~done
                ids, ranks, names, at, least = ids[going], ranks[going], names[going], at[going], least[going]
                if not len(ids):
                    return
                rows = np.arange(len(ids))
            # one boundary is deleted: later parts and ranks move up by a place
            width = ids.shape[1]
            moved = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            new_ranks = np.take_along_axis(ranks, np.arange(width - 1) + (np.arange(width - 1) >= at[:, None]), 1)
            ids = np.take_along_axis(ids, moved, 1)
            ids[rows, at] = self.made[least]
            ranks = new_ranks
            after = np.minimum(at + 1, width - 2)
            beyond = np.where(at + 1 <= width - 2, ids[rows, after], -1)
            ranks[rows, at] = self.rank(ids[rows, at], beyond)
            led = np.flatnonzero(at > 0)
            ranks[led, at[led] - 1] = self.rank(ids[led, at[led] - 1], ids[led, at[led]])

    def merge_long(self, word: bytes) -> bytes:
        """The same merges by a heap of (rank, place), parts linked to their neighbours."""
        ids = self.id_of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, bits, rank_of = len(ids), int(self.bits), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(ids[i] << bits | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the parts has been merged since
            ids[i], ids[j] = int(self.made[rank]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(ids[i] << bits | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank_of.get(ids[h] << bits | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Native 32-bit ids of each word, whatever its length."""
        raw = [w.encode() for w in words]
        out = self.merge_short([w if len(w) <= SHORT else b"" for w in raw])
        for i, w in enumerate(raw):
            if len(w) > SHORT:
                out[i] = self.merge_long(w)
        return out

    def split(self, text: str) -> list[str]:
        """The matches of the split pattern, in order; together they are the text."""
        if self.odd(text) is None:
            return self.plain_split(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (32-bit) of each text."""
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, pieces = self.memo, []
        for t in texts:
            if self.cut is not None and any(x in t for x in self.added):
                words: list[str] = []
                for part in self.cut.split(t):
                    if part in self.added:
                        memo[part] = np.int32(self.added[part]).tobytes()
                        words.append(part)
                    else:
                        words += self.split(part)
                pieces.append(words)
            else:
                pieces.append(self.split(t))
        new = list(set().union(*pieces).difference(memo))
        memo.update(zip(new, self.encode_words(new), strict=True))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, ps)), np.int32) for ps in pieces]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str) -> RankBPE:
    return RankBPE(vocabulary, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``decoded`` string of every row of ``docs``; no shuffle."""
    return _apply(docs, vocabulary, pattern, text_col, keep, lambda c, ids: (ids, c.decode(ids.tolist())), "ids array<int>, decoded string", [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, and the digests of the ids (little-endian, 32 bits) and of the decoded text."""

    def digest(c: RankBPE, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids.tolist()).encode()).hexdigest()

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _apply(docs, vocabulary, pattern, text_col, keep, digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", fields)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text``; null ids decode to an empty text, an id outside the vocabulary is an error."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            texts = [c.decode(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    kept = encoded.select(*keep, F.col(ids_col).alias("__ids"))
    return kept.mapInArrow(fn, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "text string"]))


def _apply(docs: DataFrame, vocabulary: str, pattern: str, text_col: str, keep: tuple[str, ...], make, made: str, fields: list) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            at = 0
            for group in small_groups(b.column(b.num_columns - 1).to_pylist()):
                rows = [make(c, ids) for ids in c.encode(group)]
                head = b.slice(at, len(group))
                columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*head.columns[:-1], *columns], [*b.schema.names[:-1], *(n for n, _ in fields)])
                at += len(group)

    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return kept.mapInArrow(fn, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), made]))
