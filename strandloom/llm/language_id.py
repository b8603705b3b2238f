"""Language identification by prediction by partial matching.

Each language has a byte context tree of order 3 (contexts of three bytes down to none) with frozen counts.
The code length of a text in a language is the sum over its bytes of -log2 of the byte's probability: the
longest context that the tree has seen is tried first; a byte unseen there costs that context's escape
probability (method C: distinct successors / (occurrences + distinct successors)) and moves to the context
shorter by one byte, down to a uniform law over 256 bytes.  The language with the shortest code is predicted.

Counting is one Spark aggregation of 4-byte grams by language over a bounded sample of labelled texts (at most
about ``per_language`` texts of each, picked by a hash of the text); shorter orders are its marginals.  The
tables that tasks look up are as large as the sample's distinct grams, whatever the corpus holds.

Defined results: a null text or one without a letter is ``und`` with score 0; without any learned language
every text is; equal code lengths go to the first language in code point order; repeated rows get equal rows;
null labels are not learned from.  Texts are lower-cased and read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = b"\0\0\0"


@dataclass
class ContextTrees:
    """Code lengths in bits, one column a language, ready for lookup by gram."""

    languages: list[str]
    codes4: np.ndarray  # sorted 4-byte grams seen in any language
    cost4: np.ndarray
    codes3: np.ndarray  # sorted 3-byte grams seen in any language
    cost3: np.ndarray
    contexts3: np.ndarray  # sorted 3-byte contexts seen in any language
    escape3: np.ndarray
    escape2: np.ndarray  # by 2-byte context
    cost2: np.ndarray  # by 2-byte gram

    def lower(self, gram: np.ndarray) -> np.ndarray:
        """Cost of the last byte of 4-byte grams that were never seen: escapes from the full context."""
        out = self.cost3_of(gram & 0xFFFFFF)
        at, seen = find(self.contexts3, gram >> 8)
        out[seen] += self.escape3[at[seen]]
        return out

    def cost3_of(self, gram: np.ndarray) -> np.ndarray:
        at, seen = find(self.codes3, gram)
        out = np.empty((len(gram), len(self.languages)), np.float32)
        out[seen] = self.cost3[at[seen]]
        rest = gram[~seen]
        out[~seen] = self.escape2[rest >> 8] + self.cost2[rest & 0xFFFF]
        return out

    def bits(self, texts: list[bytes], chunk: int = 1 << 20) -> np.ndarray:
        """Code length of each text (row) in each language (column)."""
        out = np.zeros((len(texts), len(self.languages)))
        for t0, t1, part in _chunks(texts, chunk):
            raw = np.frombuffer(part, np.uint8).astype(np.uint32)
            gram = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
            at, seen = find(self.codes4, gram)
            cost = self.cost4[at] if len(self.codes4) else np.zeros((len(gram), len(self.languages)), np.float32)
            miss = np.flatnonzero(~seen)
            cost[miss] = self.lower(gram[miss])
            if t1 - t0 == 1:
                out[t0] += cost.sum(0, dtype=float)
                continue
            sizes = np.array([len(t) for t in texts[t0:t1]])
            starts = np.cumsum(sizes + 3) - (sizes + 3)
            for lang in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(cost[:, lang], dtype=float)])
                out[t0:t1, lang] += total[starts + sizes] - total[starts]
        return out


def _chunks(texts: list[bytes], chunk: int) -> Iterator[tuple[int, int, bytes]]:
    """Runs of whole padded texts of about ``chunk`` bytes; a longer text comes in pieces that overlap by a context."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > chunk:
            whole = PAD + texts[at]
            for k in range(3, len(whole), chunk):
                yield at, at + 1, whole[k - 3 : k + chunk]
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= chunk:
            size += len(texts[end]) + 3
            end += 1
        if end - at == 1 and texts[at]:
            yield at, end, PAD + texts[at]
        elif end - at > 1:
            yield at, end, b"".join(PAD + t for t in texts[at:end])
        at = max(end, at + 1)


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted code stands in the sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, table[at] == wanted


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): counts of 4-byte grams, each text preceded by three zero bytes; summed before the shuffle."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                grams = []
                for t in texts:
                    raw = np.frombuffer(PAD + t, np.uint8).astype(np.uint32)
                    grams.append((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:])
                codes, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text")).where("lang is not null and text is not null")
    return labelled.mapInArrow(fn, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """About ``per_language`` texts of each language at most, picked by a hash of the text."""
    sizes = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()
    kept = F.lit(False)
    for r in sizes:  # a row for each language
        share = int(min(1.0, per_language / r["count"]) * (1 << 30))
        kept = kept | ((F.col(lang_col) == r["lang"]) & (F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < share))
    return docs.where(kept)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 3000) -> ContextTrees:
    counts = gram_counts(sample(docs, text_col, lang_col, per_language), text_col, lang_col).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    which = np.searchsorted(np.array(langs, object), np.array(counts["lang"].to_pylist(), object)) if langs else np.zeros(0, int)
    return grow(langs, which, counts["gram"].to_numpy().astype(np.uint32), counts["n"].to_numpy())


def grow(langs: list[str], which: np.ndarray, gram: np.ndarray, n: np.ndarray) -> ContextTrees:
    """Frozen code lengths of every gram from the counts of 4-byte grams."""
    width = len(langs)

    def level(length: int) -> tuple[np.ndarray, np.ndarray]:
        code = gram & np.uint32((1 << 8 * length) - 1) if length < 4 else gram
        codes, at = np.unique(code, return_inverse=True)
        table = np.zeros((len(codes), width))
        np.add.at(table, (at, which), n)
        return codes, table

    def laws(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, their escape bits by language (0 if unseen), and own bits of each gram (inf if unseen)."""
        contexts, at = np.unique(codes >> np.uint32(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, at, table)
        np.add.at(kinds, at, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = np.where(table > 0, -np.log2(table / (total + kinds)[at]), np.inf)
        return contexts, escape, own, escape[at]

    codes1, table1 = level(1)
    _, escape0, own, _ = laws(codes1, table1)
    cost1 = np.full((256, width), 8.0) + (escape0[0] if len(escape0) else 0.0)
    cost1[codes1] = np.where(np.isinf(own), cost1[codes1], own)

    codes2, table2 = level(2)
    contexts1, e1, own, _ = laws(codes2, table2)
    escape1 = np.zeros((256, width))
    escape1[contexts1] = e1
    every = np.arange(1 << 16)
    cost2 = escape1[every >> 8] + cost1[every & 0xFF]
    cost2[codes2] = np.where(np.isinf(own), cost2[codes2], own)

    codes3, table3 = level(3)
    contexts2, e2, own, mine = laws(codes3, table3)
    escape2 = np.zeros((1 << 16, width))
    escape2[contexts2] = e2
    cost3 = np.where(np.isinf(own), mine + cost2[codes3 & 0xFFFF], own)

    codes4, table4 = level(4)
    contexts3, escape3, own, mine = laws(codes4, table4)
    at, _ = find(codes3, codes4 & np.uint32(0xFFFFFF))
    cost4 = np.where(np.isinf(own), mine + cost3[at], own) if len(codes4) else np.zeros((0, width))
    f = np.float32
    return ContextTrees(langs, codes4, cost4.astype(f), codes3, cost3.astype(f), contexts3, escape3.astype(f), escape2.astype(f), cost2.astype(f))


def predict(docs: DataFrame, trees: ContextTrees, text_col: str = "text") -> Column:
    """A struct column (lang_pred, score, bits_per_byte) over ``docs``; score is the posterior under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def of(texts: pa.Array) -> pa.Array:
        t = shared.value
        raw = [x.encode() if x is not None else b"" for x in texts.to_pylist()]
        bits = t.bits(raw)
        best = bits.argmin(1)
        least = bits[np.arange(len(raw)), best]
        post = 1 / np.exp2(least[:, None] - bits).sum(1)
        per_byte = least / np.maximum(1, np.array([len(x) for x in raw]))
        return pa.StructArray.from_arrays([pa.array([t.languages[i] for i in best], pa.string()), pa.array(post), pa.array(per_byte)], ["lang_pred", "score", "bits_per_byte"])

    text = F.col(text_col).cast("string")
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    if not trees.languages:
        return none
    return F.when(text.rlike(r"\p{L}"), of(F.lower(text))).otherwise(none)


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000) -> DataFrame:
    """Predictions for every row of ``docs``, learned from its rows where ``learn_from`` holds: the id, held_out
    (``learn_from`` does not hold), lang_pred, score, bits_per_byte."""
    trees = train(docs.where(learn_from), text_col, lang_col, per_language)
    out = docs.select(F.col(id_col), (~F.coalesce(learn_from, F.lit(False))).alias("held_out"), F.col(text_col))
    return out.select(id_col, "held_out", predict(out, trees, text_col).alias("__p")).select(id_col, "held_out", "__p.lang_pred", "__p.score", "__p.bits_per_byte")
