"""Token counts by section: whole documents are encoded once, and their tokens attributed by character span.

A document's sections are its lines (``sections="lines"``) or its blocks between blank lines
(``"paragraphs"``); a section owns the separator that ends it, so sections tile the text.  Token spans and
section spans are both in order, so their interval join is a merge inside the Arrow batch that holds the
document: no token row leaves it.

The rule for a token that crosses section boundaries is a parameter: ``first`` gives it to the section of its
first character, ``last`` to that of its last character, ``most`` to the section holding most of its
characters (the earlier one on a tie), ``split`` divides it by characters.  Under every rule a document's
counts sum to its number of tokens.

Defined results: a null or empty text has one empty section with no tokens; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bpe import codec, small_groups

RULES = ("first", "last", "most", "split")
SECTIONS = {"lines": re.compile(r"\n"), "paragraphs": re.compile(r"\n[^\S\n]*\n\s*")}


def section_starts(text: str, kind: str) -> np.ndarray:
    cuts = [m.end() for m in SECTIONS[kind].finditer(text)]
    return np.array([0, *(c for c in cuts if c < len(text))], np.int64)


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, length: int, rule: str) -> np.ndarray:
    """Tokens (double) for each section; spans [first, end), sections tile [0, length)."""
    n, last = len(starts), np.maximum(end - 1, first)
    low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    if rule == "last":
        return np.bincount(high, minlength=n).astype(float)
    if rule == "first":
        return np.bincount(low, minlength=n).astype(float)
    inside = low == high
    out = np.bincount(low[inside], minlength=n).astype(float)
    limits = np.append(starts, length)
    for a, b, s, e in zip(low[~inside], high[~inside], first[~inside], end[~inside], strict=True):
        share = np.minimum(limits[a + 1 : b + 2], e) - np.maximum(limits[a : b + 1], s)
        if rule == "split":
            out[a : b + 1] += share / share.sum()
        else:
            out[a + int(np.argmax(share))] += 1
    return out


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, sections: str = "lines", rule: str = "first", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a section: id, section_no (from 0), char_start, char_end, n_tokens double, n_crossing (tokens
    that begin in the section and end in a later one), doc_tokens.  No shuffle."""
    if rule not in RULES or sections not in SECTIONS:
        raise ValueError(f"rule must be one of {RULES} and sections one of {tuple(SECTIONS)}")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            at = 0
            for group in small_groups(b.column(1).to_pylist()):
                parts, sizes = [], []
                for text, ids in zip(group, c.encode(group), strict=True):
                    starts = section_starts(text, sections)
                    first, end = c.character_spans(text, ids)
                    low = np.searchsorted(starts, first, "right")
                    crossing = low[np.searchsorted(starts, np.maximum(end - 1, first), "right") > low] - 1
                    n = len(starts)
                    parts.append((np.arange(n), starts, np.append(starts[1:], len(text)), attribute(first, end, starts, len(text), rule), np.bincount(crossing, minlength=n), np.full(n, len(ids))))
                    sizes.append(n)
                ids_col = b.column(0).slice(at, len(group)).take(pa.array(np.repeat(np.arange(len(group)), sizes)))
                cols = [np.concatenate([p[i] for p in parts]) for i in range(6)]
                yield pa.RecordBatch.from_arrays([ids_col, pa.array(cols[0], pa.int32()), *(pa.array(x, pa.float64() if i == 2 else pa.int64()) for i, x in enumerate(cols[1:]))], ["id", "section_no", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])
                at += len(group)

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = kept.mapInArrow(fn, f"id {kept.schema['id'].dataType.simpleString()}, section_no int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint, doc_tokens bigint")
    return made.withColumnRenamed("id", id_col)
