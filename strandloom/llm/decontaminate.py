"""Benchmark decontamination by template canonicalisation.

Tokens are words and numbers.  Two canonical forms are taken of every text: ``plain`` (lower case; numbers, and
units after numbers, become typed placeholders) and ``named`` (capitalised words become name placeholders as
well).  A number of several words ("three hundred") is one placeholder in both forms, and a run of capitalised words
("Mary Ann") one in the named form, if only a space or a hyphen parts its words; a number's value is the whole run, a
name's its last word, so that a sentence's first word is no part of it.  Every window of ``WINDOW`` canonical tokens is hashed and joined with the benchmark's (items shorter than
a window are one window of their own length); one of placeholders alone is hashed with its values, as it would fit
any run of numbers or names.  Before the join, tasks drop windows whose hash is not in a bitmap of fixed size made
from the benchmark's windows, which loses none.

Hits of a document and an item that stand at one distance form an alignment.  Its slots must agree: a value of
the item always stands for one value of the document, and no two values for the same, so a re-parameterised
copy passes and a chance pattern does not.  Windows of ``LITERALS`` literal tokens (fewer for short items) suffice
alone.  An alignment with other windows counts if all its values are equal or if it matches ``LITERALS`` literal
tokens; fewer if the item's form has no more, but half of its tokens besides numbers and units.  An item leaks into
a document if the alignments that count, of either form, cover ``min_tokens`` of its tokens or ``min_share`` of them.

Defined results: null and empty texts match nothing; null or repeated ids are kept apart by a hash of the text;
repeated rows of one id and text count once; an empty benchmark gives no rows; columns beside id and text are not
read.  Items of less than ``LEAST`` tokens have no windows: an item of two tokens leaks into a document that has its
tokens as a line or a sentence, one of a single token if they are a line, letter case aside (anywhere else they are
words that clean texts share).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strandloom.llm.common import REMEMBERED, Scratch, small_join, texts_of

WINDOW, LITERALS, LEAST = 8, 5, 3
BITMAP_BITS = 1 << 24
#: A token, with the space or hyphen behind it if nothing else parts it from the next.
TOKENS = re.compile(r"(?:[^\W\d_]+(?:['’][^\W\d_]+)*|[$€£]?\d+(?:[.,]\d+)*%?)(?:[ -](?=[^\W_]))?")
LINES, SENTENCES = re.compile(r"[\r\n]+"), re.compile(r"(?<=[.!?])\s+")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles meter meters metre metres mg g kg gram grams kilogram kilograms oz lb lbs pound pounds ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kph w kw v hz".split())

_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0xA5A5A5A500000001, 0xA5A5A5A500000002, 0xA5A5A5A500000003))
_BASE = 0x9E3779B97F4A7C15
CHUNK_TOKENS = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Lexicon(dict):
    """Token to its number in the columns below; grows as tokens come."""

    def __init__(self):
        self.literal = np.zeros(1 << 12, np.uint64)
        self.kind = np.zeros(1 << 12, np.int8)  # 1 number, 2 unit, 4 capitalised, 8 number in letters, 16 next word close behind

    def __missing__(self, token: str) -> int:
        word, n = token.rstrip(" -"), len(self)
        low = word.lower()
        if n == len(self.kind):
            self.literal, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.literal, self.kind))
        spelled = low in NUMBER_WORDS
        number = spelled or (not word.isalpha() and any(c.isdigit() for c in word))
        self.literal[n] = xxh64_intdigest(low.encode())
        self.kind[n] = number * 1 | (low in UNITS) * 2 | word[0].isupper() * 4 | spelled * 8 | (word != token) * 16
        self[token] = n
        return n


@dataclass(frozen=True)
class Form:
    """Several texts in one canonical form, one after the other.  A place is a token or a folded run of tokens."""

    starts: np.ndarray  # first token of each place
    hashes: np.ndarray
    slots: np.ndarray
    values: np.ndarray  # hashes of the places' own tokens
    numbers: np.ndarray


def canonical(lists: list[list[str]], lexicon: Lexicon) -> tuple[np.ndarray, list[Form]]:
    """Of several texts' tokens: where each text ends, and the plain and the named form."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(lengths)
    at = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(lists)), np.int64, int(ends[-1]))
    literal, kind = lexicon.literal[at], lexicon.kind[at]

    def before(x: np.ndarray) -> np.ndarray:
        """Of each token, what holds for the one before it in its text."""
        out = np.concatenate([[False], x[:-1]])[: len(x)]
        out[(ends - lengths)[lengths > 0]] = False
        return out

    number = (kind & 1) > 0
    unit = ((kind & 2) > 0) & before(number) & ~number
    name = ((kind & 4) > 0) & ~number & ~unit
    close = before((kind & 16) > 0)
    in_number = ((kind & 8) > 0) & before(number) & close
    plain = np.where(number, _NUM, np.where(unit, _UNIT, literal))
    forms = []
    for hashes, slots, folded in ((plain, number | unit, in_number), (np.where(name, _NAME, plain), number | unit | name, in_number | (name & before(name) & close))):
        starts, rest = np.flatnonzero(~folded), np.flatnonzero(folded)
        values = literal[starts]
        if len(rest):
            place = np.cumsum(~folded)[rest] - 1
            np.add.at(values, place, mix(literal[rest] + (rest - starts[place]).astype(np.uint64)))
        forms.append(Form(starts, hashes[starts], slots[starts], values, number[starts]))
    return ends, forms


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))


def rolled(x: np.ndarray, size: int) -> np.ndarray:
    """The polynomial of every ``size`` values in a row, by differences of running sums (modulo 2 ** 64)."""
    n = max(CHUNK_TOKENS, 1 << len(x).bit_length())
    total = np.concatenate([[np.uint64(0)], np.cumsum(x * powers(_BASE, n)[: len(x)])])
    return (total[size:] - total[:-size]) * powers(pow(_BASE, -1, 1 << 64), n)[: len(x) - size + 1]


def windows(hashes: np.ndarray, slots: np.ndarray, values: np.ndarray, size: int, form: int) -> np.ndarray:
    """Hash of each window; those that reach from one text into the next are for the caller to leave out."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = rolled(hashes, size) + np.uint64(size * 4 + form)
    total = np.concatenate([[0], np.cumsum(~slots)])
    bare = np.flatnonzero(total[size:] == total[:-size])
    if len(bare):
        out[bare] = np.uint64(size * 4 + 2) + rolled(values, size)[bare]
    return mix(out)


def found_windows(lists: list[list[str]], lexicon: Lexicon, sizes: tuple[int, ...] | None, bitmap: np.ndarray | None) -> Iterator[tuple]:
    """(text, form, size, place in the text, hash, slots, literals, need, first token, token behind) of every window, or of those in the bitmap.

    Without ``sizes``: only windows of WINDOW tokens, or one of all tokens if there are fewer, with the places of
    their literals and the number of literals that an alignment of the form needs.
    """
    ends, forms = canonical(lists, lexicon)
    n, begins = len(lists), np.concatenate([[0], ends[:-1]])
    words = None
    for form, x in enumerate(forms):
        text = np.searchsorted(ends, x.starts, side="right")
        lengths = np.bincount(text, minlength=n)
        last = np.cumsum(lengths)
        firsts = last - lengths
        left = last[text] - np.arange(len(text))  # places from here to the text's end
        literals = np.bincount(text[~x.slots], minlength=n)
        if form == 0:
            words = literals
        for size in sorted(set(np.minimum(lengths, WINDOW).tolist())) if sizes is None else sizes:
            if size < LEAST or len(text) < size:
                continue
            fits = left >= size
            if sizes is None:
                fits &= np.minimum(lengths, WINDOW)[text] == size
            if form:  # a text without slots is as in the plain form
                fits &= (literals < lengths)[text]
            w = windows(x.hashes, x.slots, x.values, size, form)
            fits = fits[: len(w)]
            if bitmap is not None:
                low = w & np.uint64(BITMAP_BITS - 1)
                fits = fits & ((bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0)
            for p in np.flatnonzero(fits).tolist():
                t = int(text[p])
                begin, stop = int(begins[t]), int(ends[t])
                tokens = [int(k) - begin for k in x.starts[p : p + size + 1]]
                if left[p] == size:  # the next place, if any, is another text's
                    tokens[size:] = [stop - begin]
                held = []
                for k in np.flatnonzero(x.slots[p : p + size]).tolist():
                    run = [token.rstrip(" -").lower() for token in lists[t][tokens[k] : tokens[k + 1]]]
                    held.append(" ".join(run) if x.numbers[p + k] else run[-1])
                place = p - int(firsts[t])
                if sizes is not None:
                    yield t, form, size, place, w[p], held, [], 0, tokens[0], tokens[size]
                else:
                    yield t, form, size, place, w[p], held, place + np.flatnonzero(~x.slots[p : p + size]), min(LITERALS, max(int(literals[t]), -(-int(words[t]) // 2))), tokens[0], tokens[size]


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Places and tokens of texts, by as many as hold CHUNK_TOKENS tokens, or one longer text."""
    places, lists, held = [], [], 0
    for i, text in enumerate(texts):
        tokens = TOKENS.findall(text) if text else []
        if lists and held + len(tokens) > CHUNK_TOKENS:
            yield places, lists
            places, lists, held = [], [], 0
        if tokens:
            places.append(i)
            lists.append(tokens)
            held += len(tokens)
    if lists:
        yield places, lists


_LEXICON = Lexicon()


def lexicon_of_worker() -> Lexicon:
    """One lexicon for all tasks of a Python worker, begun anew when it has grown to REMEMBERED tokens."""
    global _LEXICON
    if len(_LEXICON) > REMEMBERED:
        _LEXICON = Lexicon()
    return _LEXICON


def window_rows(df: DataFrame, keys: list[str], sizes: tuple[int, ...] | None, bitmap: np.ndarray | None) -> DataFrame:
    """``keys`` and (window, form, size, pos, slots, n_tokens, literals, need, first, behind) of every window, or of those in the
    bitmap; ``sizes`` as in ``found_windows``."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    names = ["window", "form", "size", "pos", "slots", "n_tokens", "literals", "need", "first", "behind"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            row, hashed, forms, sized, pos, slots, length, literals, need, first, behind = ([] for _ in range(11))
            for places, lists in chunks(texts_of(b.column(b.num_columns - 1))):
                for t, form, size, p, w, held, where, needs, begin, stop in found_windows(lists, lexicon_of_worker(), sizes, bits):
                    row.append(places[t])
                    hashed.append(w)
                    forms.append(form)
                    sized.append(size)
                    pos.append(p)
                    slots.append(held)
                    length.append(len(lists[t]))
                    literals.append(where)
                    need.append(needs)
                    first.append(begin)
                    behind.append(stop)
            head = [c.take(pa.array(row, pa.int64())) for c in b.columns[:-1]]
            made = [pa.array(np.array(hashed, np.uint64).view(np.int64)), *(pa.array(x, pa.int32()) for x in (forms, sized, pos)), pa.array(slots, pa.list_(pa.string())), pa.array(length, pa.int32()), pa.array(literals, pa.list_(pa.int32())), pa.array(need, pa.int32()), pa.array(first, pa.int32()), pa.array(behind, pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, *made], [*b.schema.names[:-1], *names])

    kept = df.select(*keys, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "window bigint, form int, size int, pos int, slots array<string>, n_tokens int, literals array<int>, need int, first int, behind int"])
    return kept.mapInArrow(fn, schema)


def short_rows(df: DataFrame, keys: list[str], bitmap: np.ndarray | None) -> DataFrame:
    """``keys`` and (short, window, n_tokens, is_line): the lower-cased tokens, less than LEAST, of every whole text; or,
    with a bitmap of their hashes, of every line and sentence."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def parts(text: str) -> Iterator[tuple[str, bool]]:
        if shared.value is None:
            yield text, True
            return
        for line in LINES.split(text):
            yield line, True
            sentences = SENTENCES.split(line)
            if len(sentences) > 1:
                yield from ((x, False) for x in sentences)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            row, short, hashed, counts, lines = [], [], [], [], []
            for i, text in enumerate(texts_of(b.column(b.num_columns - 1))):
                for part, is_line in parts(text or ""):
                    tokens = [m[0].rstrip(" -").lower() for m in islice(TOKENS.finditer(part), LEAST)]
                    if not 0 < len(tokens) < LEAST:
                        continue
                    w = xxh64_intdigest(" ".join(tokens).encode())
                    low = w % BITMAP_BITS
                    if bits is None or int(bits[low >> 6]) >> (low & 63) & 1:
                        row.append(i)
                        short.append(" ".join(tokens))
                        hashed.append(w)
                        counts.append(len(tokens))
                        lines.append(is_line)
            head = [c.take(pa.array(row, pa.int64())) for c in b.columns[:-1]]
            made = [pa.array(short, pa.string()), pa.array(np.array(hashed, np.uint64).view(np.int64)), pa.array(counts, pa.int32()), pa.array(lines, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*head, *made], [*b.schema.names[:-1], "short", "window", "n_tokens", "is_line"])

    kept = df.select(*keys, "text")
    return kept.mapInArrow(fn, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "short string, window bigint, n_tokens int, is_line boolean"]))


def bitmap_of(wanted: DataFrame) -> np.ndarray:
    """The bitmap of the windows' hashes; its size is fixed."""
    low = F.col("window").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = wanted.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(window & 63 as int))")).alias("bits")).collect()  # BITMAP_BITS / 64 rows at most
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    for r in words:
        out[r["w"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 13, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document and item that leaks into it: id, item, matched_tokens, item_tokens, coverage, exact
    (whether some alignment has equal slot values)."""
    work = Scratch(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    wanted = work.put(window_rows(items, ["item"], None, None), "benchmark-windows")
    sizes = tuple(r["size"] for r in wanted.select("size").distinct().collect())  # WINDOW values at most
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("body"), F.col(text_col).cast("string").alias("text"))
    seen = window_rows(texts, ["doc", "body"], sizes, bitmap_of(wanted))
    seen = seen.select("doc", "body", "window", "size", "form", F.col("pos").alias("seen_pos"), F.col("slots").alias("seen_slots"))
    hits = small_join(seen, wanted, ["window", "size", "form"], "inner").where(F.size("slots") == F.size("seen_slots"))
    pairs = F.arrays_zip(F.col("slots").alias("a"), F.col("seen_slots").alias("b"))
    rich = F.size("literals") >= F.least(F.lit(LITERALS), F.greatest(F.lit(3), F.col("size") - 3))
    hits = hits.withColumn("rich", F.explode(F.when(rich, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))  # by rich windows alone, and by all
    lines = hits.groupBy("doc", "body", "item", "form", "rich", (F.col("seen_pos") - F.col("pos")).alias("shift")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("literals")))).alias("literals"), F.max("need").alias("need"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.collect_set(F.struct("first", "behind")).alias("at"), F.max("n_tokens").alias("n_tokens"))
    one = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side]))) == F.size("pairs")
    same = F.forall("pairs", lambda p: p["a"] == p["b"])
    agreed = lines.where(one("a") & one("b")).where(F.col("rich") | same | ((F.col("need") > 0) & (F.col("literals") >= F.col("need"))))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p["first"], p["behind"] - 1))))
    found = agreed.select("doc", "body", "item", "n_tokens", covered.alias("covered"), same.alias("same"))
    each = found.groupBy("doc", "body", "item").agg(F.max("n_tokens").alias("item_tokens"), F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("matched_tokens"), F.max("same").alias("exact"))
    each = each.withColumn("coverage", F.col("matched_tokens") / F.col("item_tokens")).where((F.col("matched_tokens") >= min_tokens) | (F.col("coverage") >= min_share))
    short = work.put(short_rows(items, ["item"], None).select("item", "short", "window", F.col("n_tokens").alias("item_tokens")).distinct(), "short-items")
    if not short.isEmpty():
        alone = short_rows(texts, ["doc", "body"], bitmap_of(short)).select("doc", "body", "short", "is_line")
        alone = small_join(alone, short.drop("window"), ["short"], "inner").where("item_tokens = 2 or is_line")
        alone = alone.groupBy("doc", "body", "item").agg(F.max("item_tokens").alias("item_tokens"))
        each = each.unionByName(alone.select("*", F.col("item_tokens").alias("matched_tokens"), F.lit(True).alias("exact"), F.lit(1.0).alias("coverage")))
    return each.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "matched_tokens", "item_tokens", "coverage", "exact")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, into which no item leaks; decided by text, so ids may be null or repeated."""
    work = Scratch(docs.sparkSession)
    key = F.sha2(F.col(text_col).cast("string"), 256)
    found = work.put(leaks(docs.select(key.alias("doc_key"), F.col(text_col).alias("text")), benchmark, id_col="doc_key", **how).select("doc_key").distinct(), "leaks")
    packed = docs.select(F.struct("*").alias("row"), key.alias("doc_key"))
    return small_join(packed, found, ["doc_key"], "left_anti").select("row.*")
