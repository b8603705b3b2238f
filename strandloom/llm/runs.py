"""Periodic runs of words: longest-extension queries on suffix trees, candidates from Lyndon roots.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
max(least, 2 q) words that no neighbouring word extends.  In one of the two orders of words (one the other's
reverse) the longest Lyndon word that begins at some place of a run is as long as its period, so the longest
Lyndon words of all places, in both orders, are all candidates.  Each is extended to both sides by the longest
common extensions of the text and of its reversal: the depth of the lowest common ancestor of two leaves in an
Ukkonen suffix tree, a range minimum on the tree's Euler tour in constant time.

What cannot be in a run is left out first, exactly: a run of L words and period q has two equal halves L - q apart
that cover it, each of L - q words, and L - q is at least half of ``least``; so each word of a run lies in a window of
``least`` / 2 words that occurs twice in the same stretch of such words.  What is left of a document goes into its
tree whole, stretches parted by symbols of their own.

Defined results: null and empty texts have no words, no runs and the digests of nothing; a null id rewrites nothing;
repeated rows give repeated rows; of runs of equal length the one of smallest start, then period, is the greatest;
texts of any length are read whole.  Work and memory of a document grow in proportion to its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run.
LEAST = 12


class SuffixTree:
    """Ukkonen's tree of a sequence of symbols (from 0), closed by a symbol of its own that is less than all."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols) + 1
        self.text = [*symbols, -1]
        self._build()

    def _build(self) -> None:
        text, n = self.text, self.n
        # node 0 is the root; a leaf's edge ends at n; children of inner nodes by first symbol
        start, end, link, child = [0], [0], [0], [{}]
        node, edge, length, open_leaves = 0, 0, 0, 0  # active point, and suffixes still to be made explicit
        for i in range(n):
            c = text[i]
            open_leaves += 1
            last = -1
            while open_leaves:
                if length == 0:
                    edge = i
                kids = child[node]
                first = text[edge]
                to = kids.get(first, -1)
                if to < 0:
                    kids[first] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    child.append(None)
                    if last >= 0:
                        link[last] = node
                        last = -1
                else:
                    a = start[to]
                    span = (end[to] if end[to] < i + 1 else i + 1) - a
                    if length >= span and child[to] is not None:
                        edge += span
                        length -= span
                        node = to
                        continue
                    if text[a + length] == c:
                        length += 1
                        if last >= 0:
                            link[last] = node
                        break
                    split = len(start)
                    start.append(a)
                    end.append(a + length)
                    link.append(0)
                    child.append({text[a + length]: to, c: split + 1})
                    kids[first] = split
                    start[to] = a + length
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    child.append(None)
                    if last >= 0:
                        link[last] = split
                    last = split
                open_leaves -= 1
                if node == 0 and length > 0:
                    length -= 1
                    edge = i - open_leaves + 1
                elif node != 0:
                    node = link[node]
        self.start, self.end, self.child = start, end, child

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """(depths, first): the Euler tour as the string depths of the nodes it passes, and the place in it of each
        suffix's leaf.  Children are passed in order of their symbols."""
        start, end, child, n = self.start, self.end, self.child, self.n
        depths: list[int] = []
        first = [0] * n
        stack: list[tuple[int, Iterator]] = [(0, iter(sorted(child[0].items())))]
        depths.append(0)
        push, pop, note = stack.append, stack.pop, depths.append
        while stack:
            depth, kids = stack[-1]
            for _, to in kids:
                deeper = depth + end[to] - start[to]
                inner = child[to]
                if inner is None:
                    first[n - deeper] = len(depths)
                    note(deeper)
                    note(depth)
                else:
                    note(deeper)
                    push((deeper, iter(sorted(inner.items()))))
                    break
            else:
                pop()
                if stack:
                    note(stack[-1][0])
        return np.array(depths, np.int64), np.array(first, np.int64)

    def reverse_order(self) -> np.ndarray:
        """Rank of each suffix when symbols are ordered the other way round, the closing one still least."""
        start, end, child, n = self.start, self.end, self.child, self.n
        rank, at = [0] * n, 0
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            inner = child[node]
            if inner is None:
                rank[n - depth] = at
                at += 1
                continue
            for c in sorted(inner):  # the last pushed is the first popped: ascending pushes give descending order
                if c >= 0:
                    stack.append((inner[c], depth + end[inner[c]] - start[inner[c]]))
            if -1 in inner:
                stack.append((inner[-1], depth + end[inner[-1]] - start[inner[-1]]))
        return np.array(rank, np.int64)


class RangeMinimum:
    """Minima of ranges in constant time and memory in proportion to the values: a sparse table over blocks, and
    running minima from both sides within them."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        b = self.BLOCK
        blocks = -(-len(values) // b)
        v = np.full(blocks * b, np.iinfo(np.int64).max)
        v[: len(values)] = values
        grid = v.reshape(blocks, b)
        self.values = v
        self.prefix = np.minimum.accumulate(grid, axis=1).ravel()
        self.suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.sparse = [grid.min(axis=1)]
        while 2 ** len(self.sparse) <= blocks:
            half, above = 2 ** (len(self.sparse) - 1), self.sparse[-1]
            self.sparse.append(np.minimum(above[:-half], above[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value at places a to b (inclusive, a <= b) of each pair."""
        block = self.BLOCK
        i, j = a // block, b // block
        out = np.minimum(self.suffix[a], self.prefix[b])  # right where the ends are in different blocks
        gap = j - i - 1
        level = np.zeros(len(gap), np.int64)
        wide = gap > 0
        level[wide] = np.log2(gap[wide]).astype(np.int64)
        for k in np.unique(level[wide]).tolist():
            at = np.flatnonzero(wide & (level == k))
            row = self.sparse[k]
            out[at] = np.minimum(out[at], np.minimum(row[i[at] + 1], row[j[at] - 2**k]))
        same = np.flatnonzero(i == j)
        if len(same):
            lo, hi = a[same], b[same]
            low = self.values[lo]
            for step in range(1, block):
                at = np.minimum(lo + step, hi)
                low = np.minimum(low, self.values[at])
            out[same] = low
        return out


class Extensions:
    """Longest common extensions of a sequence's suffixes."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.tree = SuffixTree(symbols)
        depths, self.first = self.tree.tour()
        self.minima = RangeMinimum(depths)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b (a <> b); 0 where either is past the end."""
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n))
        x, y = self.first[a[inside]], self.first[b[inside]]
        out[inside] = self.minima.least(np.minimum(x, y), np.maximum(x, y))
        return out

    def orders(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes in both orders of symbols."""
        ahead = np.empty(self.n + 1, np.int64)
        ahead[np.argsort(self.first, kind="stable")] = np.arange(self.n + 1)
        return ahead, self.tree.reverse_order()


def longest_lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place: up to the next suffix of smaller rank."""
    values = rank[:-1].tolist()
    n = len(values)
    out, open_ = [0] * n, []
    for i in range(n - 1, -1, -1):
        v = values[i]
        while open_ and values[open_[-1]] > v:
            open_.pop()
        out[i] = (open_[-1] if open_ else n) - i
        open_.append(i)
    return np.array(out, np.int64)


def all_runs(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of every run of ``symbols``, by start, then period."""
    n = len(symbols)
    if n < max(2, least):
        return np.empty((0, 3), np.int64)
    ahead = Extensions(symbols.tolist())
    behind = Extensions(symbols[::-1].tolist())
    place, found = np.arange(n, dtype=np.int64), []
    for rank in ahead.orders():
        period = longest_lyndon(rank)
        right = ahead.common(place, place + period)
        left = behind.common(n - place, n - place - period)  # of the prefixes that end before both places
        length = period + right + left
        good = (length >= 2 * period) & (length >= least)
        found.append(np.stack([place[good] - left[good], length[good], period[good]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of stretches of at least ``least`` places that may hold runs: each place lies in a window of
    ``least`` / 2 that occurs again in its stretch.  ``codes``: equal words have equal codes (the converse helps)."""
    n, w = len(codes), max(1, least // 2)
    if n < max(2, least):
        return []
    rolled = np.zeros(n - w + 1, np.uint64)
    c = codes.astype(np.uint64)
    for k in range(w):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + c[k : n - w + 1 + k]
    at, stretch = np.arange(n - w + 1), np.zeros(n - w + 1, np.int64)  # windows, each within one stretch
    while True:
        order = np.lexsort((rolled[at], stretch))
        r, s = rolled[at][order], stretch[order]
        same = (r[1:] == r[:-1]) & (s[1:] == s[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.bincount(at[twice], minlength=n + 1) - np.bincount(at[twice] + w, minlength=n + 1)
        covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        turn = np.flatnonzero(covered[1:] != covered[:-1])
        a, b = turn[::2], turn[1::2]
        long = b - a >= least
        a, b = a[long], b[long]
        if not len(a):
            return []
        # windows inside the stretches that are left
        new_at = np.concatenate([np.arange(x, y - w + 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        if len(new_at) == len(at):
            return list(zip(a.tolist(), b.tolist(), strict=True))
        at, stretch = new_at, np.repeat(np.arange(len(a)), b - a - w + 1)


def runs_of_words(words: list[bytes], least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of every run of ``words``, by start, then period."""
    n = len(words)
    parts = stretches(np.fromiter(map(hash, words), np.int64, n), least) if n >= least else []
    if not parts:
        return np.empty((0, 3), np.int64)
    number: dict[bytes, int] = {}
    symbols, origin = [], []
    for k, (a, b) in enumerate(parts):
        if k:
            symbols.append(-k)  # a symbol of its own between stretches
            origin.append(-1)
        symbols += [number.setdefault(w, len(number)) for w in words[a:b]]
        origin += range(a, b)
    s = np.array(symbols, np.int64)
    s[s < 0] = len(number) - 1 - s[s < 0]
    rows = all_runs(s, least)
    rows[:, 0] = np.array(origin, np.int64)[rows[:, 0]]
    return rows


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract's query: in a tenth of the documents all words from some place on repeat."""
    n = len(words)
    if not n or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without those that some run holds after its first period."""
    if not len(runs):
        return words
    size = len(words) + 1
    edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=size) - np.bincount(runs[:, 0] + runs[:, 1], minlength=size)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _over_texts(docs: DataFrame, text_col: str, id_col: str, make, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                rows = [make(i, (t or "").encode().split()) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, *(n for n, _ in fields)])

    kept = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return kept.mapInArrow(fn, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, {schema}")


def find(docs: DataFrame, least: int = LEAST, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id, ``runs`` array<struct<start, length, period>> (word numbers from 0, by start, then period) and
    ``collapsed`` (the text's words without repetitions, joined by one space) of every row; no shuffle."""

    def make(_, words: list[bytes]) -> tuple:
        runs = runs_of_words(words, least)
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], b" ".join(collapsed(words, runs)).decode()

    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
    return _over_texts(docs, text_col, id_col, make, [("runs", kind), ("collapsed", pa.string())], "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(docs: DataFrame, rewrite=rewritten, least: int = LEAST, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id, n_runs, the greatest run's start, length, period and exponent_milli, and the digests of all runs and of the
    collapsed text, after ``rewrite(words, id)``."""

    def make(doc_id, words: list[bytes]) -> tuple:
        words = rewrite(words, doc_id)
        runs = runs_of_words(words, least)
        text = "".join(f"{a},{n},{q}\n" for a, n, q in runs.tolist())
        best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        return len(runs), *four, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    names = ("n_runs", "start", "length", "period", "exponent_milli")
    fields = [*((n, pa.int64()) for n in names), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    return _over_texts(docs, text_col, id_col, make, fields, ", ".join([*(f"`{n}` bigint" for n in names), "runs_sha256 string, collapsed_sha256 string"]))
