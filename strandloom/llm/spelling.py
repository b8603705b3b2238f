"""Spelling variants: near words by a trie of letter counts, and each word's common form.

Words are Latin-1 letters.  Two words that differ by one inserted, deleted or replaced letter have letter counts that
differ by a surplus of one at most and a deficit of one at most.  A trie arranges words by the counts of successive
letter groups: first, over the cluster, length and the counts of three coarse groups; then, within a task, of single
letters from the most common on.  A search goes down it with a budget of one surplus and one deficit, and the words
of the leaves that it reaches are verified letter by letter.

The upper levels are the shuffle: a word goes as an entry to its own subtree, and as a query to the subtrees that its
budget reaches and that hold words (some ten), of equal length with counts that are not smaller, or one letter longer,
so each pair is met once.  Subtrees of more than ``block`` words are dealt into several, and a query visits each.  A
task reads its subtrees one after another and holds the entries of about one block, with the queries in batches.
Below, all queries of a batch go down together: a level's states are arrays.

Defined results: null texts have no words; repeated rows count as often as they stand; a null id (of the contract's
query) changes no word; a word without near words has itself as its root.  Words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, small_join

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters by how common they are in European texts: the order of the trie's levels.
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
#: The letters of the coarse groups; a fourth group holds the rest.
COARSE = tuple(ORDER[i::4] for i in range(3))
#: Letters beyond a to z share this many groups.
OTHERS = 6
#: Entries of a subtree block, queries of a batch, and words of a node that is searched no further.
BLOCK, BATCH, LEAF = 20_000, 50_000, 4
KEY = ["size", "k0", "k1", "k2"]

GROUP_OF = np.full(256, len(ORDER), np.int64)
GROUP_OF[:] = len(ORDER) + np.arange(256) % OTHERS
GROUP_OF[np.frombuffer(ORDER.encode(), np.uint8)] = np.arange(len(ORDER))
GROUPS = len(ORDER) + OTHERS


def runs(docs: DataFrame, least: int = 7, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``run``: each maximal run of Latin-1 letters, of ``least`` or more, A to Z lower-cased."""
    found = docs.select(*keep, F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run"))
    return found.select(*keep, F.translate("run", UPPER, UPPER.lower()).alias("run"))


def without_one(run: Column, doc_id: Column, one_in: int = 31) -> Column:
    """``run``, less one code point where ``one_in`` divides the checksum of id and run."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least: int = 7, min_n: int = 2) -> DataFrame:
    """word, n of the words (column ``word``) of ``least`` code points and ``min_n`` occurrences."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def keyed(words: DataFrame) -> DataFrame:
    """``words`` with the upper levels of their path: length and the counts of the coarse groups."""
    count = lambda g: F.length("word") - F.length(F.translate("word", g, ""))
    return words.select("word", "n", F.length("word").alias("size"), *(count(g).alias(f"k{i}") for i, g in enumerate(COARSE)))


def moves() -> list[tuple[int, int, int, int]]:
    """What a query adds to its own key: budgets of one surplus and one deficit, each pair of keys one way only."""
    one = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]  # the last: in the group of the rest
    kept = {tuple(a - b for a, b in zip(up, down, strict=True)) for up in one for down in one}
    return sorted((0, *m) for m in kept if m >= (0, 0, 0)) + [(1, *m) for m in one]


def near_pairs(vocab: DataFrame, work: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of near words of ``vocab`` (word, n; words distinct)."""
    entries = keyed(vocab)
    sizes = work.put(entries.groupBy(*KEY).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "subtrees")
    move = F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(KEY, m, strict=True))) for m in moves()))).alias("m")
    asked = entries.select("word", "n", *KEY, move).select("word", "n", *((F.col(c) + F.col(f"m.{c}")).alias(c) for c in KEY))
    asked = small_join(asked, sizes, KEY, "inner").select(*KEY, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "word", "n")
    held = small_join(entries, sizes, KEY, "inner").select(*KEY, F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), F.lit(0).alias("asks"), "word", "n")
    both = held.unionByName(asked).withColumn("word", F.encode("word", "ISO-8859-1"))
    dealt = both.repartition(*KEY, "block").sortWithinPartitions(*KEY, "block", "asks")
    met = dealt.mapInArrow(_search, "a binary, n_a bigint, b binary, n_b bigint")
    text = lambda c: F.decode(c, "ISO-8859-1")
    ways = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("n_a").alias("n"), F.col("b").alias("y"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("x"), F.col("n_b").alias("n"), F.col("a").alias("y"), F.col("n_a").alias("m")))).alias("w")
    return met.select(ways).select(text("w.x").alias("word"), F.col("w.n").alias("n"), text("w.y").alias("other"), F.col("w.m").alias("other_n"))


class Words:
    """Words as padded rows of bytes beside their letter counts and numbers."""

    def __init__(self, tree: np.ndarray, column: pa.Array, n: np.ndarray):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
        flat = data[offsets[0] : offsets[-1]]
        self.tree, self.n, self.column = tree, n, column
        self.length = np.diff(offsets)
        self.start = offsets[:-1] - offsets[0]
        self.flat = np.concatenate([flat, np.zeros(1, np.uint8)])
        row = np.repeat(np.arange(len(column)), self.length)
        self.counts = np.bincount(row * GROUPS + GROUP_OF[flat], minlength=len(column) * GROUPS).reshape(len(column), GROUPS).astype(np.int32)

    def letters(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The bytes of ``rows``, zeros after a word's end."""
        at = self.start[rows, None] + np.arange(width)
        return np.where(np.arange(width) < self.length[rows, None], self.flat[np.minimum(at, len(self.flat) - 1)], 0)


class Trie:
    """Entries in order of their subtree and letter counts; a level's nodes are ranges of them."""

    def __init__(self, words: Words):
        self.words = words
        columns = [words.counts[:, g] for g in range(GROUPS - 1, -1, -1)]
        self.order = np.lexsort([*columns, words.tree])
        c, tree = words.counts[self.order], words.tree[self.order]
        m = len(tree)
        differ = np.concatenate([(tree[1:] != tree[:-1])[:, None], c[1:] != c[:-1]], axis=1) if m > 1 else np.empty((0, GROUPS + 1), bool)
        depth = np.where(differ.any(axis=1), differ.argmax(axis=1), GROUPS + 1)  # the first level at which a row parts from the one before
        self.levels = []  # of each level: first entry of each node (and the end), its count, and its first child
        starts = [np.concatenate([[0], 1 + np.flatnonzero(depth <= d), [m]]) for d in range(GROUPS + 1)]
        for d, at in enumerate(starts):
            count = tree[at[:-1]] if d == 0 else c[at[:-1], d - 1]
            child = np.searchsorted(starts[d + 1], at) if d < GROUPS else None
            self.levels.append((at, count, child))

    def search(self, asked: Words) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of the words in the leaves that each query's budget reaches."""
        at, tree, child = self.levels[0]
        node = np.searchsorted(tree, asked.tree)
        there = np.flatnonzero((node < len(tree)) & (tree[np.minimum(node, len(tree) - 1)] == asked.tree))
        query, node = there, node[there]
        over, under = np.zeros(len(query), bool), np.zeros(len(query), bool)
        found = []
        for d in range(GROUPS + 1):
            at, _, child = self.levels[d]
            small = at[node + 1] - at[node] <= LEAF if d < GROUPS else np.ones(len(node), bool)
            found.append(_spread(query[small], at[node[small]], at[node[small] + 1]))
            query, node, over, under = (x[~small] for x in (query, node, over, under))
            if not len(query):
                break
            which, below = _spread(np.arange(len(query)), child[node], child[node + 1])
            more = self.levels[d + 1][1][below] - asked.counts[query[which], d]
            good = (more == 0) | ((more == 1) & ~over[which]) | ((more == -1) & ~under[which])
            which, below, more = which[good], below[good], more[good]
            query, node, over, under = query[which], below, over[which] | (more == 1), under[which] | (more == -1)
        return np.concatenate([f[0] for f in found]), self.order[np.concatenate([f[1] for f in found])]

    def near(self, asked: Words) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of near words; of pairs of equal length within a subtree only those that ascend."""
        query, entry = self.search(asked)
        have = self.words
        alike = have.length[entry] == asked.length[query]
        good = np.zeros(len(query), bool)
        by_length = np.argsort(asked.length[query], kind="stable")
        at = 0
        while at < len(by_length):  # slices of a bounded number of letters
            width = int(asked.length[query[by_length[at]]]) + 1
            rows = by_length[at : at + max(1, 4_000_000 // (2 * width))]
            width = int(asked.length[query[rows[-1]]]) + 1
            if width > 2 * int(asked.length[query[rows[0]]]) + 2:  # few lengths in a slice
                rows = rows[: int(np.searchsorted(asked.length[query[rows]], 2 * asked.length[query[rows[0]]] + 2))]
                width = int(asked.length[query[rows[-1]]]) + 1
            at += len(rows)
            a, b = asked.letters(query[rows], width), have.letters(entry[rows], width)
            differ = a != b
            first = differ.argmax(axis=1)
            line = np.arange(len(rows))
            replaced = (differ.sum(axis=1) == 1) & ((asked.home[query[rows]] != have.tree[entry[rows]]) | (a[line, first] < b[line, first]))
            shifted = ((a[:, :-1] != b[:, 1:]) & (np.arange(width - 1) >= first[:, None])).any(axis=1)
            good[rows] = np.where(alike[rows], replaced, ~shifted)
        return query[good], entry[good]


def _spread(name: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name as often as its range is wide, with the numbers of the range."""
    many = high - low
    before = np.cumsum(many) - many
    return np.repeat(name, many), np.arange(int(many.sum())) + np.repeat(low - before, many)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition by subtree, entries before queries: near pairs, each once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= BATCH:
            made, rest = _batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0], False)
            yield from made
            held = [rest] if rest is not None else []
    if held and (every := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield from _batch(every[0], True)[0]


def _batch(rows: pa.RecordBatch, last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
    """Pairs of the subtrees in ``rows``, and the entries of the last subtree, which more queries may follow."""
    key = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("size", "k0", "k1", "k2", "block")], axis=1)
    asks = rows.column("asks").to_numpy(zero_copy_only=False) == 1
    n = rows.column("n").to_numpy(zero_copy_only=False)
    tree = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
    entries, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
    column = rows.column("word")
    made = []
    if len(entries) and len(queries):
        have = Words(tree[entries], column.take(pa.array(entries)), n[entries])
        asked = Words(tree[queries], column.take(pa.array(queries)), n[queries])
        # where a query is at home: the same key
        own = np.stack([asked.length, *(sum(asked.counts[:, ORDER.index(x)] for x in g) for g in COARSE)], axis=1)
        asked.home = np.where((own == key[queries][:, :4]).all(axis=1), asked.tree, -1)
        q, e = Trie(have).near(asked)
        if len(q):
            made.append(pa.RecordBatch.from_arrays([asked.column.take(pa.array(q)), pa.array(asked.n[q]), have.column.take(pa.array(e)), pa.array(have.n[e])], ["a", "n_a", "b", "n_b"]))
    if last:
        return made, None
    stay = np.flatnonzero((tree == tree[-1]) & ~asks)
    return made, rows.take(pa.array(stay))


def with_forms(vocab: DataFrame, pairs: DataFrame, work: Scratch, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocab``: form is the near word of largest n (ties: the
    smallest), if that is at least ``factor`` times the word's own; root is where forms of forms end."""
    least = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best")
    near = pairs.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), least)
    fits = -F.col("best.m") >= factor * F.col("n")
    near = work.put(near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "near")
    roots = work.put(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each form is at least ``factor`` times as frequent, so chains are short and have no circles
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = work.put(roots.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        work.drop(roots)
        roots = new
        if roots.where("moved").isEmpty():
            break
    out = vocab.join(near, "word", "left").join(roots.drop("moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def variants(words: DataFrame, least: int = 7, min_n: int = 2, factor: int = 10, block: int = BLOCK) -> DataFrame:
    """``with_forms`` of the vocabulary of ``words`` (column ``word``, a row an occurrence)."""
    work = Scratch(words.sparkSession)
    vocab = work.put(vocabulary(words, least, min_n), "vocabulary")
    return with_forms(vocab, near_pairs(vocab, work, block), work, factor)
