"""Approximate nearest neighbours by additive quantisation, then exact reranking.

A unit vector is written as a sum of one full-dimensional codeword from each of ``books`` codebooks.  The
codebooks are fitted on residuals, one after the other, over a bounded sample (about ``fit_rows`` rows, picked
by a hash of their id).  Encoding keeps the ``beam`` best partial sums after each codebook.  A row's index
entry is its codes and the norm of its sum.

A query's table of inner products with all codewords scores an index entry by ``books`` lookups, divided by
the stored norm.  The entry also keeps its error, the distance between its vector and its unit sum: the true cosine
differs from the score by at most the error, and hardly ever by more than ``deviations`` times error / sqrt(dim).
Every entry that may still reach a query's ``k`` best within that margin is reranked at once by the exact cosine of
the original vectors in double precision, however many they are, so groups of near copies are searched whole;
``deviations`` = sqrt(dim) makes the search exact.

Queries go to the tasks in groups of about ``query_group`` (a bounded broadcast), and the index is scanned in place
once a group: entries are never shuffled, and a task returns ``k`` rows a query at most.  Every row is indexed, and
no bucket is skipped or capped.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have another length than
most vectors (the smaller length on a tie) take no part, nor do rows with a null id; ties go to the smaller id,
so of many equal vectors the smallest ids are found; a repeated id is searched for once and never finds itself;
with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def unit(batch: pa.Array, dim: int) -> np.ndarray:
    flat = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def fit_codebooks(x: np.ndarray, books: int, words: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(books, words, dim) by k-means on successive residuals."""
    rng = np.random.default_rng(seed)
    rest, out = x.copy(), []
    for _ in range(books):
        kinds = np.unique(rest, axis=0)
        c = kinds[rng.permutation(len(kinds))[:words]]
        if len(c) < words:
            c = np.concatenate([c, np.zeros((words - len(c), x.shape[1]), np.float32)])
        for _ in range(rounds):
            near = ((c * c).sum(1)[None, :] - 2 * rest @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        near = ((c * c).sum(1)[None, :] - 2 * rest @ c.T).argmin(1)
        rest = rest - c[near]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, books), norms of the sums, and the distance of each row from its unit sum, by beam search over
    partial sums."""
    n, (m, words, dim) = len(x), books.shape
    rest, codes, width = x[:, None, :], np.zeros((n, 1, 0), np.int16), 1
    for b in range(m):
        c = books[b]
        gap = (rest * rest).sum(2)[:, :, None] + (c * c).sum(1)[None, None, :] - 2 * (rest.reshape(-1, dim) @ c.T).reshape(n, width, words)
        flat = gap.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        row, word, each = best // words, best % words, np.arange(n)[:, None]
        rest = rest[each, row] - c[word]
        codes = np.concatenate([codes[each, row], word[:, :, None].astype(np.int16)], axis=2)
        width = keep
    final = (rest * rest).sum(2).argmin(1)
    chosen = codes[np.arange(n), final]
    total = np.zeros_like(x)
    for b in range(m):
        total += books[b][chosen[:, b]]
    norm = np.maximum(np.linalg.norm(total, axis=1), 1e-6)
    return chosen.astype(np.uint8), norm, np.linalg.norm(x - total / norm[:, None], axis=1)


def index(rows: DataFrame, books: np.ndarray, beam: int) -> DataFrame:
    """(id, v, codes binary, norm float, error float) of every row; no shuffle."""
    shared, dim = rows.sparkSession.sparkContext.broadcast(books), books.shape[2]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                codes, norm, error = encode(unit(part.column(1), dim), shared.value, beam)
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32)), pa.array(error.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["id", "v", "codes", "norm", "error"])

    return rows.mapInArrow(fn, "id bigint, v array<double>, codes binary, norm float, error float")


def exact_scores(q: np.ndarray, v: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Cosine of rows q[at] and v[of] in double precision, each sum from the first component on."""
    dot = lambda x, y: np.add.accumulate(x * y, axis=1)[:, -1]
    qq, vv = np.sqrt(dot(q, q)), np.sqrt(dot(v, v))
    out = np.zeros(len(at))
    for k in range(0, len(at), 1 << 15):
        i, j = at[k : k + (1 << 15)], of[k : k + (1 << 15)]
        out[k : k + (1 << 15)] = dot(q[i], v[j]) / (qq[i] * vv[j])
    return out


class Best:
    """The k best (score, then smaller id) found so far of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.edge = np.full(n, -np.inf)  # of queries with k found, the last one's score

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        kept = rank < self.k
        self.query, self.id, self.score = query[kept], ids[kept], score[kept]
        last = rank == self.k - 1
        self.edge[query[last]] = score[last]


def search(entries: DataFrame, group: pa.Table, books: np.ndarray, k: int, deviations: float) -> DataFrame:
    """(query_id, vec_id, score): the k best entries of each query in each task; ``group``: id, v of the queries."""
    dim = books.shape[2]
    q_ids = group["id"].to_numpy()
    vectors = group["v"].combine_chunks()
    shared = entries.sparkSession.sparkContext.broadcast((books, q_ids, vectors.flatten().to_numpy().reshape(-1, dim), unit(vectors, dim)))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, own, q, q_unit = shared.value
        best = Best(len(own), k)
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                ids, v = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.intp)
                norm, margin = b.column(3).to_numpy(), b.column(4).to_numpy() * np.float32(deviations / np.sqrt(dim))
                for lo in range(0, len(own), 256):
                    look = np.einsum("qd,bwd->bqw", q_unit[lo : lo + 256], c, optimize=True)
                    s = look[0][:, codes[:, 0]]
                    for m in range(1, len(c)):
                        s += look[m][:, codes[:, m]]
                    s /= norm
                    s[own[lo : lo + 256, None] == ids[None, :]] = -np.inf
                    new = ~np.isfinite(best.edge[lo : lo + 256])
                    if new.any():  # a first edge from the best by score
                        few = min(len(ids), 4 * k)
                        j = np.argpartition(-s[new], few - 1, axis=1)[:, :few]
                        i = np.repeat(lo + np.flatnonzero(new), few)
                        j = j.ravel()
                        i, j = i[s[i - lo, j] > -np.inf], j[s[i - lo, j] > -np.inf]
                        s[i - lo, j] = -np.inf
                        best.add(i, ids[j], exact_scores(q, v, i, j))
                    i, j = np.nonzero((s + margin >= best.edge[lo : lo + 256, None].astype(np.float32) - np.float32(1e-5)) & (s > -np.inf))
                    if len(i):
                        best.add(i + lo, ids[j], exact_scores(q, v, i + lo, j))
        yield pa.RecordBatch.from_arrays([pa.array(own[best.query]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"])

    return entries.select("id", "v", "codes", "norm", "error").mapInArrow(fn, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, deviations: float = 3.5, books: int = 16, words: int = 256, beam: int = 4, fit_rows: int = 16_384, query_group: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by cosine, nearest first."""
    work = Scratch(vectors.sparkSession)
    rows = work.put(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], empty)
    share = int(min(1.0, fit_rows / n) * (1 << 30))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    if share < 1 << 30 and picked.isEmpty():
        picked = rows.limit(fit_rows)
    sample = picked.orderBy("id", "v").select("v").toArrow()["v"].combine_chunks()  # bounded by fit_rows
    codebooks = fit_codebooks(unit(sample, len(sample[0])), books, words)
    entries = work.put(index(rows, codebooks, beam), "index")
    queries = work.put(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    work.drop(rows)
    groups = max(1, -(-queries.count() // query_group))
    found = []
    for g in range(groups):
        group = queries.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()  # about query_group rows
        if group.num_rows:
            near = search(entries, group, codebooks, k, deviations)
            ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
            found.append(work.put(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest"))
    work.keep(*found)
    if not found:
        return vectors.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, found)
