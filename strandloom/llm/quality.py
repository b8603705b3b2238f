"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector over hashed text features shared by all grades, and
ordered thresholds (theta_0, then positive steps).  Features are the hashed distinct words of the whole text
and its layout measures (shares of capitals, marks, digits, line ends and distinct words, mean word length),
each in bands.  The fit is L-BFGS: every gradient is a Spark job over the stored sample, and only sums of the
size of the weights reach the driver.  Weights go only to the features that a screening by their own effect keeps
(n / ln n of them for a sample of n rows), as thousands of indifferent words would otherwise drown the few that tell.

Grades here are 0 for a low rating, 1 for a good but toxic text, 2 for a good and clean one.  A document is
selected if P(grade >= ``min_grade``) reaches ``threshold``.

The sample is bounded: at most about ``max_rows`` labelled rows, picked by a hash of their id; an id counts with one
text, and a text once.

Defined results: a null text counts as empty; an empty text has layout features alone; labels with a null
rating are not learned from, of several ratings of an id the lowest counts; without labels (or of one grade
only) nothing is known and every document is selected with the tail of equal grades; repeated rows get equal
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, text_or_empty

BUCKETS = 1 << 18


def features(text: Column) -> Column:
    """array<int>: hashed distinct words and banded layout measures of the whole text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / chars
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    bands = {
        "capitals": F.floor(share(r"[^\p{Lu}]+") * 40),
        "marks": F.floor(share(r"[\p{L}\p{N}\s]+") * 40),
        "digits": F.floor(share(r"[^\p{N}]+") * 40),
        "lines": F.floor(share(r"[^\n]+") * 200),
        "kinds": F.floor(kinds / F.greatest(n, F.lit(1)) * 20),
        "word_length": F.floor(chars / F.greatest(n, F.lit(1))),
        "size": F.floor(F.log2(chars.cast("double"))),
    }
    layout = F.array(*(F.concat(F.lit(f"\x01{k}:"), F.least(v, F.lit(60)).cast("string")) for k, v in bands.items()))
    return F.array_distinct(F.transform(F.concat(layout, words), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. (columns)."""
        return sigmoid(s[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def loss_and_slopes(s: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood, its slope in each score, and its slope in each threshold."""
    k = len(thresholds)
    upper = np.where(y < k, thresholds[np.minimum(y, k - 1)] - s, np.inf)
    lower = np.where(y > 0, thresholds[np.maximum(y - 1, 0)] - s, -np.inf)
    up, low = sigmoid(upper), sigmoid(lower)
    p = np.maximum(up - low, 1e-12)
    by_upper, by_lower = -up * (1 - up) / p, low * (1 - low) / p
    slope = np.zeros(k)
    np.add.at(slope, y[y < k], by_upper[y < k])
    np.add.at(slope, y[y > 0] - 1, by_lower[y > 0])
    return -float(np.log(p).sum()), 1 - up - low, slope


def _scores(feats: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each row, and the flat features with their offsets."""
    offsets, flat = feats.offsets.to_numpy(), feats.values.to_numpy(zero_copy_only=False)
    total = np.concatenate([[0.0], np.cumsum(weights[flat])])
    return total[offsets[1:]] - total[offsets[:-1]], flat, offsets


def _gradient(data: DataFrame, kept, weights: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, its slopes in the weights of the ``kept`` features (a broadcast array), and in the thresholds."""
    shared = data.sparkSession.sparkContext.broadcast((weights, thresholds))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, th = shared.value
        w, grad = np.zeros(BUCKETS), np.zeros(BUCKETS)
        w[kept.value] = known
        loss, slope = 0.0, np.zeros(len(th))
        for b in batches:
            s, flat, offsets = _scores(b.column(0), w)
            part, by_score, by_threshold = loss_and_slopes(s, b.column(1).to_numpy(), th)
            loss, slope = loss + part, slope + by_threshold
            np.add.at(grad, flat[offsets[0] : offsets[-1]], np.repeat(by_score, np.diff(offsets)))
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad[kept.value].tobytes()], pa.binary()), pa.array([slope.tobytes()], pa.binary())], ["loss", "grad", "slope"])

    parts = data.mapInArrow(fn, "loss double, grad binary, slope binary").toArrow()  # one row of the kept weights' size a partition of the sample
    shared.destroy()
    total = lambda c: np.sum([np.frombuffer(x.as_buffer()) for x in parts[c]], axis=0)
    return sum(parts["loss"].to_pylist()), total("grad"), total("slope")


def telling_features(data: DataFrame, min_docs: int) -> np.ndarray:
    """The hashed features, in order, whose rows' mean grade differs most from the sample's, in standard errors: n /
    ln n of those that ``min_docs`` rows hold at least."""
    of = data.agg(F.count("*").alias("n"), F.avg("grade").alias("mean")).first()
    seen = data.select(F.explode("features").alias("f"), "grade").groupBy("f").agg(F.count("*").alias("n"), F.avg("grade").alias("mean")).where(F.col("n") >= min_docs)
    off = F.abs(F.col("mean") - of["mean"]) * F.sqrt("n")
    size = int(of["n"] / max(1.0, np.log(of["n"])))
    kept = seen.orderBy(F.desc(off), "f").limit(size).select("f").toArrow()  # fewer than the sample's rows
    return np.sort(kept["f"].to_numpy())


def fit(data: DataFrame, grades: int, ridge: float = 1.0, rounds: int = 30, memory: int = 8, min_docs: int = 5) -> Ordinal:
    """``data``: features array<int>, grade int (0 to grades - 1; two grades at least occur), of a bounded sample."""
    common = telling_features(data, min_docs)
    kept, size = data.sparkSession.sparkContext.broadcast(common), len(common)

    def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.exp(x[size + 1 :])
        return x[:size], x[size] + np.concatenate([[0.0], np.cumsum(steps)])

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, th = unpack(x)
        loss, grad, slope = _gradient(data, kept, w, th)
        after = np.cumsum(slope[::-1])[::-1]  # a step moves its threshold and those above
        return loss + ridge / 2 * float(w @ w), np.concatenate([grad + ridge * w, [after[0]], after[1:] * np.exp(x[size + 1 :])])

    x = np.zeros(size + grades - 1)
    x[size] = -1.0
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for ds, dg in reversed(past):
            alphas.append(a := (ds @ q) / (ds @ dg))
            q -= a * dg
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(g)))
        for (ds, dg), a in zip(past, reversed(alphas), strict=True):
            q += (a - (dg @ q) / (ds @ dg)) * ds
        step = 1.0
        while True:
            new = x - step * q
            f2, g2 = value(new)
            if np.isfinite(f2) and f2 <= f - 1e-4 * step * float(g @ q) or step < 1e-3:
                break
            step /= 2
        if step < 1e-3 and f2 > f:
            break
        if (new - x) @ (g2 - g) > 1e-12:
            past = [*past, (new - x, g2 - g)][-memory:]
        done = abs(f - f2) <= 1e-4 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    w, thresholds = unpack(x)
    weights = np.zeros(BUCKETS)
    weights[common] = w
    return Ordinal(weights, thresholds)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): 0 low, 1 good but toxic, 2 good and clean; the lowest of an id's ratings."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    rated = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    return rated.groupBy(id_col).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, grades: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    n = labels.count()
    share = int(min(1.0, max_rows / max(n, 1)) * (1 << 30))
    picked = graded(labels.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share), id_col)
    # the sample's ids are bounded by max_rows, so they travel to the documents and not the other way
    rows = docs.select(id_col, text_or_empty(text_col).alias("__text")).join(F.broadcast(picked), id_col)
    body = F.xxhash64("__text")
    one = rows.groupBy(id_col).agg(F.min_by("__text", body).alias("__text"), F.min("grade").alias("grade"))
    once = one.groupBy(body.alias("__body")).agg(F.min("__text").alias("__text"), F.min("grade").alias("grade"))
    work = Scratch(docs.sparkSession)
    data = work.put(once.select(features(F.col("__text")).alias("features"), "grade").repartition(8), "graded")
    if data.select("grade").distinct().count() < 2:
        return None
    model = fit(data, grades)
    work.keep()
    return model


def score(docs: DataFrame, model: Ordinal | None, grades: int = 3, text_col: str = "text") -> Column:
    """array<double> over ``docs``: P(grade >= k) for k = 1 to grades - 1."""
    if model is None:
        return F.array(*(F.lit(1 - k / grades) for k in range(1, grades)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def of(feats: pa.Array) -> pa.Array:
        m = shared.value
        tails = m.tails(_scores(feats, m.weights)[0])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))

    return of(features(text_or_empty(text_col)))


def rate(docs: DataFrame, model: Ordinal | None, min_grade: int = 2, threshold: float = 0.5, grades: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, expected_grade, tail_1.., and selected."""
    tails = docs.select(*keep, score(docs, model, grades, text_col).alias("__tails"))
    cols = [F.col("__tails")[k] for k in range(grades - 1)]
    expected = cols[0]
    for c in cols[1:]:
        expected = expected + c
    chosen = F.lit(True) if model is None else cols[min_grade - 1] >= threshold
    return tails.select(*keep, expected.alias("expected_grade"), *(c.alias(f"tail_{k + 1}") for k, c in enumerate(cols)), chosen.alias("selected"))


def select(docs: DataFrame, model: Ordinal | None, min_grade: int = 2, threshold: float = 0.5, grades: int = 3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier selects."""
    if model is None:
        return docs
    return docs.where(score(docs, model, grades, text_col)[min_grade - 1] >= threshold)
