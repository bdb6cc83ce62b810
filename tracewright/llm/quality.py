"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector w over hashed words and token shapes, shared by all grades,
and ordered thresholds t_0 < t_1 < ...; a text gets its expected grade and the probability of a grade or more.

Defined results: null text counts as empty, and both get what the thresholds alone say; repeated rows are scored once
per row; null ratings teach nothing; with one grade only, every text has that grade; without any rating every text is
selected and its grade is 0; columns other than those named are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import text_batches, tidied
from tracewright.llm.hashed import BUCKETS, Adam, Rows, lists, sigmoid, style_of
from tracewright.llm.toxicity import held_out, picked

#: Ratings that the model is fitted on at most, picked by a hash of their id.
RATINGS = 12_000


@dataclass
class Model:
    #: The grades in use, ascending.
    grades: list[int]
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, texts: list[str | None]) -> np.ndarray:
        """Row i, column k: the probability that text i has grade ``grades[k + 1]`` or more."""
        dense = np.zeros(BUCKETS)
        dense[self.features] = self.weights
        f = np.zeros(len(texts))
        for i, t in enumerate(texts):
            idx, val = style_of(t)
            f[i] = float((dense[idx] * val).sum())
        return sigmoid(f[:, None] - self.thresholds[None, :])

    def expected(self, tail: np.ndarray) -> np.ndarray:
        g = np.array(self.grades or [0], dtype=np.float64)
        return g[0] + tail @ np.diff(g)

    def tail(self, tail: np.ndarray, grade: int) -> np.ndarray:
        """The probability of ``grade`` or more."""
        k = int(np.searchsorted(self.grades, grade))
        return np.ones(len(tail)) if k == 0 or not self.grades else np.zeros(len(tail)) if k == len(self.grades) else tail[:, k - 1]


def _ordered(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p[:1], p[0] + np.cumsum(np.exp(p[1:]))])


def likelihood(rows: Rows, k: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative logarithm of the grades' probabilities, k being their places, and its gradients by w and by the
    parameters p of the thresholds."""
    n, i = len(k), np.arange(len(k))
    below = np.zeros((n, len(p) + 2))
    below[:, -1] = 1
    below[:, 1:-1] = sigmoid(_ordered(p)[None, :] - rows.dot(w)[:, None])
    high, low = below[i, k + 1], below[i, k]
    chance = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
    g_t = np.array([d_low[k == j + 1].sum() - d_high[k == j].sum() for j in range(len(p))]) / n
    g_p = np.array([g_t[j:].sum() * (np.exp(p[j]) if j else 1.0) for j in range(len(p))])
    return float(-np.log(chance).mean()), rows.back((d_high - d_low) / n, len(w)), g_p


def fit_rows(rows: Rows, y: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-4, least: int = 5) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows; thresholds are a first one and the logarithms of gaps."""
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Model(grades, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    k, n = np.searchsorted(grades, y), len(y)
    chosen = np.flatnonzero(rows.frequent(min(least, max(1, n // 20)), BUCKETS))
    rows = rows.only(chosen)
    share = np.cumsum(np.bincount(k))[:-1] / n
    start = np.log(share / (1 - share))
    p = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w, step_w, step_p = np.zeros(len(chosen)), Adam(len(chosen), rate), Adam(len(p), rate)
    for _ in range(steps):
        _, g_w, g_p = likelihood(rows, k, w, p)
        w -= step_w.step(g_w + ridge * w)
        p -= step_p.step(g_p)
    return Model(grades, chosen, w, _ordered(p))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", most: int = RATINGS) -> Model:
    """Fit on at most ``most`` ratings, none of the held-out fold; of several ratings of one id the lowest counts.
    Only ids, grades and hashed features come to the driver."""
    text_batches(docs.sparkSession)
    known = ratings.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    known = known.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = F.broadcast(known.join(picked(known.select("id"), most), "id", "left_semi"))  # at most ``most`` rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [style_of(t.as_py()) for t in b.column("text")]
            idx, val = pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grade"), idx, val], ["id", "grade", "idx", "val"])

    found = rows.mapInArrow(tidied(features), f"id {rows.schema['id'].dataType.simpleString()}, grade int, idx array<int>, val array<float>")
    # However often an id is repeated, one text of it counts.
    got = found.groupBy("id", "grade").agg(F.min(F.struct("idx", "val")).alias("f")).select("grade", "f.*").toArrow()
    return fit_rows(Rows(lists(got.column("idx")), lists(got.column("val"))), np.array(got.column("grade").to_pylist(), dtype=np.int64))


def rate(docs: DataFrame, model: Model, grade: int, text_col: str = "text", out: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability``, that of ``grade`` or more, of each whole text, or under the
    names ``out``, whose columns they take the place of."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = model.at_least(b.column(text_col).to_pylist())
            new = [pa.array(model.expected(t), pa.float64()), pa.array(model.tail(t, grade), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *out])

    kept = docs.select(*[c for c in docs.columns if c not in out])
    return kept.mapInArrow(tidied(run), T.StructType([*kept.schema.fields, *(T.StructField(c, T.DoubleType()) for c in out)]))


def grades(labels: DataFrame) -> DataFrame:
    """The graded rating of a row of labels: 0 for poor text, 1 for good text that is toxic, 2 for other good text."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))
