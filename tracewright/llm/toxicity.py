"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the different words of a text is trained in numpy from confirmed toxic examples and unlabelled
text. The risk of calling unlabelled text clean is corrected by the class prior: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),
with a step back where the second term is below zero.

Defined results: null text counts as empty, and both get the score of the bias alone; repeated rows are scored once per
row; with no confirmed example, or no text, every score is 0; labels that are null teach nothing; columns other than
those named are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import text_batches, tidied
from tracewright.llm.hashed import BUCKETS, Adam, Rows, lists, sigmoid, words_of

#: Examples that the classifier is fitted on at most, picked by a hash of their id.
POSITIVES = 4_000
UNLABELLED = 8_000
#: Share of toxic text that is assumed where labels don't tell.
PRIOR = 0.05


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        dense = np.zeros(BUCKETS)
        dense[self.features] = self.weights
        return sigmoid(np.array([dense[words_of(t)].sum() + self.bias for t in texts], dtype=np.float64))


def risk(p: Rows, u: Rows, w: np.ndarray, b: float, prior: float) -> tuple:
    """The corrected risk of a classifier, its part for clean text, and the gradients by w and by b: of the whole risk
    with that part as it is, and of less of that part."""
    z_p, z_u = p.dot(w) + b, u.dot(w) + b
    s_p, s_u = sigmoid(z_p), sigmoid(z_u)
    toxic = prior * np.logaddexp(0, -z_p).mean()
    clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    up = [((s_p - 1) - s_p) * prior / p.n, s_u / u.n]
    back = [s_p * prior / p.n, -s_u / u.n]
    by_w = [p.back(g, len(w)) + u.back(h, len(w)) for g, h in (up, back)]
    return toxic + max(0.0, clean), clean, by_w, [g.sum() + h.sum() for g, h in (up, back)], toxic


def fit_rows(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 1e-5, least: int = 5, deviations: float = 4.0) -> Model:
    """Features are the words whose share among the positive rows is off that among the unlabelled ones by so many
    standard deviations, and that occur so often; what is left is minimised by Adam over all rows."""
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), -60.0)
    p, u = Rows(positive), Rows(unlabelled)
    in_p, in_u = np.bincount(p.idx, minlength=BUCKETS), np.bincount(u.idx, minlength=BUCKETS)
    share = (in_p + in_u + 1) / (n_p + n_u + 1)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    chosen = np.flatnonzero((np.abs(z) >= deviations) & (in_p + in_u >= least))
    p, u = p.only(chosen), u.only(chosen)
    prior = float(np.clip(prior, 1e-4, 0.5))
    w, b = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    step = Adam(len(chosen) + 1, rate)
    for _ in range(steps):
        _, clean, g_w, g_b, _ = risk(p, u, w, b, prior)
        # Below zero, a step back: down the correction alone.
        g = np.append(g_w[0] if clean >= 0 else g_w[1], g_b[0] if clean >= 0 else g_b[1])
        d = step.step(g + ridge * np.append(w, 0.0))
        w -= d[:-1]
        b -= d[-1]
    return Model(chosen, w, float(b))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """The fold that no label is taken from; a row without an id is in it."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def picked(ids: DataFrame, most: int) -> DataFrame:
    return ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Fit on at most so many confirmed toxic rows and unlabelled rows, none of the held-out fold. The class prior is
    the share of toxic rows among the labelled ones, unless given. Only ids and hashed words come to the driver."""
    text_batches(docs.sparkSession)
    known = labels.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    if prior is None:
        prior = known.agg(F.avg("label")).first()[0]
    toxic = picked(known.where("label = 1").select("id"), positives).withColumn("toxic", F.lit(True))
    other = picked(docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id")), unlabelled).withColumn("toxic", F.lit(False))
    # At most ``positives + unlabelled`` ids.
    chosen = F.broadcast(toxic.unionByName(other))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "toxic", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words_of(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["id", "toxic", "f"])

    found = rows.mapInArrow(tidied(features), f"id {rows.schema['id'].dataType.simpleString()}, toxic boolean, f array<int>")
    # However often an id is repeated, one text of it counts.
    got = found.groupBy("id", "toxic").agg(F.min("f").alias("f")).toArrow()
    flags = got.column("toxic").to_pylist()
    found = lists(got.column("f"))
    pick = lambda flag: [f for f, t in zip(found, flags, strict=True) if t is flag]
    return fit_rows(pick(True), pick(False), PRIOR if prior is None else prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with each whole text's score between 0 and 1, where texts are read."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out_col])

    kept = docs.select(*[c for c in docs.columns if c != out_col])
    return kept.mapInArrow(tidied(run), T.StructType([*kept.schema.fields, T.StructField(out_col, T.DoubleType())]))
