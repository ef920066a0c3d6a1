"""Quality by ordinal cumulative-link regression on graded ratings, with hashed-text weights shared by all grades.

P(grade > k) = sigmoid(w.x - t_k) with t_1 < t_2 < ...; the rows of the sample weigh as their grade does among all ratings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import ngrams
from folio.llm.common import as_batch, fold, keep_rows, table

FOLDS, HELD_OUT = 4, 2
#: Sampled rated documents of each grade.
PER_GRADE = 600
EPOCHS, RATE, L2 = 8, 0.5, 1e-5
#: A document is kept if its grade is above the lowest with this probability.
KEEP = 0.3


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    cuts: np.ndarray
    idf: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int, importance: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and k - 1 ordered thresholds, by Adagrad on the cumulative-link likelihood. rows: (grade index, features, values)."""
    w, gw = np.zeros(size), np.full(size, 1e-3)
    first, gaps = 0.0, np.zeros(max(0, k - 2))  # thresholds: first, then first + sum of exp(gaps)
    g0, gg = 1e-3, np.full(len(gaps), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            y, at, v = rows[i]
            cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            above = np.concatenate([[1.0], _sigmoid(w[at] @ v - cuts), [0.0]])  # P(grade >= j)
            slope = above * (1 - above)
            p = max(above[y] - above[y + 1], 1e-9)
            by_score = -importance[y] * (slope[y] - slope[y + 1]) / p  # of the loss
            by_cut = np.zeros(k + 1)
            by_cut[y] += importance[y] * slope[y] / p
            by_cut[y + 1] -= importance[y] * slope[y + 1] / p
            by_cut = by_cut[1:k]
            g = by_score * v + L2 * w[at]
            gw[at] += g * g
            w[at] -= RATE * g / np.sqrt(gw[at])
            d = by_cut.sum()
            g0 += d * d
            first -= RATE * d / np.sqrt(g0)
            if len(gaps):
                d = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(gaps)
                gg += d * d
                gaps -= RATE * d / np.sqrt(gg)
    return w.astype(np.float32), first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> Model:
    """Grades from labels (doc_id, quality) outside the held-out fold; a rating that repeats counts once."""
    d = table(docs, {"doc_id": "bigint", "text": "string"}).where("text is not null")
    rated = table(labels, {"doc_id": "bigint", "quality": "int"}).where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("quality").isNotNull())
    sample, n = ngrams.sampled(rated, "quality", per_grade)
    grades = sorted(int(g) for g in n)
    at = {str(g): i for i, g in enumerate(grades)}
    few = ngrams.bounded(d.join(F.broadcast(sample), "doc_id"), 2 * per_grade * max(1, len(grades)))
    raw = ngrams.rows_of(few, "quality", lower=False)
    df, docs_n = ngrams.document_frequency(d, lower=False)
    weight = ngrams.idf(df, docs_n)
    rows = [(at[y], i, v) for y, i, v in ngrams.weighted(raw, weight)]
    got = np.bincount([y for y, _, _ in rows], minlength=len(grades)) if rows else np.ones(len(grades))
    share = np.array([n[str(g)] for g in grades], float)
    importance = share / max(1, share.sum()) / np.maximum(1, got) * max(1, got.sum())
    if len(grades) < 2:
        return Model(grades, np.zeros(ngrams.SIZE, np.float32), np.full(max(0, len(grades) - 1), 0.0), weight)
    return Model(grades, *fit(rows, len(grades), importance, ngrams.SIZE), weight)


def rater(m: Model):
    """Text -> (expected grade, tail probability)."""
    grades = np.array(m.grades, float)

    def rated(t: str | None) -> tuple[float | None, float]:
        if len(grades) < 2:
            return (float(grades[0]) if len(grades) else None), 1.0
        i, v = ngrams.row(t, m.idf, lower=False)
        above = np.concatenate([[1.0], _sigmoid(m.weights[i] @ v - m.cuts), [0.0]])
        return float((above[:-1] - above[1:]) @ grades), float(above[1])

    return rated


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_prob, keep) of every row; a null text counts as empty.

    tail_prob: probability of a grade above the lowest. With fewer than two grades learned nothing is rejected (tail_prob 1). Equal texts
    have equal grades. Repeated rows and rows without doc_id each have their row; texts of any length are read whole; other columns, also
    clashing ones, fall away.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("keep", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rated = rater(held.value)
        for b in batches:
            grade, tail = zip(*map(rated, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield as_batch(schema, doc_id=b.column(0), held_out=b.column(2), expected_grade=list(grade), tail_prob=list(tail), keep=[t >= KEEP for t in tail])

    d = table(docs, {"doc_id": "bigint", "text": "string"}).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    return d.mapInArrow(work, "doc_id bigint, held_out boolean, expected_grade double, tail_prob double, keep boolean")


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """rate's rows for docs (doc_id, text), by what the labels (doc_id, quality) of learning folds teach. Labels without a document, and of
    repeated labels all but one, teach nothing. Empty docs: no rows; no labels: nothing is rejected."""
    return rate(docs, train(docs, labels))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier keeps, columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def decide():
        rated = rater(held.value)
        return lambda texts: [rated(t)[1] >= KEEP for t in texts]

    return keep_rows(docs, decide)
