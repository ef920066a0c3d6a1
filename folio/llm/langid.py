"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with an elastic-net penalty, then calibrated by one temperature. The idf covers all
learning documents; the regression is fitted on a sample bounded by PER_CLASS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import ngrams
from folio.llm.common import as_batch, fold, keep_rows, table

FOLDS, HELD_OUT = 4, 2
#: Sampled learning documents of each language; one in five calibrates.
PER_CLASS = 300
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # classes x features
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int, size: int, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (k x size) and biases of a softmax regression, by FTRL-proximal."""
    z, n, zb, nb = np.zeros((k, size)), np.zeros((k, size)), np.zeros(k), np.zeros(k)
    solve = lambda z, n, l1: np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            y, at, v = rows[i]
            za, na = z[:, at], n[:, at]
            w, b = solve(za, na, L1), solve(zb, nb, 0)
            s = w @ v + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * v[None, :]
            z[:, at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[:, at] = na + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    return solve(z, n, L1).astype(np.float32), solve(zb, nb, 0).astype(np.float32)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss on rows that the regression hasn't seen."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 10, 60)

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    return float(min(grid, key=loss))


def learning(docs: DataFrame) -> DataFrame:
    """The rows to learn from: those outside the held-out fold with text and language."""
    d = table(docs, {"doc_id": "bigint", "text": "string", "lang": "string"})
    return d.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def train(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    learn = learning(docs)
    df, n = ngrams.document_frequency(learn)
    weight = ngrams.idf(df, n)
    sample, all_of = ngrams.sampled(learn, "lang", per_class)
    classes = sorted(all_of)
    at = {c: i for i, c in enumerate(classes)}
    rows = [(at[y], i, v) for y, i, v in ngrams.weighted(ngrams.rows_of(ngrams.bounded(sample, 2 * per_class * max(1, len(classes))), "lang"), weight)]
    aside = [r for i, r in enumerate(rows) if i % 5 == 4]
    w, b = ftrl([r for i, r in enumerate(rows) if i % 5 != 4], len(classes), ngrams.SIZE)
    t = temperature(np.array([w[:, i] @ v + b for _, i, v in aside]), np.array([y for y, _, _ in aside], int)) if classes else 1.0
    return Model(classes, w, b, weight, t)


def teller(m: Model):
    """Text -> (language, probability)."""
    by_feature = np.ascontiguousarray(m.weights.T)

    def told(t: str | None) -> tuple[str, float]:
        if not m.classes or not has_letter(t):
            return UNKNOWN, 0.0
        i, v = ngrams.row(t, m.idf)
        s = (v @ by_feature[i] + m.bias) / m.temperature
        p = np.exp(s - s.max())
        return m.classes[int(p.argmax())], float(p.max() / p.sum())

    return told


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row. A text without letters (null or empty too), or no learned language: und, score 0.

    Equal texts have equal predictions; of equally likely languages the first by name. A row without doc_id is told like any other. Repeated
    rows each have their row; texts of any length are read whole; other columns, also clashing ones, fall away.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = teller(held.value)
        for b in batches:
            pred, score = zip(*map(told, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield as_batch(schema, doc_id=b.column(0), held_out=b.column(2), lang_pred=list(pred), score=list(score))

    d = table(docs, {"doc_id": "bigint", "text": "string"}).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    return d.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """predict's rows for docs (doc_id, text, lang), by what their folds 0, 1 and 3 teach. Rows without doc_id aren't learnt from. Empty docs: no rows."""
    return predict(docs, train(docs))


def known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents whose language is told with probability least or more, columns kept; und goes."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def decide():
        told = teller(held.value)
        return lambda texts: [p[0] != UNKNOWN and p[1] >= least for p in map(told, texts)]

    return keep_rows(docs, decide)
