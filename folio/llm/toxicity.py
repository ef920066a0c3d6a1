"""Toxicity by two class-conditional Kneser-Ney models of how words are spelt, backing off to counts that both classes share.

A symbol of a word is predicted from up to CONTEXT bytes of the word before it, each class by its own counts; what those leave
open is shared: the pooled continuation counts of the context without its first byte. So an inflected or misspelt rare
expression is judged by the stem that it shares with others. The two log-likelihoods of a passage of a few words are compared over
its number of symbols; a text's evidence is that of its most toxic passage, wherever it lies and however long the text. A logistic
curve, fitted on evidence by models that haven't counted the text, turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import ngrams
from folio.llm.common import as_batch, bytes_column, fold, pieces, stash, table
from folio.llm.decontam import _WORD

FOLDS, HELD_OUT = 4, 2
#: Sampled labelled documents of each class.
PER_CLASS = 2000
#: What a count gives to the backoff.
DISCOUNT = 1.0
#: Bytes of a word that predict the next one, at most 7.
CONTEXT = 4
THRESHOLD = 0.3
#: Words of a passage; parts of the sample that the curve is fitted across; distinct words a task remembers.
PASSAGE, PARTS, KNOWN = 3, 3, 300_000


@dataclass
class Model:
    """Log-ratios of the classes' probabilities of a symbol after its context.

    After a context that both classes share, what a class leaves to the backoff is multiplied by the same shared probability for
    both, so that factor falls out of the comparison: a symbol that neither class has counted above DISCOUNT has the log-ratio of what
    the classes leave there. ratio holds all others.
    """

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    backoff: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    #: Of the logistic curve over a text's evidence: intercept, slope.
    curve: tuple[float, float] = (0.0, 0.0)


def spelt(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each word (its bytes, then its end) the packed n-gram that ends there, and the words' first rows."""
    raw = bytes(8) + b" ".join(text.translate(_WORD).split()) + b" "
    n = len(raw) - 8
    if n <= 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    window = np.ndarray((n,), "<u8", raw, 1, (1,))
    space = np.frombuffer(raw, np.uint8)[8:] == 32
    begin = np.concatenate([[0], np.flatnonzero(space)[:-1] + 1])
    length = np.diff(np.append(begin, n))
    at = np.minimum(np.arange(n) - np.repeat(begin, length), CONTEXT)
    return window >> (8 * (7 - at)).astype(np.uint64), begin


def _context(keys: np.ndarray) -> np.ndarray:
    """Of little-endian windows: without the last byte. The last byte is the highest that isn't zero."""
    size = _bytes(keys)
    return keys & ~(np.uint64(255) << (8 * (size - 1)).astype(np.uint64))


def _context_key(keys: np.ndarray) -> np.ndarray:
    return _context(keys) * np.uint64(8) ^ _bytes(keys).astype(np.uint64)


def _bytes(keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), np.int64)
    for k in range(1, 8):
        out += (keys >> np.uint64(8 * k)) > 0
    return out


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts and how often each occurs."""
    return np.unique(np.concatenate([spelt(p)[0] for t in texts for p in pieces(t)] or [np.zeros(0, np.uint64)]), return_counts=True)


def compared(keys: np.ndarray, c: np.ndarray, prior: np.ndarray) -> Model:
    """keys: distinct n-grams; c: how often each class has them; prior: each class's share of all labelled rows, which weighs it in the shared counts."""
    context, of = np.unique(_context_key(keys), return_inverse=True)
    k = len(context)
    # shared: continuation counts of the n-gram without its first byte
    shorter, short_of = np.unique((keys >> np.uint64(8)) * np.uint64(16) ^ _bytes(keys).astype(np.uint64), return_inverse=True)
    above, above_of = np.unique(_context(keys) // np.uint64(256) * np.uint64(16) ^ _bytes(keys).astype(np.uint64), return_inverse=True)
    follows = (c > 0).T @ np.maximum(prior, 0.02)
    shared = np.bincount(short_of, follows, len(shorter))[short_of] / np.maximum(np.bincount(above_of, follows, len(above))[above_of], 1e-12)
    p, opens = [], []
    for y in range(2):
        n = np.bincount(of, c[y], k)
        left = np.where(n > 0, np.bincount(of, np.minimum(c[y], DISCOUNT), k) / np.maximum(n, 1e-9), 1)
        opens.append(left)
        p.append(np.maximum(c[y] - DISCOUNT, 0) / np.maximum(n, 1e-9)[of] + left[of] * shared)
    own = np.flatnonzero(c.max(0) > DISCOUNT) if len(keys) else np.zeros(0, np.int64)
    back = np.log(opens[1] / opens[0]).astype(np.float32)
    return Model(keys[own], np.log(p[1][own] / p[0][own]).astype(np.float32), context[back != 0], back[back != 0])


def count(texts: list[tuple[int, bytes]], prior: np.ndarray) -> Model:
    """texts: (class, text)."""
    per = [counted([t for y, t in texts if y == k]) for k in range(2)]
    keys = np.union1d(per[0][0], per[1][0])
    c = np.zeros((2, len(keys)))
    for y in range(2):
        c[y, np.searchsorted(keys, per[y][0])] = per[y][1]
    return compared(keys, c, prior)


def _look(table: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of at: its value (0 if unknown) and whether the sorted table has it."""
    if not len(table):
        return np.zeros(len(at), np.float32), np.zeros(len(at), bool)
    i = np.minimum(np.searchsorted(table, at), len(table) - 1)
    there = table[i] == at
    return np.where(there, values[i], 0), there


def ratios(m: Model, keys: np.ndarray) -> np.ndarray:
    """Log-ratio of each symbol: its own if a class has counted it above DISCOUNT, else that of its context's backoff (0 if neither class has the context)."""
    out, there = _look(m.keys, m.ratio, keys)
    rare = np.flatnonzero(~there)
    out[rare] = _look(m.contexts, m.backoff, _context_key(keys[rare]))[0]
    return out


class Judge:
    """Texts' evidence by a model; a word's log-ratio and symbols are worked out once."""

    def __init__(self, m: Model) -> None:
        self.m, self.at = m, {}
        self.word, self.size = np.zeros(2 * KNOWN, np.float32), np.zeros(2 * KNOWN, np.int32)

    def learn(self, words: list[bytes]) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.at))
        if len(self.at) + len(new) > KNOWN:
            self.at.clear()
            new = list(dict.fromkeys(words))
        if new:
            keys, begin = spelt(b" ".join(new))
            a, b = len(self.at), len(self.at) + len(new)
            self.at.update(zip(new, range(a, b), strict=True))
            self.word[a:b] = np.add.reduceat(ratios(self.m, keys), begin)
            self.size[a:b] = np.diff(np.append(begin, len(keys)))

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        """Of each text the greatest log-likelihood ratio of a passage, over its symbols.

        A passage is PASSAGE words, each one beginning a word later, or all words of a shorter text. 0 without words.
        """
        best = np.full(len(texts), -np.inf)
        held: list[tuple[int, list[bytes]]] = []
        n = 0
        for row, t in enumerate(texts):
            tail: list[bytes] = []
            for p in pieces(t or b"", 1 << 20):
                words = tail + p.translate(_WORD).split()
                tail = words[len(words) - PASSAGE + 1 :] if len(words) >= PASSAGE else words
                if len(words) >= PASSAGE:
                    held.append((row, words))
                    n += len(words)
                if n > KNOWN // 2:
                    self._best(held, best)
                    held, n = [], 0
            if tail and best[row] == -np.inf and not (held and held[-1][0] == row):
                held.append((row, tail))
                n += len(tail)
        self._best(held, best)
        return np.where(best == -np.inf, 0, best)

    def _best(self, held: list[tuple[int, list[bytes]]], best: np.ndarray) -> None:
        if not held:
            return
        words = [w for _, ws in held for w in ws]
        self.learn(words)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        w, s = (np.concatenate([[0], np.cumsum(x[at], dtype=np.float64)]) for x in (self.word, self.size))
        size = np.array([len(ws) for _, ws in held])
        first = np.cumsum(size) - size
        windows = np.maximum(size - PASSAGE + 1, 1)
        begin = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        end = begin + np.repeat(np.minimum(size, PASSAGE), windows)
        got = np.maximum.reduceat((w[end] - w[begin]) / (s[end] - s[begin]), np.cumsum(windows) - windows)
        np.maximum.at(best, [r for r, _ in held], got)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Intercept and slopes by Newton's method with a small ridge."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    b = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        h = a.T * (weight * p * (1 - p)) @ a + 1e-2 * np.eye(len(b))
        b += np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-2 * b), -4, 4)
    return b


def _labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, np.ndarray]:
    """(text, toxic, part): at most about per_class rows of each class, by hashes, in PARTS parts; and each class's share of all labelled rows."""
    rated = table(labels, {"doc_id": "bigint", "toxic": "int"}).where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1))
    sample, n = ngrams.sampled(rated, "toxic", per_class)
    rows = ngrams.bounded(table(docs, {"doc_id": "bigint", "text": "string"}).where("text is not null").join(F.broadcast(sample), "doc_id"), 4 * per_class)
    prior = np.array([n.get("0", 0), n.get("1", 0)], float)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text"), F.lit(PARTS)).cast("int")
    return stash(rows.select("text", "toxic", part.alias("part"))), prior / prior.sum() if prior.sum() else np.array([1.0, 0.0])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """From rows of docs with labels.toxic 0 or 1, outside the held-out fold; counts are taken in tasks, whole texts never reach the driver.

    The curve is fitted on evidence by models that have not counted the text's part. Without both classes the score is the base rate.
    """
    rows, prior = _labelled(docs, labels, per_class)
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("part", pa.int32()), ("n", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.array(b.column(1).to_pylist(), np.int64) * PARTS + np.array(b.column(2).to_pylist(), np.int64)
            texts = bytes_column(b)
            for g in np.unique(group).tolist():
                keys, n = counted([texts[i] for i in np.flatnonzero(group == g).tolist()])
                yield as_batch(schema, key=keys.view(np.int64), toxic=np.full(len(keys), g // PARTS, np.int32), part=np.full(len(keys), g % PARTS, np.int32), n=n)

    cells = [F.coalesce(F.sum(F.when((F.col("toxic") == y) & (F.col("part") == p), F.col("n"))), F.lit(0)).cast("int").alias(f"c{y}{p}") for y in range(2) for p in range(PARTS)]
    got = rows.mapInArrow(tally, "key bigint, toxic int, part int, n bigint").groupBy("key").agg(*cells).toArrow()
    raw = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(raw)
    keys = raw[order]
    c = np.stack([got.column(1 + i).to_numpy()[order].astype(np.float32) for i in range(2 * PARTS)]).reshape(2, PARTS, len(keys))
    del got, raw
    seen = {(r.toxic, r.part): r["count"] for r in rows.groupBy("toxic", "part").count().collect()}
    if min(sum(n for (y, _), n in seen.items() if y == k) for k in range(2)) < PARTS:
        return Model(curve=(float(np.log((prior[1] + 1e-3) / (prior[0] + 1e-3))), 0.0))
    held = rows.sparkSession.sparkContext.broadcast([compared(keys, c.sum(1) - c[:, p], prior) for p in range(PARTS)])
    told = pa.schema([("toxic", pa.int32()), ("x", pa.float64())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [Judge(m) for m in held.value]
        for b in batches:
            part, texts, x = np.array(b.column(2).to_pylist(), np.int64), bytes_column(b), np.zeros(b.num_rows)
            for p in range(PARTS):
                own = np.flatnonzero(part == p)
                x[own] = judges[p].evidence([texts[i] for i in own.tolist()])
            yield as_batch(told, toxic=b.column(1), x=x)

    aside = sorted((r.toxic, r.x) for r in rows.mapInArrow(tell, "toxic int, x double").collect())
    y, x = (np.array(v, float) for v in zip(*aside, strict=True))
    middle, spread = x.mean(), x.std() + 1e-9
    b = logistic(((x - middle) / spread)[:, None], y, np.where(y == 1, prior[1] / max(1, y.sum()), prior[0] / max(1, (1 - y).sum())) * len(y))
    m = compared(keys, c.sum(1), prior)
    m.curve = (float(b[0] - b[1] * middle / spread), float(b[1] / spread))
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null or empty text has no evidence and gets the curve's value at 0.

    Repeated rows each have their row; a null doc_id is in no fold; further columns don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        a, slope = held.value.curve
        for b in batches:
            x = judge.evidence(bytes_column(b))
            s = 1 / (1 + np.exp(-np.clip(a + slope * x, -40, 40)))
            yield as_batch(schema, doc_id=b.column(0), held_out=b.column(2), score=s, predicted=(s >= THRESHOLD).astype(np.int32))

    d = table(docs, {"doc_id": "bigint", "text": "string"}).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    return d.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), by what labels (doc_id, toxic) of learning folds teach.

    A null or empty text has a score too. Equal texts have equal scores; repeated rows and rows without doc_id each have their row; texts
    of any length are read whole; other columns, also clashing ones, fall away. Empty docs: no rows.
    """
    return score(docs, train(docs, labels))
