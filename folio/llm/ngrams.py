"""Hashed character n-grams of whole texts, and TF-IDF rows of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import as_batch

BITS = 14
SIZE = 1 << BITS
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_CHUNK = 1 << 20


def _fold_case() -> np.ndarray:
    """Lower case of the first 65,536 code points, where it is one code point; those beyond stay as they are."""
    return np.array([ord(c.lower()) if len((c := chr(i)).lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i in range(0x10000)], np.uint32)


_LOWER = _fold_case()


def counts(text: str | None, lower: bool = True) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram of code points occurs; texts of any length, a chunk at a time."""
    out = np.zeros(SIZE, np.int64)
    raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    for at in range(0, len(raw), _CHUNK):
        c = raw[max(0, at - 2) : at + _CHUNK]
        new = min(at, 2)  # code points that the chunk before has counted
        if lower:
            c = np.where(c < 0x10000, _LOWER[np.minimum(c, 0xFFFF)], c)
        a, b, d = c * _PRIMES[0], c * _PRIMES[1], c * _PRIMES[2]
        b ^= b >> np.uint32(15)
        d ^= d >> np.uint32(13)
        for n, h in ((1, a[new:]), (2, (a[:-1] ^ b[1:])[max(0, new - 1) :]), (3, (a[:-2] ^ b[1:-1] ^ d[2:]))):
            if len(h):
                h = (h + np.uint32(n)) * _PRIMES[1]
                out += np.bincount(h >> np.uint32(32 - BITS), minlength=SIZE)
    return out


def document_frequency(docs: DataFrame, lower: bool = True) -> tuple[np.ndarray, int]:
    """In how many of docs (text) each feature occurs, over all of them; and their number. What reaches the driver is SIZE rows."""
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df += counts(t, lower) > 0
                n += 1
        some = np.flatnonzero(df)
        yield as_batch(schema, feature=np.append(some, -1).astype(np.int32), n=np.append(df[some], n))

    got = docs.select("text").mapInArrow(work, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(SIZE, np.int64), 0
    for f, k in zip(got["feature"].tolist(), got["n"].tolist(), strict=True):
        if f < 0:
            n = k
        else:
            df[f] = k
    return df, n


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def row(text: str | None, weight: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of a text: log-scaled counts times idf, of unit length."""
    c = counts(text, lower)
    at = np.flatnonzero(c)
    v = np.log1p(c[at]).astype(np.float32) * weight[at]
    return at, v / np.float32(np.sqrt(v @ v) or 1)


def rows_of(docs: DataFrame, label: str, lower: bool = True) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, features, counts) of docs (text, label) on the driver, in an order that only their content sets. docs must be a bounded sample."""
    schema = pa.schema([("label", pa.string()), ("at", pa.binary()), ("c", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t, lower) for t in b.column(0).to_pylist()]
            at = [np.flatnonzero(c).astype(np.int16 if BITS < 15 else np.int32) for c in rows]
            yield as_batch(schema, label=b.column(1), at=[x.tobytes() for x in at], c=[c[x].astype(np.uint32).tobytes() for c, x in zip(rows, at, strict=True)])

    got = docs.select("text", F.col(label).cast("string")).mapInArrow(work, "label string, at binary, c binary").collect()
    got.sort(key=lambda r: (r.label, r.at, r.c))
    return [(r.label, np.frombuffer(r.at, np.int16 if BITS < 15 else np.int32).astype(np.int64), np.frombuffer(r.c, np.uint32)) for r in got]


def weighted(rows: list[tuple[object, np.ndarray, np.ndarray]], weight: np.ndarray) -> list[tuple[object, np.ndarray, np.ndarray]]:
    out = []
    for y, at, c in rows:
        v = np.log1p(c).astype(np.float32) * weight[at]
        out.append((y, at, v / np.float32(np.sqrt(v @ v) or 1)))
    return out


def sampled(labelled: DataFrame, label: str, per_class: int, seed: str = "s") -> tuple[DataFrame, dict[str, int]]:
    """About per_class rows of each class, by a hash of doc_id and text, if there; labels alone once for each doc_id. And how many rows each class has in all."""
    n = {r[0]: r[1] for r in labelled.groupBy(F.col(label).cast("string")).count().collect()}
    if not n:
        return labelled.limit(0), n
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, per_class / v)))])
    by = [F.col(c) for c in ("doc_id", "text") if c in labelled.columns]
    u = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(u < share[F.col(label).cast("string")])
    return (chosen if "text" in labelled.columns else chosen.dropDuplicates(["doc_id", label])), n


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, text, ...), at most so many of them, the first by a hash: doc_ids that repeat must not multiply a sample. Only hashes are sorted."""
    h = F.xxhash64(F.lit("b"), "doc_id", "text")
    beyond = rows.select(h.alias("h")).orderBy("h").offset(most).limit(1).collect()
    return rows.where(h < beyond[0].h) if beyond else rows
