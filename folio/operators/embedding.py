"""Embedding texts by a batch scorer, indexes built from chunks, and search by text."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import search, store, vectors
from folio.operators.scoring import Model, Scorer, scored

DIMENSION = 64


def hash_embedder(dimension: int = DIMENSION, normalise: bool = True) -> Scorer:
    """A deterministic stand-in for an embedding model: signed feature hashing of a text's lower-case alphanumeric tokens.

    A token adds 1 or -1 at one place: the first 8 hex digits of its MD5, modulo the dimension; the sign is the next digit's lowest bit.
    """

    def load(_: str) -> Model:
        known: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            if token not in known:
                if len(known) > 1 << 20:
                    known.clear()
                h = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
                known[token] = int(h[:8], 16) % dimension, 1.0 if int(h[8], 16) & 1 else -1.0
            return known[token]

        def model(rows: list[tuple]) -> list[list[float]]:
            out = np.zeros((len(rows), dimension))
            for v, (text,) in zip(out, rows, strict=True):
                for token in re.findall(r"[a-z0-9]+", text.lower()):
                    i, sign = place(token)
                    v[i] += sign
            if normalise:
                n = np.sqrt((out * out).sum(1, keepdims=True))
                out /= np.where(n == 0, 1, n)
            return out.astype(np.float32).tolist()

        return model

    return Scorer(f"hash-{dimension}{'' if normalise else '-raw'}", load, "array<float>", 256)


def present(text: Column) -> Column:
    """The text; a missing or blank one fails the query."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank, F.raise_error(F.lit("texts to embed must not be blank")).cast("string")).otherwise(text)


def embed(chunks: DataFrame, embedder: Scorer, dimension: int, text: str = "text") -> DataFrame:
    """chunks with embedding, dimension and model_name. Blank texts and vectors of another dimension fail; equal texts are embedded once."""
    e = scored(chunks.withColumn(text, present(F.col(text))), embedder, "embedding", text)
    wrong = F.size("embedding") != dimension
    checked = F.when(wrong, F.raise_error(F.lit(f"vectors must have {dimension} dimensions")).cast("array<float>")).otherwise(F.col("embedding"))
    return e.withColumn("embedding", checked).withColumns({"dimension": F.lit(dimension), "model_name": F.lit(embedder.name)})


def embed_query(chunks: DataFrame, text: str, embedder: Scorer) -> list[float]:
    """The vector of one text, by the session of chunks."""
    if not text or not text.strip():
        raise search.SearchError("a search text must not be blank")
    one = chunks.sparkSession.createDataFrame([(text,)], "text string")
    return list(scored(one, embedder, "embedding", "text").first().embedding)


def build_index(chunks: DataFrame, embedder: Scorer, dimension: int, path: str, earlier: DataFrame | None = None) -> DataFrame:
    """An index saved at path, of chunks (vec_id, text, ...) that are embedded first, behind the vectors of an earlier one: slots go on."""
    new = embed(chunks, embedder, dimension).select("vec_id", "embedding")
    start = new.limit(0).withColumn("slot", F.lit(0).cast("bigint")) if earlier is None else earlier
    store.save_index(store.add_to_index(start, new), path)
    return store.load_index(chunks.sparkSession, path)


def search_texts(index: DataFrame, asked: DataFrame, embedder: Scorer, k: int, *, same_label: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of index (vec_id, label, embedding) to each text of asked (query_id, text, label).

    query_id and vec_id are told apart: a query is no vector of the index.
    """
    search.checked(k, None, None)
    label = F.col("label") if "label" in asked.columns else F.lit(None).cast("bigint")
    q = scored(asked.withColumn("text", present(F.col("text"))), embedder, "embedding", "text").select((-1 - F.col("query_id")).alias("vec_id"), label.alias("label"), "embedding")
    found = vectors.top_k_joined(index, q, k) if same_label else vectors.top_k_batch(index, q, k)
    return found.withColumn("query_id", -1 - F.col("query_id"))


def search_text(registry: search.Registry, text: str, embedder: Scorer, k: int, **how: object) -> DataFrame:
    """search.search by one text; how: its other arguments."""
    vector = embed_query(registry.get(how.get("index"), how.get("document_id")).vectors, text, embedder)  # type: ignore[arg-type]
    return search.search(registry, vector, k, **how)  # type: ignore[arg-type]


def embed_missing(chunks: DataFrame, embedder: Scorer, dimension: int, oldest: str, tie: str, limit: int | None = None) -> DataFrame:
    """chunks with vectors in place of missing ones: of all, or of the first by oldest and tie."""
    new = embed(store.unembedded(chunks, "embedding", oldest, tie, limit).select(tie, "text"), embedder, dimension)
    return store.upsert_vectors(chunks, new.select(tie, "embedding"), tie, "embedding", dimension)
