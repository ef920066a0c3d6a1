"""Search over named vector indexes: validation, the registry, the candidate pool, and how a document filter is applied."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import ranking, vectors

MOST_RESULTS, LEAST_POOL, OVER_FETCH = 100, 20, 10


class SearchError(ValueError):
    """A request that can't be served as asked."""


class UnknownDocument(SearchError):
    """The document has no vector in the index."""


class UnknownIndex(SearchError):
    """No index of that name, and no default."""


@dataclass
class Index:
    """vectors (vec_id, document_id, embedding, ...); filter "pre": the document's vectors only; "post": the best of all documents first."""

    vectors: DataFrame
    filter: str = "pre"

    def __post_init__(self) -> None:
        if self.filter not in ("pre", "post"):
            raise SearchError("filter must be pre or post")

    def total(self) -> int:
        return self.vectors.where("embedding is not null").count()

    def has_document(self, document_id: str) -> bool:
        return self.vectors.where((F.col("document_id").cast("string") == document_id) & F.col("embedding").isNotNull()).limit(1).count() > 0


@dataclass
class Registry:
    """Indexes by name. The first one, or one that says so, is the default; a document's own index, if there, serves its searches."""

    indexes: dict[str, Index] = field(default_factory=dict)
    default: str | None = None

    def add(self, name: str, index: Index, default: bool = False) -> Index:
        self.indexes[name] = index
        if default or self.default is None:
            self.default = name
        return index

    def get(self, name: str | None = None, document_id: str | None = None) -> Index:
        if name is None and document_id in self.indexes:
            return self.indexes[document_id]
        target = name or self.default
        if target not in self.indexes:
            raise UnknownIndex(f"no index {target!r}; there are {sorted(self.indexes)}")
        return self.indexes[target]


def checked(k: int, pool: int | None, document_id: str | None) -> str | None:
    """The document id without white space around, after checks of all three."""
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_RESULTS:
        raise SearchError(f"k must be from 1 to {MOST_RESULTS}")
    if pool is not None and (isinstance(pool, bool) or not isinstance(pool, int) or pool < k):
        raise SearchError("the candidate pool must be k or more")
    if document_id is not None and not document_id.strip():
        raise SearchError("a document id must not be blank")
    return document_id.strip() if document_id is not None else None


def nearest(index: Index, query: list[float], k: int, document_id: str | None = None) -> DataFrame:
    """(vec_id, score, rank): the k nearest. A post filter looks among the best OVER_FETCH * k of all documents only, so it can find fewer than k."""
    own = F.col("document_id").cast("string") == document_id
    v = index.vectors.where("embedding is not null")
    if document_id is None or index.filter == "pre":
        found = vectors.top_k(v, query, k, own if document_id is not None else None)
    else:
        wide = vectors.top_k(v, query, OVER_FETCH * k)
        found = wide.join(F.broadcast(v.where(own).select("vec_id").join(wide.select("vec_id"), "vec_id", "left_semi")), "vec_id", "left_semi").orderBy(F.desc("score"), "vec_id").limit(k)  # at most OVER_FETCH * k rows
    return ranking.numbered(found, F.desc("score"), F.col("vec_id"))


def search(registry: Registry, query: list[float], k: int, document_id: str | None = None, index: str | None = None, pool: int | None = None, scorer: Column | None = None) -> DataFrame:
    """(vec_id, score, original_rank, new_score, rank): the k best.

    With a scorer, the pool (k or LEAST_POOL, whichever is more, if not given) is cut first and ranked by the scorer's column, which
    may use vec_id and score. An empty index gives no rows, or UnknownDocument if a document is asked for.
    """
    document = checked(k, pool, document_id)
    target = registry.get(index, document)
    if document is not None and not target.has_document(document):
        raise UnknownDocument(f"document {document!r} is not in the index")
    found = nearest(target, query, (pool or max(k, LEAST_POOL)) if scorer is not None else k, document)
    if scorer is None:
        return found.select("vec_id", "score", F.col("rank").alias("original_rank"), F.lit(None).cast("double").alias("new_score"), "rank")
    scored = found.select("vec_id", "score", F.col("rank").alias("original_rank")).withColumn("new_score", ranking.checked_score(scorer))
    return ranking.numbered(scored, F.desc("new_score"), F.desc("score"), F.col("original_rank")).where(F.col("rank") <= k)
