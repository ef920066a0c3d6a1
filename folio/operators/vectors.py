"""Exact vector search: inner-product top-k for one query and for many, filters before or after the cut, audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors of one broadcast block; scores that a task holds at a time.
BLOCK, CELLS = 4096, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v of unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


def score(a: Column, b: Column) -> Column:
    """Similarity held in [-1, 1], to six places."""
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))), 6)


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows most similar to one query, ties by vec_id: ids and scores are cut first, in one top-k over partial top-ks."""
    v = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return v.select("vec_id", score(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def _best(ids: np.ndarray, q: np.ndarray, vid: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best among m, itself left out; ties by vec_id. Only k candidates of a query are sorted."""
    s = np.round(np.clip(q @ m.T, -1, 1), 6)
    s[ids[:, None] == vid[None, :]] = -9
    if s.shape[1] > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]  # the k-th score; all that tie with it stay until the ids decide
        i, j = np.nonzero((s >= least) & (s > -9))
    else:
        i, j = np.nonzero(s > -9)
    v = s[i, j]
    order = np.lexsort((vid[j], -v, i))
    i, j, v = i[order], j[order], v[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return ids[i[keep]], vid[j[keep]], v[keep]


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, *, same_label: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors most similar to each query, itself left out; ties by vec_id.

    Queries go in broadcast blocks of BLOCK, one on the driver at a time. A task multiplies a batch of vectors with a block, CELLS scores at
    a time, and hands on each query's best k, so what is shuffled is k rows per query and batch. same_label: only vectors of the query's label (a filter
    before the cut); a task then multiplies vectors with the queries of their label only.
    """
    spark = vectors.sparkSession
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def found_by(rows: list) -> DataFrame:
        label = np.array([-1 if r.label is None else r.label for r in rows])
        held = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows]), label, np.array([r.embedding for r in rows], float)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, q = held.value
            for b in batches:
                vid, lab = b.column(0).to_numpy(zero_copy_only=False), b.column(1).fill_null(-2).to_numpy(zero_copy_only=False)
                m = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vid), -1)
                for x in np.intersect1d(labels, lab).tolist() if same_label else [None]:
                    own, mine = (labels == x, lab == x) if same_label else (slice(None), slice(None))
                    some, near, at = ids[own], q[own], m[mine]
                    step = max(1, CELLS // max(1, len(at)))
                    for a in range(0, len(some), step):
                        i, j, v = _best(some[a : a + step], near[a : a + step], vid[mine], at, k)
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], schema=schema)

        return vectors.where("embedding is not null").select("vec_id", "label", "embedding").mapInArrow(work, "query_id bigint, vec_id bigint, score double")

    found, rows = None, []
    for r in queries.select("vec_id", "label", "embedding").where("embedding is not null").toLocalIterator():
        rows.append(r)
        if len(rows) >= BLOCK:
            found, rows = found_by(rows) if found is None else found.unionByName(found_by(rows)), []
    if rows:
        found = found_by(rows) if found is None else found.unionByName(found_by(rows))
    if found is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_joined(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """top_k_batch of the query's label by a join on it, for many labels of few vectors each: its work is the pairs of one label."""
    q = queries.where("embedding is not null and label is not null").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("_q"))
    v = vectors.where("embedding is not null").select("vec_id", "label", "embedding")
    pairs = q.join(v, "label").where("query_id <> vec_id").select("query_id", "vec_id", score(F.col("_q"), F.col("embedding")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_post_filter(vectors: DataFrame, queries: DataFrame, k: int, over: int = 10) -> DataFrame:
    """Filter after the cut: the best over * k vectors of any label first, then those of the query's label, at most k; can be fewer than k."""
    wide = top_k_batch(vectors, queries, over * k)
    labels = vectors.select("vec_id", F.col("label").alias("hit_label"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    kept = wide.join(labels, "vec_id").join(asked, "query_id").where("hit_label = query_label")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def dimension_audit(vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: vectors, missing ones, ones of another dimension, not finite ones."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count("*").alias("n"), F.count_if(e.isNull()).alias("missing"), F.count_if(F.size(e) != dimension).alias("wrong_dimension"), F.count_if(bad).alias("not_finite"))


def index_metadata(vectors: DataFrame, group: str) -> DataFrame:
    """One row: vectors, the sorted groups (documents) that they belong to, their dimension. Groups are made distinct before they meet in a task."""
    each = vectors.groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.concat_ws(",", F.sort_array(F.collect_list("g"))).alias("groups"), F.max("d").alias("dimension"))
