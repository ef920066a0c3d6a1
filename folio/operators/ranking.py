"""Two-stage search: merging the pools of sub-queries, reranking, rank movement, diversity sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(pools: DataFrame) -> DataFrame:
    """pools (plan_id, position, sub_query, item, score, rank) -> one row per (plan, item).

    The row of the greatest score stands for the item, of equal ones the first sub-query's; matched names all sub-queries in order.
    """
    best = F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("position")).alias("p"))
    g = pools.groupBy("plan_id", "item").agg(
        F.max("score").alias("score"), F.max_by("rank", best).alias("original_rank"), F.min("position").alias("first_seen"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "sub_query"))), lambda x: x["sub_query"].cast("string")), ",").alias("matched"),
    )
    rank = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "first_seen", "item"))
    return g.withColumn("rank", rank)


def rerank(pool: DataFrame, rescore: Column, top_n: int, key: str = "query_id") -> DataFrame:
    """Order a pool (key, item, score, rank) by the new score, the old score, the old rank; keep top_n. The pool is cut before this."""
    p = pool.withColumn("new_score", rescore).withColumnRenamed("rank", "original_rank")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("new_score"), F.desc_nulls_last("score"), "original_rank"))
    return p.withColumn("rank", rank).where(F.col("rank") <= top_n)


def invalid_scores(pool: DataFrame, column: str = "new_score") -> DataFrame:
    """The rows that a scorer must not give: missing, NaN or infinite scores."""
    c = F.col(column)
    return pool.where(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def movement(old: str = "original_rank", new: str = "rank") -> Column:
    m = F.col(old) - F.col(new)
    return F.struct(m.alias("moved"), F.when(m > 0, "up").when(m < 0, "down").otherwise("same").alias("direction"))


def display_score(similarity: Column, rerank_score: Column) -> Column:
    """Percent shown: a rerank score through the logistic curve in 5..100, else the similarity in 0..100."""
    pct = F.greatest(F.lit(5.0), F.least(F.lit(100.0), 100 / (1 + F.exp(-rerank_score))))
    return F.round(F.when(rerank_score.isNotNull(), pct).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * similarity))), 2)


def round_robin(rows: DataFrame, group: str, kind: str, position: str, limit: int) -> DataFrame:
    """Up to limit rows of each group, taking kinds in turn in the order in which they first appear."""
    w = Window.partitionBy(group)
    turn = F.row_number().over(Window.partitionBy(group, kind).orderBy(position))
    first = F.min(position).over(Window.partitionBy(group, kind))
    r = rows.withColumn("_turn", turn).withColumn("_first", first)
    return r.withColumn("pick", F.row_number().over(w.orderBy("_turn", "_first", position))).where(F.col("pick") <= limit).drop("_turn", "_first")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their rank in this order. For results that were cut already: they go through one task."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def checked_score(score: Column) -> Column:
    """The score; a missing, NaN or infinite one fails the query."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.raise_error(F.lit("scores must be finite")).cast("double")).otherwise(s)


def board(results: DataFrame, citations: DataFrame, key: str = "answer_id", show: str = "all") -> DataFrame:
    """results (key, chunk_id, rank, original_rank, ...) with citation (null: none), used and promoted; show: all, used or promoted ones."""
    if show not in ("all", "used", "promoted"):
        raise ValueError("show must be all, used or promoted")
    cited = citations.groupBy(key, "chunk_id").agg(F.max("citation").alias("citation"))
    b = results.join(cited, [key, "chunk_id"], "left").withColumns({"used": F.col("citation").isNotNull(), "promoted": F.coalesce(F.col("original_rank") > F.col("rank"), F.lit(False))})
    return b if show == "all" else b.where(show)
