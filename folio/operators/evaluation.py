"""Retrieval, answer and latency metrics, and the reports over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
# Mean milliseconds from which a stage counts as a bottleneck; any other stage.
BOTTLENECK_MS = {"ingestion": 500, "embedding": 100, "retrieval": 50, "reranking": 300, "query_understanding": 10, "extractive_qa": 150, "generative_qa": 300, "grounding_nli": 250, "citation_mapping": 20, "question_generation": 800}
BOTTLENECK_OTHER_MS = 250


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """hits (query_id, item, rank, relevant), relevant (query_id, n_relevant) -> recall, precision (over k), reciprocal rank, first rank.

    A query without any hit row counts with zeros. An item that repeats counts at its first rank, but ranks stay as they are.
    """
    first = hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank"), F.max("relevant").alias("relevant"))
    hit = lambda k: F.count_if(F.col("relevant") & (F.col("rank") <= k))
    g = first.groupBy("query_id").agg(*[hit(k).alias(f"hits_{k}") for k in ks], F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"))
    j = relevant.join(g, "query_id", "left")
    n = lambda k: F.coalesce(F.col(f"hits_{k}"), F.lit(0))
    cols = [F.round(F.when(F.col("n_relevant") > 0, n(k) / F.col("n_relevant")).otherwise(0.0), 4).alias(f"recall_{k}") for k in ks]
    cols += [F.round(n(k) / k, 4).alias(f"precision_{k}") for k in ks]
    return j.select("query_id", "n_relevant", *cols, F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 4).alias("rr"), "first_rank")


def aggregate_retrieval(per_query: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over the queries with a relevant item; means of rounded values, rounded."""
    q = per_query.where("n_relevant > 0")
    return q.agg(F.count("*").alias("queries"), *[F.round(F.avg(f"{m}_{k}"), 4).alias(f"{m}_{k}") for m in ("recall", "precision") for k in ks], F.round(F.avg("rr"), 4).alias("mrr"))


def compare_stages(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: mean reciprocal ranks of two stages, their difference, how many first relevant ranks improved, degraded, stayed."""
    j = before.where("n_relevant > 0").select("query_id", F.col("rr").alias("rr1"), F.col("first_rank").alias("r1")).join(after.select("query_id", F.col("rr").alias("rr2"), F.col("first_rank").alias("r2")), "query_id")
    r1, r2 = F.col("r1"), F.col("r2")
    better = (r1.isNull() & r2.isNotNull()) | (r2 < r1)
    worse = (r1.isNotNull() & r2.isNull()) | (r2 > r1)
    out = j.agg(F.round(F.avg("rr1"), 4).alias("mrr_before"), F.round(F.avg("rr2"), 4).alias("mrr_after"), F.count_if(better).alias("improved"), F.count_if(worse).alias("degraded"), F.count_if(~F.coalesce(better, F.lit(False)) & ~F.coalesce(worse, F.lit(False))).alias("unchanged"))
    delta = F.round(F.col("mrr_after") - F.col("mrr_before"), 4)
    effect = F.when((delta > 0) | (F.col("improved") > F.col("degraded")), "improved").when((delta < 0) | (F.col("degraded") > F.col("improved")), "degraded").otherwise("neutral")
    return out.withColumn("delta", delta).withColumn("effect", effect)


def duplicate_rate(hits: DataFrame, key: str, item: str) -> DataFrame:
    n, d = F.count("*"), F.count_distinct(item)
    return hits.groupBy(key).agg(n.alias("n"), F.round((n - d) / n, 4).alias("duplicate_rate"))


def shared_counts(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many tokens two lists of each row share, repeats counted; a null list is empty. Tokens become numbers, which are sorted once."""
    flat = pa.chunked_array([a.flatten(), b.flatten()], pa.string()).combine_chunks()
    code = flat.dictionary_encode()
    codes = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    n, width = len(a), int(codes.max(initial=0)) + 1
    row = np.concatenate([np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in (a, b)])
    cells, cut = row * width + codes, len(a.flatten())
    (x, nx), (y, ny) = (np.unique(part, return_counts=True) for part in (cells[:cut], cells[cut:]))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return pa.array(np.bincount(both // width, np.minimum(nx[i], ny[j]), n).astype(np.int64))


def tokens_shared(a: Column | str, b: Column | str) -> Column:
    """shared_counts of two columns of token arrays, in time that grows with the tokens."""

    @F.arrow_udf("bigint")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        return shared_counts(x, y)

    return count(a, b)


def token_f1(pairs: DataFrame, tokens_a: Column, tokens_b: Column, key: str = "pair_id") -> DataFrame:
    """Multiset token F1 of two token arrays per row, worked out in the row; an empty one scores 0."""
    p = pairs.select(key, F.coalesce(tokens_a, F.array().cast("array<string>")).alias("a"), F.coalesce(tokens_b, F.array().cast("array<string>")).alias("b"))
    p = p.withColumn("common", tokens_shared("a", "b"))
    f1 = F.when(F.col("common") == 0, 0.0).otherwise(2.0 * F.col("common") / (F.size("a") + F.size("b")))
    return p.select(key, "common", F.round(f1, 4).alias("f1"))


def quantiles(samples: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, q0, q1, ...): exact quantiles of each group, linearly interpolated, by selection instead of a buffer of all values.

    Distinct values are counted and dealt out by range; the counts of the ranges before tell which range holds an order statistic.
    """
    from pyspark.sql.window import Window

    from folio.operators.store import materialise

    counted = samples.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    ranged = materialise(counted.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(group, "_part").agg(F.sum("_n").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.withColumn("_before", before).drop("_rows")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(group, "_part").orderBy(value))
    placed = ranged.join(base, [group, "_part"]).withColumn("_upto", upto)
    at = lambda i, p: F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_total") - 1)).alias("at"))
    wanted = parts.groupBy(group).agg(F.sum("_rows").alias("_total")).select(group, F.explode(F.array(*[at(i, p) for i, p in enumerate(shares)])).alias("w"))
    holds = lambda k: (F.col("_upto") > k) & (F.col("_upto") - F.col("_n") <= k)
    low, high = holds(F.floor("w.at")), holds(F.ceil("w.at"))
    found = placed.join(wanted, group).where(low | high).groupBy(group, "w.i").agg(F.max("w.at").alias("at"), F.max(F.when(low, F.col(value))).alias("low"), F.max(F.when(high, F.col(value))).alias("high"))
    found = found.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")))
    return found.groupBy(group).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))])


def latency(samples: DataFrame, stage: str, ms: str) -> DataFrame:
    """Mean, median, linearly interpolated 95th percentile, least and greatest per stage, and whether its mean is a bottleneck's."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in BOTTLENECK_MS.items() for x in kv])[F.col(stage)], F.lit(BOTTLENECK_OTHER_MS))
    g = samples.where(F.col(ms).isNotNull()).groupBy(stage).agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("mean"), F.round(F.min(ms), 4).alias("least"), F.round(F.max(ms), 4).alias("greatest"))
    g = g.join(quantiles(samples, stage, ms, (0.5, 0.95)), stage).withColumns({"median": F.round("q0", 4), "p95": F.round("q1", 4)})
    return g.select(stage, "n", "mean", "median", "p95", "least", "greatest", (F.col("mean") >= limit).alias("bottleneck"))


def latency_report(stats: DataFrame, stage: str) -> DataFrame:
    """One row: the slowest stage (first by name of equal ones), the sums of means, medians and 95th percentiles over the stages."""
    s = F.min(F.struct((-F.col("mean")).alias("m"), F.col(stage).alias("stage")))
    return stats.agg(s.alias("s"), F.round(F.sum("mean"), 4).alias("mean"), F.round(F.sum("median"), 4).alias("median"), F.round(F.sum("p95"), 4).alias("p95")).select(F.col("s.stage").alias("slowest"), "mean", "median", "p95")


def page_coverage(required: Column, retrieved: Column) -> Column:
    """struct(covered, all): the share of required pages among the retrieved, and whether all are."""
    n = F.size(F.array_intersect(required, retrieved))
    return F.struct(F.round(n / F.size(F.array_distinct(required)), 4).alias("covered"), (F.size(F.array_except(required, retrieved)) == 0).alias("complete"))


def verdict(has_unanswerable: Column, refusal: Column, mrr: Column, success: Column, false_refusals: Column) -> Column:
    """PASS, WARNING or FAIL of a query category."""
    negative = F.when(refusal == 1.0, "PASS").when(refusal >= 0.75, "WARNING").otherwise("FAIL")
    positive = F.when((mrr >= 0.8) & (success >= 0.75) & (false_refusals == 0), "PASS").when((mrr >= 0.5) | (success >= 0.5), "WARNING").otherwise("FAIL")
    return F.when(has_unanswerable, negative).otherwise(positive)


def safety(incorrect: Column, refusal_precision: Column, false_refusal: Column) -> Column:
    return F.when(incorrect > 0, "FAIL").when((refusal_precision < 1) | (false_refusal > 0.1), "WARNING").otherwise("PASS")


def grounded(answer: Column, text: Column) -> Column:
    """Whether the text holds the answer, or at least one of its words, in any case; an empty answer or text can't be told and counts."""
    a, t = F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (a == "") | (t == "") | F.contains(t, a) | F.arrays_overlap(F.split(F.trim(a), r"\s+"), F.split(F.trim(t), r"\s+"))


def generation_report(candidates: DataFrame) -> DataFrame:
    """One row on generated questions (chunk_id, page_number, outcome, complete, grounded): volumes, rates of all candidates, provenance, status.

    outcome: accepted, or why not. A chunk's accepted questions have provenance, or grounding, if all of them have.
    """
    was = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    every = lambda c: F.coalesce(F.bool_and(F.when(F.col("outcome") == "accepted", F.coalesce(F.col(c), F.lit(False)))), F.lit(True))
    chunks = candidates.groupBy("chunk_id").agg(
        F.min("page_number").alias("page"), F.count("*").alias("raw"), was("accepted").alias("accepted"), was("duplicate", "near_duplicate").alias("duplicate"), was("answer_mismatch").alias("mismatch"),
        was("unanswerable").alias("unanswerable"), was("low_quality", "syntax_error").alias("quality"), every("complete").alias("complete"), every("grounded").alias("grounded"),
    )
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    held = lambda c: n(F.when(F.col(c), F.col("accepted")))
    t = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), *[n(c).alias(c) for c in ("raw", "accepted", "duplicate", "mismatch", "unanswerable", "quality")], held("complete").alias("complete"), held("grounded").alias("grounded"))
    share = lambda a, b, none: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(none)
    t = t.withColumn("rejected", F.col("raw") - F.col("accepted")).select(
        "chunks", "pages", "raw", "accepted", "rejected", *[share(c, "raw", 0.0).alias(f"{c}_rate") for c in ("accepted", "rejected", "duplicate", "mismatch", "unanswerable", "quality")],
        share("complete", "accepted", 1.0).alias("provenance_rate"), share("grounded", "accepted", 1.0).alias("grounding_rate"),
    )
    good = (F.col("provenance_rate") >= 0.99) & (F.col("grounding_rate") >= 0.95)
    return t.withColumn("status", F.when(F.col("accepted") == 0, "FAIL").when(good, "PASS").otherwise("WARNING"))


def page_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """hits (query_id, rank, page), relevant (query_id, page) -> page recall, precision (over k), reciprocal and first rank, duplicate rate.

    A page that comes again counts again in precision, once in recall. A query without hits counts with zeros.
    """
    wanted = relevant.select("query_id", "page").distinct()
    n = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    h = hits.select("query_id", "rank", "page").join(wanted.withColumn("hit", F.lit(True)), ["query_id", "page"], "left")
    hit = lambda k: F.col("hit") & (F.col("rank") <= k)
    g = h.groupBy("query_id").agg(
        *[F.count_if(hit(k)).alias(f"hits_{k}") for k in ks], *[F.count_distinct(F.when(hit(k), F.col("page"))).alias(f"pages_{k}") for k in ks], F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"),
        F.round((F.count("*") - F.count_distinct("page")) / F.count("*"), 4).alias("page_duplicate_rate"),
    )
    j = n.join(g, "query_id", "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    cols = [F.round(of(f"pages_{k}") / F.col("n_relevant"), 4).alias(f"page_recall_{k}") for k in ks] + [F.round(of(f"hits_{k}") / k, 4).alias(f"page_precision_{k}") for k in ks]
    return j.select("query_id", *cols, F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 4).alias("page_rr"), F.coalesce("page_duplicate_rate", F.lit(0.0)).alias("page_duplicate_rate"))


#: Words by which an evaluated answer declines; statuses that count as declining; token F1 of a right answer.
DECLINES = ("cannot answer", "insufficient evidence", "not provided", "not mentioned", "no evidence", "unanswerable", "cannot determine", "out of scope")
DECLINED = ("insufficient_evidence", "ungrounded", "contradicted")
RIGHT_F1 = 0.35


def declines(answer: Column) -> Column:
    """Whether an answer is missing, empty, or says that it can't be given."""
    a = F.coalesce(answer, F.lit(""))
    return (a == "") | F.exists(F.array(*[F.lit(w) for w in DECLINES]), lambda w: F.contains(F.lower(a), w))


def grounded_results(answers: DataFrame, *keep: str) -> DataFrame:
    """A row per answer (query_id, answerable, status, answer, expected, claims, supported, contradicted, cited, relevant: arrays) with its marks.

    An answerable question that is declined has F1 0; an unanswerable one is right if declined, and must cite nothing. keep: further
    columns that stay.
    """
    from folio.functions import text as T

    c, a = F.col, F.coalesce(F.col("answer"), F.lit(""))
    r = answers.withColumn("refused", F.coalesce(c("status").isin(*DECLINED), F.lit(False)) | declines(a) | (~c("answerable") & (c("supported") == 0)))
    x, y = T.answer_tokens(a), T.answer_tokens(F.coalesce(c("expected"), F.lit("")))
    r = r.withColumns({"_x": x, "_y": y})
    r, x, y, common = r.withColumn("_common", tokens_shared("_x", "_y")), c("_x"), c("_y"), c("_common")
    f1 = F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(x) + F.size(y)))
    known = c("expected").isNotNull() & (c("expected") != "") & ~c("refused")
    r = r.withColumn("f1", F.round(F.when(~c("answerable"), F.when(c("refused"), 1.0).otherwise(0.0)).when(known, f1).otherwise(0.0), 4))
    n, m = F.size("cited"), F.size("relevant")
    valid = F.when(m == 0, n).otherwise(F.size(F.filter("cited", lambda v: F.array_contains("relevant", v))))
    share = lambda p, q, none: F.when(q > 0, F.round(p / F.greatest(q, F.lit(1)), 4)).otherwise(none)
    isolated = F.when(n == 0, 1.0).otherwise(0.0)
    return r.select(
        *keep, "query_id", "answerable", "status", n.alias("citations"), "refused", (c("answerable") != c("refused")).alias("refusal_correct"), (c("answerable") & c("refused")).alias("false_refusal"), (~c("answerable") & ~c("refused")).alias("incorrect_answer"), "f1",
        F.when(c("answerable"), known & (c("f1") >= RIGHT_F1)).otherwise(c("refused")).alias("correct"),
        (c("answerable") & ~c("refused") & F.coalesce(c("status").isin("grounded", "partially_grounded"), F.lit(False)) & (c("contradicted") == 0) & (c("supported") > 0)).alias("success"),
        F.when(c("claims") > 0, F.round(c("supported") / F.greatest("claims", F.lit(1)), 4)).when(c("answerable"), 0.0).otherwise(1.0).alias("support_rate"),
        F.when(c("answerable"), share(valid, n, 0.0)).otherwise(isolated).alias("citation_precision"), F.when(c("answerable"), share(F.size(F.array_intersect("cited", "relevant")), m, 1.0)).otherwise(isolated).alias("citation_recall"),
    )


def safety_marks(results: DataFrame) -> DataFrame:
    """grounded_results with leaked (citations of an unanswerable question) and verdict: PASS, WARNING or FAIL."""
    c = F.col
    leaked = ~c("answerable") & (c("citations") > 0)
    known = F.when(c("false_refusal"), "WARNING").when(F.coalesce(c("status").isin("grounded", "partially_grounded"), F.lit(False)), "PASS").otherwise("WARNING")
    unknown = F.when(c("refused") & ~leaked, "PASS").when(c("incorrect_answer"), "FAIL").otherwise("WARNING")
    return results.withColumn("leaked", leaked).withColumn("verdict", F.when(c("answerable"), known).otherwise(unknown))


def safety_summary(marks: DataFrame) -> DataFrame:
    """One row on safety_marks: precision of refusals, rates of false refusals, wrong answers, safe refusals and questions without leaks, overall status."""
    c = F.col
    n = lambda e: F.count_if(e)
    g = marks.agg(F.count("*").alias("queries"), n(c("answerable")).alias("a"), n(~c("answerable")).alias("u"), n(~c("answerable") & c("refused")).alias("r"), n(c("false_refusal")).alias("f"), n(c("incorrect_answer")).alias("w"), n(c("leaked")).alias("l"), n(~c("answerable") & c("refused") & ~c("leaked")).alias("s"))
    share = lambda a, b, none: F.when(c(b) > 0, c(a) / F.greatest(c(b), F.lit(1))).otherwise(none)
    out = g.select(
        "queries", F.round(share("r", "u", 1.0), 4).alias("refusal_precision"), F.round(share("f", "a", 0.0), 4).alias("false_refusal_rate"), F.round(share("w", "u", 0.0), 4).alias("incorrect_rate"), F.round(share("s", "u", 1.0), 4).alias("safe_refusal_rate"),
        F.round(1 - share("l", "u", 0.0), 4).alias("no_leak_rate"), "w", share("r", "u", 1.0).alias("p"), share("f", "a", 0.0).alias("o"),
    )
    return out.withColumn("status", safety(F.col("w"), F.col("p"), F.col("o"))).drop("w", "p", "o")


def multipage_synthesis(asked: DataFrame) -> DataFrame:
    """asked (query_id, required, retrieved, cited: page arrays, refused, support_rate, unsupported, contradicted) -> coverages and verdict.

    Without required pages all of them count as found and cited.
    """
    c = F.col
    none = F.size("required") == 0
    covered = lambda pages: F.when(none, 1.0).otherwise(F.round(F.size(F.array_intersect("required", pages)) / F.greatest(F.size(F.array_distinct("required")), F.lit(1)), 4))
    holds = lambda pages: F.size(F.array_except("required", pages)) == 0
    good = ~c("refused") & (c("support_rate") >= 0.75) & (c("contradicted") == 0)
    r = asked.select(
        "query_id", holds("retrieved").alias("all_retrieved"), covered("retrieved").alias("coverage"), good.alias("synthesis"), ((c("unsupported") > 0) | (c("contradicted") > 0)).alias("unsupported_information"), holds("cited").alias("all_cited"), covered("cited").alias("citation_coverage"),
    )
    fine = c("all_retrieved") & c("synthesis")
    return r.withColumn("verdict", F.when(fine & ~c("unsupported_information") & c("all_cited"), "PASS").when(fine, "WARNING").otherwise("FAIL"))
