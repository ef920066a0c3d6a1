"""Grounded answers, joined up: plan, retrieve, rerank, pack, write, check, write once more, judge, cite, decide.

Each stage is a DataFrame over all questions at once; questions that an earlier rule has settled don't enter the later stages. Models are
Scorers, so equal inputs of a stage are scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import embedding, evidence, grounding, planner, ranking
from folio.operators.scoring import Scorer, scored
from folio.operators.store import materialise


@dataclass(frozen=True)
class Models:
    """embedder: array<float> of (text); reranker: double of (question, text), or None; writer: string of (prompt);
    judge: struct(entailment, contradiction, neutral) of (evidence, claim), or None where answers aren't checked."""

    embedder: Scorer
    writer: Scorer
    judge: Scorer | None
    reranker: Scorer | None = None


@dataclass(frozen=True)
class Limits:
    """k: evidence kept; pool: what a search finds before that; budget: a prompt's tokens; judged: pieces of evidence that claims meet."""

    k: int = 5
    pool: int = 20
    budget: int = 2048
    judged: int = 5
    threshold: float = grounding.THRESHOLD
    strict: bool = True


@dataclass(frozen=True)
class Grounded:
    """answers: a row per question; claims: a row per judged claim; citations: numbered references."""

    answers: DataFrame
    claims: DataFrame
    citations: DataFrame


_blank = lambda s: F.trim(F.coalesce(s, F.lit(""))) == ""


def retrieve(plans: DataFrame, index: DataFrame, models: Models, limits: Limits) -> DataFrame:
    """(query_id, rank, similarity and the columns of index): each plan's evidence. index: vec_id, label, document_id, page_number, text, embedding.

    plans (query_id, label, normalised, retrieval_queries): a label restricts a question to the vectors that bear it. Every retrieval query
    has a pool of its own, of twice k at least if it is one of several; pools are merged, reranked if there is a model for it, and cut to k.
    """
    n = F.size("retrieval_queries")
    subs = plans.select("query_id", "label", F.when(n > 1, max(limits.pool, 2 * limits.k)).otherwise(max(limits.pool, limits.k)).alias("most"), F.posexplode("retrieval_queries").alias("position", "sub_query"))
    subs = materialise(subs.withColumn("sub_id", F.col("query_id") * 4 + F.col("position")))
    asked = subs.select(F.col("sub_id").alias("query_id"), F.col("sub_query").alias("text"), "label")
    pool = max(limits.pool, 2 * limits.k)
    within = embedding.search_texts(index, asked.where("label is not null"), models.embedder, pool, same_label=True)
    anywhere = embedding.search_texts(index, asked.where("label is null"), models.embedder, pool)
    found = within.unionByName(anywhere).withColumnRenamed("query_id", "sub_id").join(subs, "sub_id").where("rank <= most")
    merged = ranking.merge(found.select(F.col("query_id").alias("plan_id"), "position", "sub_query", F.col("vec_id").alias("item"), "score", "rank"))
    pools = merged.select(F.col("plan_id").alias("query_id"), F.col("item").alias("vec_id"), F.col("score").alias("similarity"), "rank").join(index.select("vec_id", "document_id", "page_number", "text"), "vec_id")
    if models.reranker is None:
        return pools.where(F.col("rank") <= limits.k)
    pools = scored(pools.join(plans.select("query_id", "normalised"), "query_id"), models.reranker, "_score", "normalised", "text")
    ranked = ranking.rerank(pools.withColumnRenamed("similarity", "score"), ranking.checked_score(F.col("_score")), limits.k)
    return ranked.select("query_id", "rank", F.col("score").alias("similarity"), "vec_id", "document_id", "page_number", "text")


def written(asked: DataFrame, contexts: DataFrame, writer: Scorer, instruction: Column, out: str, budget: int) -> DataFrame:
    """asked (query_id, normalised, ...) with out, what the writer says to the prompt of question, context and instruction; null without context."""
    j = asked.join(contexts.select("query_id", "context"), "query_id", "left")
    form = evidence.template(F.lit(None).cast("string"), instruction, F.lit(None).cast("string"), F.lit(budget))
    prompt = F.when(F.col("context").isNotNull(), evidence.filled(form, F.col("context"), F.col("normalised")))
    return scored(j.withColumn("_prompt", prompt), writer, out, "_prompt").drop("_prompt", "context")


def answer(questions: DataFrame, index: DataFrame, models: Models, limits: Limits = Limits()) -> Grounded:
    """questions (query_id, query, label: the document asked, or null) -> their Grounded answers.

    Rules in order: an ambiguous question asks back; no evidence; evidence of a similarity under 0.2 (if any is over 0); no answer; no judge
    (then the answer stands as it is); no claims; evidence of several documents, or of another than the one asked; then the policy: strict
    wants every claim entailed and a complete answer. An incomplete answer is written once more where an instruction applies, by a pass
    over such questions only. A refused answer is null and cites nothing.
    """
    plans = materialise(planner.plan(questions).withColumn("ambiguous", F.col("class.type") == "ambiguous"))
    clear = plans.where("not ambiguous")
    found = materialise(retrieve(clear, index, models, limits))
    near = found.groupBy("query_id").agg(F.count("*").alias("n_evidence"), F.max("similarity").alias("max_similarity"))
    p = plans.join(near, "query_id", "left").withColumns({"n_evidence": F.coalesce("n_evidence", F.lit(0)), "max_similarity": F.coalesce("max_similarity", F.lit(0.0))})
    able = ~F.col("ambiguous") & (F.col("n_evidence") > 0) & ~grounding.too_far(F.col("max_similarity"))
    p = materialise(p.withColumn("_able", able))

    packed = materialise(evidence.pack(found.select("query_id", "rank", F.col("page_number").alias("page"), "text", "vec_id", "document_id"), limits.budget, evidence.OVERHEAD))
    contexts = evidence.prompts(packed)
    first = written(p.where("_able"), contexts, models.writer, F.lit(None).cast("string"), "first_answer", limits.budget)
    kind = F.col("class.type")
    first = first.withColumn("_told", grounding.retry_instruction(kind, F.col("aspects"), F.col("parts"))).withColumn("_lacks", F.size(grounding.missing_components(kind, F.col("aspects"), F.col("parts"), F.col("first_answer"))))
    first = materialise(first)
    retry = first.where((F.col("_lacks") > 0) & ~_blank(F.col("first_answer")) & F.col("_told").isNotNull())
    second = written(retry, contexts, models.writer, F.col("_told"), "second_answer", limits.budget).select("query_id", "second_answer")
    done = materialise(grounding.answered(first.join(second, "query_id", "left").drop("_told", "_lacks")))

    given = done.where(~_blank(F.col("answer")))
    claims = grounding.claims(given.select(F.col("query_id").alias("answer_id"), F.col("answer").alias("text"))).join(given.select(F.col("query_id").alias("answer_id"), F.col("normalised").alias("question")), "answer_id")
    used = packed.select(F.col("query_id").alias("answer_id"), F.col("rank").alias("evidence_rank"), "text", F.col("vec_id").alias("chunk_id"), "document_id")
    if models.judge is None:
        none = claims.limit(0)
        judged = materialise(none.join(used, "answer_id").withColumns({"entailment": F.lit(0.0), "contradiction": F.lit(0.0), "neutral": F.lit(1.0), "relevant": F.lit(True)}))
    else:
        judged = materialise(grounding.judge(claims, used, models.judge, limits.judged, limits.threshold))
    rows = materialise(grounding.claim_status(judged, limits.threshold))
    refs = materialise(grounding.references(judged, rows, limits.threshold))
    expected = plans.where("label is not null").select(F.col("query_id").alias("answer_id"), F.col("label").cast("string").alias("_asked"))
    alone = grounding.isolation(refs.join(expected, "answer_id", "left"), F.col("_asked")).select(F.col("answer_id").alias("query_id"), "isolated")
    report = grounding.answer_report(rows).withColumnRenamed("answer_id", "query_id")

    a = p.select("query_id", "ambiguous", "n_evidence", "max_similarity").join(done.select("query_id", "answer", "completeness", "regenerated"), "query_id", "left").join(report, "query_id", "left").join(alone, "query_id", "left")
    a = a.withColumns({"completeness": F.coalesce("completeness", F.lit("complete")), "regenerated": F.coalesce("regenerated", F.lit(False)), "isolated": F.coalesce("isolated", F.lit(True)), **{c: F.coalesce(c, F.lit(0)) for c in ("claims", "supported", "contradicted", "conflicted", "unsupported")}})
    a = a.withColumn("outcome", grounding.policy(limits.strict, models.judge is not None))
    stands = F.col("outcome").isin("answered", "unchecked")
    status = F.when(F.col("outcome") == "unchecked", "disabled").when(F.col("outcome").isin("no_evidence", "no_answer", "no_claims"), "empty").when(F.col("outcome").isin("answered", "refused"), F.col("overall")).otherwise("unsupported")
    a = a.withColumns({"answer": F.when(stands, F.col("answer")), "answerable": stands, "grounding_status": status, "score": F.when(F.col("outcome") == "unchecked", 1.0).otherwise(F.coalesce("score", F.lit(0.0)))})
    answers = materialise(a.select("query_id", "outcome", "answer", "answerable", "grounding_status", "score", "completeness", "regenerated", "claims", "supported", "contradicted", "conflicted", "unsupported", "n_evidence"))
    kept = refs.join(answers.where("answerable").select(F.col("query_id").alias("answer_id")), "answer_id", "left_semi")
    return Grounded(answers, rows, grounding.citations(kept))
