"""An evaluation run whose reports are read back, and transactional storage, as queries with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import evaluation, evaluation_run, store
from folio.plans import catalog
from folio.plans.catalog import GROUNDED_MARKS, REPORT, STATUS
from folio.plans.registry import ORACLES, pages, query, read

#: An answer's category: the language, if any, of the document of its conversation's number, else none.
CATEGORY = "(SELECT any_value(lang) FROM documents WHERE doc_id = query_id // 100)"


def answers(spark, d) -> DataFrame:
    """catalog's graded answers with category and the counts of their claims."""
    lang = read(spark, d, "documents").groupBy(F.col("doc_id").alias("conv")).agg(F.any_value("lang").alias("category"))
    a = catalog.graded_answers(spark, d)
    return a.withColumn("conv", F.floor(F.col("query_id") / 100)).join(lang, "conv", "left").drop("conv")


MARKS = f"""m AS (WITH {STATUS}, {REPORT}, {GROUNDED_MARKS}), k AS (SELECT m.*, coalesce({CATEGORY}, 'uncategorized') AS category FROM m),
w AS (WITH {STATUS}, {REPORT} SELECT answer_id AS query_id, claims, supported, unsupported, contradicted, conflicted FROM rep),
g AS (SELECT k.*, coalesce(w.claims, 0) AS claims, coalesce(w.supported, 0) AS supported, coalesce(w.unsupported, 0) AS unsupported, coalesce(w.contradicted, 0) AS contradicted, coalesce(w.conflicted, 0) AS conflicted FROM k LEFT JOIN w USING (query_id))"""
GROUNDING = f"""WITH {MARKS} SELECT category, CAST(grouping(category) AS BOOLEAN) AS overall, count(*) AS questions, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable, """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("claims", "supported", "unsupported", "contradicted", "conflicted")) + """,
  CASE WHEN sum(claims) > 0 THEN round(sum(supported) / sum(claims), 4) ELSE 0.0 END AS support_rate, coalesce(round(sum(supported) FILTER (answerable) / nullif(sum(claims) FILTER (answerable), 0), 4), 0.0) AS answerable_support_rate,
  count(*) FILTER (NOT answerable AND refused) AS refusals, count(*) FILTER (incorrect_answer) AS incorrect_answers, coalesce(round(count(*) FILTER (NOT answerable AND refused) / nullif(count(*) FILTER (NOT answerable), 0), 4), 1.0) AS refusal_precision, count(*) FILTER (false_refusal) AS false_refusals,
  coalesce(round(count(*) FILTER (false_refusal) / nullif(count(*) FILTER (answerable), 0), 4), 0.0) AS over_refusal_rate,
  CASE WHEN count(*) FILTER (answerable) > 0 THEN round(count(*) FILTER (success) / count(*) FILTER (answerable), 4) WHEN bool_and(refusal_correct) THEN 1.0 ELSE 0.0 END AS success_rate, coalesce(round(avg(f1) FILTER (answerable), 4), 0.0) AS mean_f1,
  coalesce(round(avg(citation_precision) FILTER (answerable), 4), 0.0) AS mean_citation_precision, coalesce(round(avg(citation_recall) FILTER (answerable), 4), 0.0) AS mean_citation_recall FROM g GROUP BY GROUPING SETS ((), (category))"""


@query(GROUNDING)
def grounding_by_category(spark, d):
    marks = evaluation.grounded_results(answers(spark, d), "category", "claims", "supported", "unsupported", "contradicted", "conflicted")
    return evaluation_run.grounding_report(marks)


def _inputs(spark, d) -> evaluation_run.Inputs:
    first, relevant = catalog._hits(spark, d)
    second, _ = catalog._hits(spark, d, invert=True)
    samples = catalog._stages(spark, d).select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return evaluation_run.Inputs(first, second, relevant, answers(spark, d), samples=samples)


def _flat(sql: str, report: str, key: str, metrics: list[str]) -> str:
    """A report's numbers as rows (report, key, metric, value)."""
    names, values = ", ".join(f"'{m}'" for m in metrics), ", ".join(f"CAST({m} AS DOUBLE)" for m in metrics)
    return f"SELECT '{report}' AS report, {key} AS key, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM ({sql})"


_RANKS = ["queries", *(f"{m}_{k}" for m in ("recall", "precision") for k in (1, 3, 5, 10)), "mrr"]
_GROUND = ["questions", "answerable", "unanswerable", "claims", "supported", "unsupported", "contradicted", "conflicted", "support_rate", "answerable_support_rate", "refusals", "incorrect_answers", "refusal_precision", "false_refusals", "over_refusal_rate", "success_rate", "mean_f1", "mean_citation_precision", "mean_citation_recall"]
_SECOND = ORACLES["mrr"].replace("m AS (", "h2 AS (SELECT query_id, vec_id, CAST(11 - rank AS INTEGER) AS rank, rel FROM h), m AS (", 1).replace("LEFT JOIN h h", "LEFT JOIN h2 h2").replace("h.query_id = n.query_id", "h2.query_id = n.query_id")
RUN = " UNION ALL ".join([
    _flat(ORACLES["mrr"], "retrieval", "'retrieval'", _RANKS), _flat(_SECOND, "retrieval", "'reranking'", _RANKS), _flat(ORACLES["stage_comparison"], "movement", "''", ["mrr_before", "mrr_after", "improved", "degraded", "unchanged", "delta"]),
    _flat(f"SELECT * FROM ({GROUNDING}) WHERE overall", "grounding", "''", _GROUND), _flat(f"SELECT * FROM ({GROUNDING}) WHERE NOT overall", "categories", "category", _GROUND),
    _flat(ORACLES["safety_evaluation"], "safety", "''", ["queries", "refusal_precision", "false_refusal_rate", "incorrect_rate", "safe_refusal_rate", "no_leak_rate"]), _flat(ORACLES["latency_percentiles"], "latency", "event_type", ["n", "mean", "median", "p95", "least", "greatest"]),
    _flat(ORACLES["latency_report"], "latency_total", "slowest", ["mean", "median", "p95"]),
])


@query(RUN)
def evaluation_reports(spark, d):
    path = f"{store.scratch(spark)}/run-{uuid.uuid4().hex}"
    evaluation_run.run(_inputs(spark, d), "Evaluation", path)
    found = evaluation_run.read(spark, path)
    keys = {"retrieval": "stage", "categories": "category", "latency": "stage", "latency_total": "slowest"}
    out = None
    for name in ("retrieval", "movement", "grounding", "categories", "safety", "latency", "latency_total"):
        m = evaluation_run.metrics(found[name], name, keys.get(name))
        out = m if out is None else out.unionByName(m)
    return out


def versioned(spark, d, kept: str, version: str) -> dict[str, DataFrame]:
    """Conversations as documents with pages and chunks; their texts bear a version."""
    p = pages(spark, d).where(kept).withColumn("text", F.concat(F.lit(version), F.coalesce("text", F.lit(""))))
    return {"documents": p.select("document_id").distinct(), "pages": p.select("document_id", "page_number", "text"), "chunks": p.select("document_id", "page_number", (F.col("page_number") - 1).alias("chunk_index"), "text")}


@query("""WITH t AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'first ' WHEN conv_id % 4 = 1 THEN 'third ' WHEN conv_id % 4 = 2 THEN 'second ' END AS version, text FROM conversations WHERE conv_id % 4 < 3)
SELECT conv_id AS document_id, count(*) AS pages, min(version) AS version, CAST(sum(length(version) + length(coalesce(text, ''))) AS BIGINT) AS chars, CASE WHEN conv_id % 4 = 2 THEN 'failed' ELSE 'processed' END AS status, conv_id % 4 = 0 AS left_out FROM t GROUP BY conv_id""")
def transactional_replace(spark, d):
    """Documents of four kinds: processed at once and left as they are; failed at first, then replaced; failed; staged by an attempt that broke off."""
    root = f"{store.scratch(spark)}/tables-{uuid.uuid4().hex}"
    store.persist(root, versioned(spark, d, "document_id % 4 = 0", "first "), "a1")
    store.persist(root, versioned(spark, d, "document_id % 4 in (1, 2)", "second "), "a2", "failed")
    store.stage(root, "a3", versioned(spark, d, "document_id % 4 in (2, 3)", "broken "))
    out = store.materialise(store.persist(root, versioned(spark, d, "document_id % 4 in (0, 1)", "third "), "a4"))
    p = store.committed_rows(spark, root, "pages")
    version = F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "))
    g = p.groupBy("document_id").agg(F.count("*").alias("pages"), F.min(version).alias("version"), F.sum(F.length("text")).alias("chars"))
    return g.join(store.latest(spark, root).select("document_id", "status"), "document_id").join(out.withColumn("o", F.lit(True)), "document_id", "left").select("document_id", "pages", "version", "chars", "status", F.coalesce("o", F.lit(False)).alias("left_out"))
