"""An evaluation run: all reports from shared inputs, written with a manifest that makes them complete, and read back by it.

What several reports need is worked out once: marks of answers feed grounding, categories, safety and query types.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators import evaluation, reports
from folio.operators.store import materialise


class IncompleteRun(ValueError):
    """A run without a manifest, or whose tables aren't what its manifest says."""


@dataclass(frozen=True)
class Inputs:
    """first, second: hits of retrieval and of reranking (query_id, item, rank, relevant); relevant (query_id, n_relevant); answers:
    evaluation.grounded_results' input, with category and conflicted; several: multipage_synthesis' input; samples (stage, ms);
    questions: generation_report's input. What is None has no report."""

    first: DataFrame
    second: DataFrame
    relevant: DataFrame
    answers: DataFrame
    several: DataFrame | None = None
    samples: DataFrame | None = None
    questions: DataFrame | None = None


def grounding_report(marks: DataFrame) -> DataFrame:
    """A row for all answers (category null, overall) and one for each category: counts, rates of support, refusals and successes, means."""
    c = F.col
    n = lambda e: F.count_if(e)
    total = lambda name, where=None: F.coalesce(F.sum(name if where is None else F.when(where, c(name))), F.lit(0))
    known, unknown = c("answerable"), ~c("answerable")
    share = lambda a, b, none: F.when(b > 0, F.round(a / F.greatest(b, F.lit(1)), 4)).otherwise(none)
    mean = lambda name, none: F.coalesce(F.round(F.avg(F.when(known, c(name))), 4), F.lit(none))
    success = F.when(n(known) > 0, share(n(c("success")), n(known), 0.0)).otherwise(F.when(F.bool_and(F.coalesce("refusal_correct", F.lit(False))), 1.0).otherwise(0.0))
    return marks.withColumn("category", F.coalesce("category", F.lit("uncategorized"))).groupingSets([[], ["category"]], "category").agg(
        F.grouping("category").cast("boolean").alias("overall"), F.count("*").alias("questions"), n(known).alias("answerable"), n(unknown).alias("unanswerable"), *[total(x).alias(x) for x in ("claims", "supported", "unsupported", "contradicted", "conflicted")],
        share(total("supported"), total("claims"), 0.0).alias("support_rate"), share(total("supported", known), total("claims", known), 0.0).alias("answerable_support_rate"), n(unknown & c("refused")).alias("refusals"), n(c("incorrect_answer")).alias("incorrect_answers"),
        share(n(unknown & c("refused")), n(unknown), 1.0).alias("refusal_precision"), n(c("false_refusal")).alias("false_refusals"), share(n(c("false_refusal")), n(known), 0.0).alias("over_refusal_rate"), success.alias("success_rate"), mean("f1", 0.0).alias("mean_f1"),
        mean("citation_precision", 0.0).alias("mean_citation_precision"), mean("citation_recall", 0.0).alias("mean_citation_recall"),
    )


def tables(inputs: Inputs) -> dict[str, DataFrame]:
    """The reports of a run by name."""
    marks = materialise(evaluation.grounded_results(inputs.answers, "category", "claims", "supported", "unsupported", "contradicted", "conflicted"))
    first, second = (materialise(evaluation.retrieval_metrics(h, inputs.relevant)) for h in (inputs.first, inputs.second))
    grounding = materialise(grounding_report(marks))
    ranks = evaluation.aggregate_retrieval
    out = {
        "retrieval": ranks(first).withColumn("stage", F.lit("retrieval")).unionByName(ranks(second).withColumn("stage", F.lit("reranking"))), "movement": evaluation.compare_stages(first, second), "grounding": grounding.where("overall").drop("category"),
        "categories": grounding.where("not overall").drop("overall"), "safety": evaluation.safety_summary(evaluation.safety_marks(marks)),
    }
    by = first.select("query_id", "rr").join(marks.select("query_id", "category", "answerable", "refused", "success", "false_refusal"), "query_id", "right")
    kinds = by.groupBy("category").agg(
        F.bool_or(~F.col("answerable")).alias("negative"), F.coalesce(F.avg(F.when(~F.col("answerable"), F.col("refused").cast("double"))), F.lit(0.0)).alias("refusal"), F.coalesce(F.avg(F.when(F.col("answerable"), F.coalesce("rr", F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(F.col("answerable"), F.col("success").cast("double"))), F.lit(0.0)).alias("success"), F.count_if("false_refusal").alias("false_refusals"),
    )
    out["query_types"] = kinds.select("category", F.round("refusal", 4).alias("refusal"), F.round("mrr", 4).alias("mrr"), F.round("success", 4).alias("success"), evaluation.verdict(*[F.col(x) for x in ("negative", "refusal", "mrr", "success", "false_refusals")]).alias("status"))
    if inputs.several is not None:
        several = evaluation.multipage_synthesis(inputs.several)
        is_ = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
        status = F.when(F.count("*") == 0, "NOT_EVALUATED").when(F.count_if(F.col("verdict") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("verdict") == "WARNING") > 0, "WARNING").otherwise("PASS")
        out["multipage"] = several.agg(F.count("*").alias("questions"), is_("PASS"), is_("WARNING"), is_("FAIL"), F.coalesce(F.round(F.avg("coverage"), 4), F.lit(0.0)).alias("mean_coverage"), status.alias("status"))
    if inputs.samples is not None:
        stages = materialise(evaluation.latency(inputs.samples, "stage", "ms"))
        out |= {"latency": stages, "latency_total": evaluation.latency_report(stages, "stage")}
    if inputs.questions is not None:
        out["questions"] = evaluation.generation_report(inputs.questions)
    return out


def run(inputs: Inputs, title: str, path: str) -> None:
    """Writes the reports of a run, then the manifest. A run that breaks off leaves no manifest, and one at the same path replaces it."""
    made = {name: materialise(t) for name, t in tables(inputs).items()}
    spark = inputs.answers.sparkSession
    reports.write_report(title, made, path)
    rows = [(name, json.dumps(t.schema.jsonValue()), t.count()) for name, t in made.items()]
    spark.createDataFrame(rows, "name string, kinds string, n bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The reports of a complete run, with the types that they were written with."""
    from pyspark.errors import AnalysisException

    try:
        manifest = spark.read.schema("name string, kinds string, n bigint").json(f"{path}/manifest").collect()
    except AnalysisException as e:
        raise IncompleteRun(f"no manifest in {path}") from e
    found = {r.name: spark.read.schema(StructType.fromJson(json.loads(r.kinds))).json(f"{path}/{r.name}.json") for r in manifest}
    for r in manifest:
        if found[r.name].count() != r.n:
            raise IncompleteRun(f"{r.name} has not the {r.n} rows of the manifest")
    return found


def metrics(report: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """(report, key, metric, value) of a report's numbers."""
    numbers = [f.name for f in report.schema if f.dataType.typeName() in ("double", "long", "integer") and f.name != key]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers])
    return report.select(F.lit(name).alias("report"), (F.col(key).cast("string") if key else F.lit("")).alias("key"), F.explode(pairs).alias("m")).select("report", "key", "m.metric", "m.value")
