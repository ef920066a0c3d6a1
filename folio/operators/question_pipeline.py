"""Question generation end to end, with a ledger: eligible chunks, candidates, a pool of each document, questions, duplicates, checks, selection.

Every candidate, and every chunk that isn't eligible, has one row in the ledger, which says at what stage it ended and why. Documents are
independent: all stages are joins and windows by document, and what is held of a document at once is its pool.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as T
from folio.operators import candidates as C
from folio.operators import question_checks as Q
from folio.operators import questions
from folio.operators.scoring import Scorer, scored
from folio.operators.store import materialise

#: A document's pool holds so many times the questions asked for, at least two more.
MULTIPLIER = 3


@dataclass(frozen=True)
class Request:
    """What is asked of each document. diverse: the pool takes types in turn; kind, level: wanted type and difficulty, filled up with others."""

    count: int = 5
    kind: str | None = None
    level: str | None = None
    diverse: bool = True

    def __post_init__(self) -> None:
        if self.count < 1:
            raise ValueError("count must be 1 or more")
        if self.kind is not None and self.kind not in Q.TYPES:
            raise ValueError(f"kind must be one of {Q.TYPES}")

    @property
    def pool(self) -> int:
        return max(self.count * MULTIPLIER, self.count + 2)


def extracted(chunks: DataFrame, kind: str | None = None) -> DataFrame:
    """All candidates of chunks, in order: a document's chunks one after another, then what contrasts neighbouring pages; of one type, if given."""
    plain = C.answer_candidates(chunks).withColumn("pages", F.array("page_number")).withColumn("late", F.lit(0))
    both = plain.unionByName(C.contrasts(chunks).withColumn("late", F.lit(1))) if kind in (None, "multi_page_synthesis") else plain
    both = both if kind is None else both.where(F.col("type") == kind)
    return both.withColumn("at", F.struct("late", "page_number", "chunk_index", "chunk_id", "position"))


def pooled(found: DataFrame, request: Request) -> DataFrame:
    """found with turn, its place in its document's pool; null beyond it.

    A document with more candidates than the pool takes types in turn, in the order in which they first appear (if diverse); any other
    takes candidates as they come. Only the first candidates of each type reach a window over a document.
    """
    doc, most = "document_id", request.pool
    types = found.groupBy(doc, "type").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    totals = types.groupBy(doc).agg(F.sum("_n").alias("_total"))
    own = found.withColumn("_own", F.row_number().over(Window.partitionBy(doc, "type").orderBy("at")))
    near = own.where(F.col("_own") <= most).join(types.drop("_n"), [doc, "type"]).join(totals, doc)
    spread = (F.col("_total") > most) & F.lit(request.diverse)
    order = [F.when(spread, F.col("_own")).otherwise(0), F.when(spread, F.col("_first")), "at"]
    turn = near.withColumn("turn", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where(F.col("turn") <= most)
    return found.join(turn.select(doc, "at", "turn"), [doc, "at"], "left")


def _reasons(answers: bool) -> Column:
    """A document's _pool folded in order: why each row repeats an earlier one, or null. What stays is compared with what follows."""
    empty = F.from_json(F.lit("[]"), "array<struct<raw string, norm string, tokens array<string>, answer string>>")

    def reason(seen: Column, x: Column) -> Column:
        known = x["answer"].isNull() | F.exists(seen, lambda k: (k["norm"] == x["norm"]) & k["answer"].eqNullSafe(x["answer"])) if answers else F.lit(True)
        other = lambda k: k["answer"].isNotNull() & x["answer"].isNotNull() & (k["answer"] != x["answer"])
        near = lambda k: ~F.coalesce(other(k), F.lit(False)) & (F.size(k["tokens"]) > 0) & (F.size(x["tokens"]) > 0) & (T.jaccard(k["tokens"], x["tokens"]) >= questions.NEAR)
        return (
            F.when(x["raw"] == "", "empty_question").when(x["norm"] == "", "empty_normalized_question").when(F.exists(seen, lambda k: k["raw"] == x["raw"]) & known, "exact_duplicate")
            .when(F.exists(seen, lambda k: k["norm"] == x["norm"]) & known, "normalized_duplicate").when(F.exists(seen, near), "near_duplicate")
        )

    start = F.struct(empty.alias("seen"), F.from_json(F.lit("[]"), "array<string>").alias("reasons"))

    def step(acc: Column, x: Column) -> Column:
        why = reason(acc["seen"], x)
        stays = F.struct(x["raw"].alias("raw"), x["norm"].alias("norm"), x["tokens"].alias("tokens"), x["answer"].alias("answer"))
        return F.struct(F.when(why.isNull(), F.concat(acc["seen"], F.array(stays))).otherwise(acc["seen"]).alias("seen"), F.concat(acc["reasons"], F.array(why)).alias("reasons"))

    return F.aggregate("_pool", start, step, lambda acc: acc["reasons"])


def duplicates(rows: DataFrame, *, answers: bool) -> DataFrame:
    """rows (document_id, turn, question, answer) with duplicate: why a question repeats an earlier one of its document that stays, or null.

    answers: questions whose answers differ repeat nothing but where they are known to. A document's rows are its pool at most.
    """
    answer = T.question_key(F.col("answer"))
    x = F.struct("turn", T.stripped(F.col("question")).alias("raw"), T.question_key(F.col("question")).alias("norm"), T.question_tokens(F.col("question")).alias("tokens"), (F.when(answer != "", answer) if answers else F.lit(None).cast("string")).alias("answer"))
    pool = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(x)).alias("_pool"))
    marks = pool.select("document_id", F.explode(F.arrays_zip(F.transform("_pool", lambda p: p["turn"]).alias("turn"), _reasons(answers).alias("duplicate"))).alias("m"))
    return rows.join(marks.select("document_id", "m.turn", "m.duplicate"), ["document_id", "turn"])


def generate(chunks: DataFrame, ask: Scorer, read: Scorer, request: Request = Request(), heading: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, ledger) of chunks (document_id, chunk_id, page_number, chunk_index, text).

    ask: string of (answer, source); read: string of (question, source), null or blank where the source has no answer. ledger
    (document_id, chunk_id, type, answer, question, stage, category, reason): stages are eligibility, sampling, duplicates, validation,
    final_duplicates, selection (validated, not needed) and returned. questions: the returned ones, with type, difficulty, pages, place.
    """
    doc = "document_id"
    marked = materialise(questions.eligible(chunks, "text", heading))
    found = materialise(pooled(extracted(marked.where("eligible"), request.kind), request))
    pool = found.where("turn is not null")
    asked = scored(pool, ask, "_said", "answer", "text").withColumn("question", Q.question_clean(F.coalesce("_said", F.lit("")))).drop("_said")
    asked = materialise(duplicates(asked, answers=True))
    unique = scored(asked.where("duplicate is null"), read, "predicted", "question", "text").withColumn("source", T.stripped(F.col("text")))
    judged = materialise(Q.judged(unique.withColumn("answer", T.stripped(F.col("answer")))))
    good = judged.where("reason is null").withColumn("answer", F.when(F.col("match") == "content_words", F.col("answer")).otherwise(T.stripped(F.col("predicted"))))
    several = (F.size("pages") > 1) | (F.col("type") == "multi_page_synthesis")
    good = good.withColumn("question_type", Q.question_type(F.col("question"), F.col("type"), several))
    # how hard it is goes by the answer that was expected
    expected = judged.select(doc, "turn", F.col("answer").alias("_expected"))
    good = good.join(expected, [doc, "turn"]).withColumn("difficulty", Q.difficulty(F.col("question_type"), F.col("_expected"), F.col("source"))).drop("duplicate", "_expected")
    final = materialise(duplicates(good, answers=False))
    fits = (F.lit(request.kind is None) | (F.col("question_type") == F.lit(request.kind))) & (F.lit(request.level is None) | (F.col("difficulty") == F.lit(request.level)))
    picked = final.where("duplicate is null").withColumn("_pick", F.row_number().over(Window.partitionBy(doc).orderBy(F.when(fits, 0).otherwise(1), "turn")))
    picked = materialise(picked.withColumn("returned", F.col("_pick") <= request.count))
    returned = picked.where("returned").select(
        F.concat(F.lit("qgen_"), F.substring(F.sha2(F.concat_ws("\u0001", F.col(doc).cast("string"), "chunk_id", "question"), 256), 1, 16)).alias("question_id"), doc, "chunk_id", "pages", "question", "answer", "question_type",
        "difficulty", F.when(F.col("match") == "content_words", F.col("start")).alias("start"), "source", "predicted", "match", F.col("_pick").alias("rank"),
    )

    def row(rows: DataFrame, stage: str, category: Column, reason: Column) -> DataFrame:
        have = set(rows.columns)
        text = lambda c: (F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
        return rows.select(doc, "chunk_id", text("type"), text("answer"), text("question"), F.lit(stage).alias("stage"), category.alias("category"), reason.alias("reason"))

    ledger = row(marked.where("not eligible").drop("text"), "eligibility", F.col("category"), F.col("reason"))
    for more in (
        row(found.where("turn is null"), "sampling", F.lit("not_sampled"), F.lit("pool")), row(asked.where("duplicate is not null"), "duplicates", F.lit("duplicate"), F.col("duplicate")), row(judged.where("reason is not null"), "validation", F.col("category"), F.col("reason")),
        row(final.where("duplicate is not null"), "final_duplicates", F.lit("duplicate"), F.concat(F.lit("duplicate_after_answer_validation:"), F.col("duplicate"))), row(picked.where("not returned"), "selection", F.lit("not_needed"), F.lit("count")),
        row(picked.where("returned"), "returned", F.lit("accepted"), F.lit("accepted")),
    ):
        ledger = ledger.unionByName(more)
    return returned, ledger


def tallies(ledger: DataFrame) -> DataFrame:
    """(document_id, stage, category, n) of a ledger: a document's accepted and rejected candidates add up to all it had."""
    return ledger.groupBy("document_id", "stage", "category").agg(F.count("*").alias("n"))
