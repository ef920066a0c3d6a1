"""Claims of an answer, their status against evidence, completeness, citations, isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as T
from folio.operators.scoring import Scorer, scored

THRESHOLD = 0.8
# Finite verbs that make a sentence a statement.
VERBS = (
    "is", "are", "was", "were", "has", "have", "had", "do", "does", "did", "can", "could", "will", "would", "should", "may", "might", "must", "calculates", "computes", "optimizes", "encodes", "relies", "measures", "evaluates",
    "counteracts", "mitigates", "concatenates", "discovers", "propagates", "exploits", "operates", "classifies",
)
# What a claim that is a number looks like.
NUMERIC = r"(?i)^(?:(?:a\s+constant\s+)?-?\d+(?:\.\d+)?%?|\d+(?:\.\d+)?\s*(?:percent|%|parameters|layers|units)?)$"
FRAGMENTS = ("noun_phrase", "list", "numerical", "short_span")
#: The most that a fragment which the evidence doesn't hold is entailed by it.
UNHELD = 0.2


def claims(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, claim_index, claim): sentences of three characters or more, white space normalised, numbered from 0 as they stay."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+")
    c = answers.select(key, F.posexplode(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))).alias("at", "claim")).where(F.length("claim") >= 3)
    n = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return c.select(key, n.alias("claim_index"), "claim")


def word_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, as whole words of letters of any script."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


def has_verb(s: Column) -> Column:
    return F.lower(s).rlike(word_of(VERBS))


def claim_form(s: Column) -> Column:
    """numerical, list, short_span, noun_phrase or declarative; a blank claim is a short_span."""
    t = T.stripped(s)
    words = T.word_count(t)
    listed = F.contains(t, F.lit(",")) | F.contains(t, F.lit(" and ")) | F.contains(t, F.lit(" or "))
    return (
        F.when(words == 0, "short_span").when(t.rlike(NUMERIC), "numerical").when(listed & (words <= 12) & ~has_verb(t), "list").when(has_verb(t), "declarative").when(words <= 5, "short_span")
        .otherwise("noun_phrase")
    )


def contextual(question: Column, fragment: Column, form: Column | None = None) -> Column:
    """A fragment as a statement, from what the question asks; a declarative one, and one without a question, stays as it is.

    form: the fragment's claim_form, where it is known.
    """
    q = F.regexp_replace(T.stripped(question), r"[?. ]+$", "")
    bare = F.regexp_replace(T.stripped(fragment), "[.!?]+$", "")
    part = lambda p, k: F.regexp_extract(q, p, k)
    opens = lambda *starts: F.lower(bare).rlike("^(?:" + "|".join(starts) + ")")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    copula, what = r"(?i)^(?:what|which)\s+(is|are|was|were)\s+(?:the\s+)?(.+)", r"(?i)^what\s+(.+)"
    why, how = r"(?i)^why\s+(?:does|did|do|is|are)\s+(.+)", r"(?i)^how\s+(?:does|do|did|can)\s+(.+)"
    several = F.contains(bare, F.lit(",")) | F.contains(bare, F.lit(" and "))
    verb = F.lower(part(copula, 1))
    verb = F.when((verb == "is") & several, "are").otherwise(verb)
    out = (
        F.when(q.rlike(copula), said("The ", T.stripped(part(copula, 2)), " ", verb, " ", bare, ".")).when(q.rlike(what), said("Regarding what ", T.stripped(part(what, 1)), ", it is ", bare, "."))
        .when(q.rlike(why), said(T.stripped(part(why, 1)), " ", F.when(opens("to ", "because", "by ", "in order to"), "").otherwise("because "), bare, "."))
        .when(q.rlike(how), said(T.stripped(part(how, 1)), " ", F.when(opens("by ", "through ", "with ", "using ", "via "), "").otherwise("by "), bare, ".")).otherwise(said("Regarding ", q, ", the answer is ", bare, "."))
    )
    asked = F.coalesce(T.stripped(question), F.lit("")) != ""
    return F.when(asked & ((claim_form(fragment) if form is None else form) != "declarative"), out).otherwise(fragment)


def relevant(claim: Column, evidence: Column) -> Column:
    """Whether any term of the claim, longer than two characters, occurs in the evidence; a claim without such is relevant."""
    return view_scores(claim_view(claim), evidence_view(evidence))["relevant"]


def contains_fragment(fragment: Column, evidence: Column) -> Column:
    """Whether the evidence has the fragment, or three quarters of its terms of two characters or more."""
    low, bare = F.lower(evidence), F.regexp_replace(F.trim(F.lower(fragment)), r"[.!?]+$", "")
    t = T.terms(bare, T.GROUNDING_STOPS, 1)
    return F.contains(low, bare) | ((F.size(t) > 0) & (F.size(F.filter(t, lambda x: F.contains(low, x))) / F.greatest(F.size(t), F.lit(1)) >= 0.75))


#: Words that deny, for the stand-in scorer.
DENIALS = ("not", "no", "never", "none", "nor", "neither", "cannot", "without")


def claim_view(claim: Column) -> Column:
    """struct(tokens, denies, terms): what the stand-in scorers and the relevance test ask of a claim, once, before it meets evidence."""
    return F.struct(T.content_tokens(claim).alias("tokens"), _denies(claim).alias("denies"), T.terms(claim, T.GROUNDING_STOPS, 2).alias("terms"))


def evidence_view(evidence: Column) -> Column:
    """struct(tokens, denies, low) of a piece of evidence."""
    return F.struct(T.content_tokens(evidence).alias("tokens"), _denies(evidence).alias("denies"), F.lower(evidence).alias("low"))


def _denies(s: Column) -> Column:
    return F.arrays_overlap(T.tokens(s), T.among(DENIALS))


def view_scores(claim: Column, evidence: Column) -> dict[str, Column]:
    """entailment, contradiction and relevant of a claim_view and an evidence_view. Stand-in scores, not a language model's.

    Entailment: the share of the claim's content tokens that the evidence has. Contradiction: that share if just one of the two denies.
    """
    t = claim["tokens"]
    share = F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(t, evidence["tokens"])) / F.greatest(F.size(t), F.lit(1)), 6))
    return {
        "entailment": share, "contradiction": F.when(claim["denies"] != evidence["denies"], share).otherwise(F.lit(0.0)),
        "relevant": (F.size(claim["terms"]) == 0) | F.exists(claim["terms"], lambda x: F.contains(evidence["low"], x)),
    }


def lexical_entailment(claim: Column, evidence: Column) -> Column:
    return view_scores(claim_view(claim), evidence_view(evidence))["entailment"]


def lexical_contradiction(claim: Column, evidence: Column) -> Column:
    return view_scores(claim_view(claim), evidence_view(evidence))["contradiction"]


def merged_scores(raw: Column, contextual_scores: Column, fragment: Column, held: Column, threshold: float = THRESHOLD) -> Column:
    """struct(entailment, contradiction, neutral) of a claim judged alone and, if there are scores of it, as a statement: the greater entailment,
    the lesser others.

    A fragment that the evidence doesn't hold is entailed at UNHELD at most, if it had reached the threshold.
    """
    best, least = F.greatest(raw["entailment"], contextual_scores["entailment"]), lambda n: F.least(raw[n], contextual_scores[n])
    capped = F.when(fragment & ~held & (best >= threshold), F.least(best, F.lit(UNHELD))).otherwise(best)
    return F.struct(capped.alias("entailment"), least("contradiction").alias("contradiction"), least("neutral").alias("neutral"))


def judge(claim_rows: DataFrame, evidence: DataFrame, scorer: Scorer, top: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """claim_rows (answer_id, claim_index, claim, question) x evidence (answer_id, evidence_rank, text, ...): each claim against the first
    top pieces of its answer's evidence, with entailment, contradiction, neutral and relevant.

    scorer: struct(entailment, contradiction, neutral) of (evidence, claim). Fragments are judged as statements too.
    """
    first = evidence.withColumn("_n", F.row_number().over(Window.partitionBy("answer_id").orderBy("evidence_rank"))).where(F.col("_n") <= top).drop("_n")
    said = claim_rows.withColumn("_fragment", claim_form(F.col("claim")).isin(*FRAGMENTS)).withColumn("_said", contextual(F.col("question"), F.col("claim")))
    pairs = said.withColumn("_said", F.when(F.col("_fragment") & (F.col("_said") != F.col("claim")), F.col("_said"))).join(first, "answer_id")
    pairs = scored(scored(pairs, scorer, "_raw", "text", "claim"), scorer, "_ctx", "text", "_said")
    held = contains_fragment(F.col("claim"), F.col("text"))
    pairs = pairs.withColumn("_m", merged_scores(F.col("_raw"), F.col("_ctx"), F.col("_fragment"), held, threshold)).withColumn("relevant", relevant(F.col("claim"), F.col("text")))
    return pairs.select("*", "_m.*").drop("_m", "_raw", "_ctx", "_said", "_fragment")


def softmax(logits: Column) -> Column:
    """Scores that sum to 1 of an array of logits; null or not finite logits fail."""
    bad = F.exists(logits, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checked = F.when(bad, F.raise_error(F.lit("logits must be finite"))).otherwise(logits)
    e = F.transform(checked, lambda x: F.exp(x - F.array_max(checked)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def claim_status(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pairs (answer_id, claim_index, evidence_rank, entailment, contradiction, relevant) -> a row per claim.

    The best evidence is the first of the greatest entailment, neutral that row's; contradiction counts from relevant evidence only.
    """
    best = F.struct(F.col("entailment"), (-F.col("evidence_rank")).alias("r"))
    against = F.when(F.col("relevant"), F.col("contradiction"))
    more = [F.max_by("neutral", best).alias("neutral")] if "neutral" in pairs.columns else []
    g = pairs.groupBy("answer_id", "claim_index").agg(F.max("entailment").alias("entailment"), F.max_by("evidence_rank", best).alias("best_evidence"), F.coalesce(F.max(against), F.lit(0.0)).alias("contradiction"), *more)
    e, c = F.col("entailment") >= threshold, F.col("contradiction") >= threshold
    return g.withColumn("status", F.when(e & ~c, "entailed").when(c & ~e, "contradicted").when(e & c, "conflicted").otherwise("unsupported"))


def answer_report(claim_rows: DataFrame) -> DataFrame:
    """A row per answer: counts by status, the share of entailed claims, the overall status by precedence."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = claim_rows.groupBy("answer_id").agg(F.count("*").alias("claims"), n("entailed").alias("supported"), n("contradicted").alias("contradicted"), n("conflicted").alias("conflicted"), n("unsupported").alias("unsupported"))
    status = F.when(F.col("contradicted") > 0, "contradicted").when(F.col("conflicted") > 0, "conflicted").when(F.col("unsupported") > 0, "unsupported").otherwise("grounded")
    return g.withColumn("score", F.round(F.col("supported") / F.col("claims"), 4)).withColumn("overall", status)


def too_far(similarity: Column) -> Column:
    """Evidence of so little similarity that it counts as none; where no similarity is over 0 it can't be told."""
    return (similarity > 0) & (similarity < 0.2)


def policy(strict: bool, checked: bool = True) -> Column:
    """An answer's fate, first rule that fits, over columns ambiguous, n_evidence, max_similarity, answer, overall, claims, isolated, completeness.

    Strict: anything but a grounded overall status, or incomplete_after_retry, is refused; else nothing is. An answer whose claims aren't
    checked stands as it is.
    """
    bad = (F.col("overall") != "grounded") | (F.col("completeness") == "incomplete_after_retry") if strict else F.lit(False)
    return (
        F.when(F.col("ambiguous"), "needs_clarification").when(F.col("n_evidence") == 0, "no_evidence").when(too_far(F.col("max_similarity")), "low_similarity")
        .when(F.trim(F.coalesce("answer", F.lit(""))) == "", "no_answer").when(F.lit(not checked), "unchecked").when(F.coalesce("claims", F.lit(0)) == 0, "no_claims").when(~F.col("isolated"), "isolation_error").when(bad, "refused").otherwise("answered")
    )


def aspect_covered(aspect: Column, other: Column, answer: Column) -> Column:
    """Whether an answer treats an aspect of a comparison: its phrase, else a term of its own, else (without such) any term over two characters."""
    low, mine = F.lower(answer), T.terms(aspect, T.COMPLETENESS_STOPS, 0)
    own = F.array_except(mine, T.terms(other, T.COMPLETENESS_STOPS, 0))
    any_of = lambda t: F.exists(t, lambda x: F.contains(low, x))
    return F.contains(low, F.lower(F.trim(aspect))) | F.when(F.size(own) > 0, any_of(own)).otherwise(any_of(F.filter(mine, lambda x: F.length(x) > 2)))


def sub_question_covered(question: Column, answer: Column) -> Column:
    """Whether an answer has a term of a part of the question, longer than two characters; a part without such is covered."""
    low, t = F.lower(answer), T.terms(question, T.COMPLETENESS_STOPS, 2)
    return (F.size(t) == 0) | F.exists(t, lambda x: F.contains(low, x))


def missing_components(kind: Column, aspects: Column, parts: Column, answer: Column) -> Column:
    """What an answer leaves out of its question, as an array: both aspects of a comparison, else the parts of a question of several.

    A blank answer lacks "full_answer".
    """
    sides = F.filter(F.zip_with(aspects, F.reverse(aspects), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: ~aspect_covered(p["a"], p["b"], answer))
    of_sides = F.when(((kind == "comparison") | (F.size(aspects) > 0)) & (F.size(aspects) >= 2), F.transform(sides, lambda p: p["a"]))
    of_parts = F.when((kind.isin("multi_part", "multi_page") | (F.size(parts) > 0)) & (F.size(parts) >= 2), F.filter(parts, lambda p: ~sub_question_covered(p, answer)))
    none = F.array().cast("array<string>")
    blank = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return F.when(blank, F.array(F.lit("full_answer"))).when(F.size(of_sides) > 0, of_sides).when(F.size(of_parts) > 0, of_parts).otherwise(none)


def retry_instruction(kind: Column, aspects: Column, parts: Column) -> Column:
    """What the one further attempt at an incomplete answer is told; null if no further attempt applies."""
    both = F.concat(F.lit("Compare both concepts using only the provided context. Ensure you explicitly explain both "), F.get(aspects, 0), F.lit(" and "), F.get(aspects, 1), F.lit(":"))
    each = F.concat(F.lit("Answer all parts of the question thoroughly using only the provided context. Ensure you address: "), F.array_join(parts, ", and "), F.lit(":"))
    return F.when((kind == "comparison") & (F.size(aspects) >= 2), both).when(kind.isin("multi_part", "multi_page") & (F.size(parts) > 0), each)


def answered(plans: DataFrame) -> DataFrame:
    """plans (class, aspects, parts, first_answer, second_answer) -> with answer, completeness, regenerated: at most one further attempt.

    An incomplete answer is tried again where an instruction applies; a blank second answer leaves the first one, as incomplete_attempt_1.
    """
    kind, a, b = F.col("class.type"), F.col("aspects"), F.col("parts")
    blank = lambda s: F.trim(F.coalesce(s, F.lit(""))) == ""
    p = plans.withColumn("_lacks", F.size(missing_components(kind, a, b, F.col("first_answer")))).withColumn("instruction", retry_instruction(kind, a, b))
    again = (F.col("_lacks") > 0) & ~blank(F.col("first_answer")) & F.col("instruction").isNotNull() & ~blank(F.col("second_answer"))
    p = p.withColumn("_again", again).withColumn("_lacks2", F.size(missing_components(kind, a, b, F.col("second_answer"))))
    status = F.when(blank(F.col("first_answer")) | (F.col("_lacks") == 0), "complete").when(~F.col("_again"), "incomplete_attempt_1").when(F.col("_lacks2") == 0, "complete").otherwise("incomplete_after_retry")
    regenerated = (F.col("_lacks") > 0) & ~blank(F.col("first_answer"))
    return p.withColumn("completeness", status).withColumn("answer", F.when(F.col("_again"), F.trim("second_answer")).otherwise(F.trim("first_answer"))).withColumn("regenerated", regenerated).drop("_lacks", "_lacks2", "_again")


def references(pairs: DataFrame, claim_rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """What claims refer to, for citations: pairs (answer_id, claim_index, evidence_rank, document_id, chunk_id, scores, relevant), claim_status rows.

    An entailed or conflicted claim is supported by all evidence at the threshold, a contradicted or conflicted one has what relevant
    evidence contradicts it; an unsupported one refers to nothing.
    """
    j = pairs.join(claim_rows.select("answer_id", "claim_index", "status"), ["answer_id", "claim_index"])
    ref = lambda kind, fits: j.where(fits).select("answer_id", "claim_index", F.lit(kind).alias("kind"), F.col("evidence_rank").alias("position"), "document_id", "chunk_id")
    supports = ref("supports", F.col("status").isin("entailed", "conflicted") & (F.col("entailment") >= threshold))
    return supports.unionByName(ref("contradicts", F.col("status").isin("contradicted", "conflicted") & F.col("relevant") & (F.col("contradiction") >= threshold)))


def citations(refs: DataFrame) -> DataFrame:
    """refs (answer_id, claim_index, kind, position, document_id, chunk_id) -> numbered references.

    A chunk's number is its order of first use: claims in order, supports before contradicts. A claim refers to a chunk once per kind.
    """
    use = F.struct("claim_index", F.when(F.col("kind") == "supports", 0).otherwise(1).alias("k"), "position")
    once = refs.groupBy("answer_id", "claim_index", "kind", "document_id", "chunk_id").agg(F.min(use).alias("use"))
    first = F.min("use").over(Window.partitionBy("answer_id", "document_id", "chunk_id"))
    n = F.dense_rank().over(Window.partitionBy("answer_id").orderBy("_first", "document_id", "chunk_id"))
    numbered = once.withColumn("_first", first).withColumn("citation", F.concat(F.lit("cite_"), n.cast("string")))
    return numbered.select("answer_id", "document_id", "chunk_id", "claim_index", "kind", "citation")


def isolation(used: DataFrame, expected: Column | None = None) -> DataFrame:
    """A row per answer: whether its evidence comes from one document (the expected one if given). Blank ids don't count."""
    d = F.when(F.trim(F.col("document_id").cast("string")) != "", F.col("document_id").cast("string"))
    wrong = F.count_if(d != expected.cast("string")) if expected is not None else F.lit(0)
    g = used.groupBy("answer_id").agg(F.count_distinct(d).alias("documents"), wrong.alias("wrong"))
    return g.select("answer_id", "documents", ((F.col("documents") <= 1) & (F.col("wrong") == 0)).alias("isolated"))
