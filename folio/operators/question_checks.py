"""Checks of generated questions: types, difficulty, quality, outside names, and whether a reader's answer is the expected one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T

# Question types.
TYPES = (
    "direct_fact", "factual", "definition", "explanation", "comparison", "numerical", "numerical_fact", "reasoning", "multi_page_synthesis", "who", "what", "when", "where", "why", "how", "how_many",
)
# Types that are hard, and types that are easy if answer and source are short.
HARD = ("multi_page_synthesis", "reasoning", "comparison", "explanation", "why", "how")
SHORT = ("who", "when", "where", "how_many", "numerical", "numerical_fact", "direct_fact")
# Words without content in answers.
FUNCTION_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "as", "because", "while", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "can", "will", "just", "should", "now", "it", "its", "they", "them", "their", "we", "us", "our", "he", "him", "his", "she", "her", "hers", "i", "me", "my", "you", "your", "yours", "was", "were", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing", "would", "could", "of", "to", "in", "out", "on", "off", "from", "for", "with", "at", "by", "is", "are",
)
# Beginnings of questions that say too little; questions that are vague; what no question may end in.
GENERIC = (
    "what is this", "what is that", "what is it", "what is this about", "what does this mean", "what is the meaning of this", "what does this chapter discuss", "what is the book about", "what is learning", "how do computers learn",
    "what is this book about", "what are these",
)
VAGUE = ("what is this", "what is that", "what is it", "what happened", "what did they do", "why is that", "who did this", "what are these", "how did this happen", "what does it do")
DANGLING = r"(?iU)\b(role of|impact of|effect of|because of|because|and|or|but|that|with|from|by|about|in|at|to|which|for|as)\s*\?$"
REFERRING = r"(?iU)\b(?:this|that|these|those|it|they|them|such|the above|the following|the former|the latter)\b"
ANCHORED = r"(?U)\b(?:what|which|who|when|where|why|how)\s+(?:is|are|was|were|did|does|do|can|could|would|should)\s+[^?]*\b(?:[A-Z][a-z]+|\d)\b"
#: Capitalised words that begin questions and name nothing.
QUESTION_STARTS = ("What", "Which", "Where", "When", "Who", "Whom", "Why", "How", "Name", "State", "Define", "Explain", "Compare", "Describe", "Identify", "Give", "List", "Does", "According", "In", "Based", "From")
#: Words that lead to a purpose, which answers no question for a method.
PURPOSE = "in order to"
#: Reasons of quality_failure and what a ledger files them under.
CATEGORIES = {
    "empty": "quality_failure", "too_short": "quality_failure", "too_long": "validation_failure", "no_question_mark": "validation_failure", "leading_punctuation": "quality_failure", "small_first_letter": "validation_failure",
    "several_questions": "validation_failure", "repeated_punctuation": "quality_failure", "same_as_source": "quality_failure", "same_as_answer": "quality_failure", "tautology": "quality_failure", "generic": "validation_failure",
    "ambiguous_reference": "validation_failure", "dangling": "quality_failure", "vague": "quality_failure", "purpose_clause": "validation_failure", "ungrounded": "grounding_failure", "outside_name": "outside_knowledge",
    "unanswerable": "unanswerable", "answer_mismatch": "answer_mismatch",
}


def question_clean(s: Column) -> Column:
    """Single spaces, a capital first, one question mark last; a blank one stays empty."""
    t = F.regexp_replace(T.stripped(s), r"(?U)\s+", " ")
    t = F.regexp_replace(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)), r"(?U)[\s?]+$", "?")
    return F.when((t == "") | t.endswith("?"), t).otherwise(F.concat(t, F.lit("?")))


def question_type(question: Column, hint: Column, multipage: Column) -> Column:
    """A question's type, by what it says and by the type of the answer candidate that it was made from (hint, or null)."""
    q = F.lower(T.stripped(question))
    of = lambda *types: F.coalesce(hint.isin(*types), F.lit(False))
    says = lambda *parts: F.coalesce(q.rlike("|".join(parts)), F.lit(False))
    number = F.when(of("numerical_fact"), "numerical_fact").when(says("^how many") & hint.isNull(), "how_many").otherwise("numerical_fact")
    return (
        F.when(F.coalesce(multipage, F.lit(False)) | of("multi_page_synthesis"), "multi_page_synthesis").when(says("compare", "difference between", "versus", "in contrast", "distinguish between") | of("comparison"), "comparison")
        .when(says("definition of", "what is meant by", "define", "defined as", "what is the concept of") | of("definition"), "definition")
        .when(says("^how many", "^how much", "what percentage", "how high", "what rate") | of("numerical", "numerical_fact"), number).when(says("explain", "what causes", "what is the mechanism"), "explanation")
        .when(says("^why"), F.when(of("explanation"), "explanation").otherwise("why")).when(says("reason", "result of", "consequence of", "impact of", "what follows from") | of("reasoning"), "reasoning")
        .when(says("^who"), "who").when(says("^where"), "where").when(says("^when", "what year", "what date"), "when").when(says("^how"), "how").when(says("^what"), F.when(of("direct_fact"), "direct_fact").otherwise("what"))
        .when(of("direct_fact", "factual"), hint).otherwise("factual")
    )


def difficulty(kind: Column, answer: Column, source: Column) -> Column:
    """hard, medium or easy, by the question's type and the lengths of answer and source."""
    words, chars = T.word_count(answer), F.length(source)
    return F.when(kind.isin(*HARD), "hard").when(kind.isin(*SHORT), F.when((words <= 4) & (chars < 700), "easy").otherwise("medium")).when((words > 6) | (chars > 800), "medium").otherwise("easy")


def answer_text(s: Column) -> Column:
    """An answer for comparison: lower case, punctuation as spaces, single spaces."""
    return T.stripped(F.regexp_replace(F.regexp_replace(F.lower(T.stripped(s)), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def numbers(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(?U)\b(\d+(?:\.\d+)?)\b"), F.lit(1))


def _words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: (w != "") & ~w.isin(*FUNCTION_WORDS))


def _run(part: Column, whole: Column) -> Column:
    """Whether one list of words stands in another as it is; an empty one does."""
    spaced = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    return (F.size(part) == 0) | F.contains(spaced(whole), spaced(part))


def _other_numbers(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def definition_expansion(predicted: Column, expected: Column, question: Column, source: Column) -> Column:
    """A longer answer to a question for a definition: of one term, from a sentence of the source that defines it."""
    term, norm = F.get(_words(answer_text(expected)), 0), answer_text(predicted)
    spaced = lambda s: F.concat(F.lit(" "), s, F.lit(" "))

    def defines(sentence: Column) -> Column:
        s = answer_text(sentence)
        says = lambda *parts: F.contains(spaced(s), F.concat(F.lit(" "), *parts, F.lit(" ")))
        return F.contains(s, norm) & (says(F.lit("definition of "), term, F.lit(" is")) | says(term, F.lit(" is defined as")) | says(term, F.lit(" refers to")))

    asked = question.rlike(r"(?iU)\b(?:definition|define|meaning)\b") & (F.size(_words(answer_text(expected))) == 1)
    return F.coalesce(asked & F.contains(spaced(norm), spaced(term)) & F.exists(F.split(source, r"(?<=[.!?])\s+"), defines), F.lit(False))


def clause_match(predicted: Column, expected: Column, question: Column) -> Column:
    """A concise answer where too much was expected: a run of the expected content words, at least half of the others being the question's."""
    p, e = _words(answer_text(predicted)), _words(answer_text(expected))
    left = F.array_except(e, p)
    asked = F.size(F.array_intersect(left, F.split(answer_text(question), " "))) / F.greatest(F.size(left), F.lit(1))
    fits = (F.size(p) >= 3) & (F.size(e) > F.size(p)) & _run(p, e) & ~_other_numbers(numbers(predicted), numbers(expected)) & (asked >= 0.5)
    return F.coalesce(fits, F.lit(False))


def answer_matches(predicted: Column, expected: Column, question: Column, source: Column) -> Column:
    """Whether a reader's answer is the expected one: a definition_expansion, a clause_match, equal, or a run of its content words.

    Numbers of either must be the other's. One expected word among three or more doesn't count, unless numbers agree.
    """
    a, b = answer_text(predicted), answer_text(expected)
    p, e, np, ne = _words(a), _words(b), numbers(predicted), numbers(expected)
    lone = (F.size(e) == 1) & (F.size(p) >= 3) & F.array_contains(p, F.coalesce(F.get(e, 0), F.lit(""))) & ~((F.size(ne) > 0) & (F.size(np) > 0))
    known = F.coalesce((a != "") & (b != ""), F.lit(False))
    plain = ~_other_numbers(np, ne) & ~lone & (F.size(e) <= F.size(p)) & _run(e, p)
    return known & (definition_expansion(predicted, expected, question, source) | clause_match(predicted, expected, question) | (a == b) | plain)


def quality_failure(question: Column, answer: Column, source: Column) -> Column:
    """Why a question is turned down, the first reason; null if it stands."""
    q = F.coalesce(T.stripped(question), F.lit(""))
    first, n = F.substring(q, 1, 1), F.length(q)
    low, src = F.lower(q), F.lower(T.stripped(source))
    norm, ans = answer_text(q), answer_text(answer)
    same = (T.stripped(F.regexp_replace(low, r"\?$", "")) == src) | (low == src)
    tautology = F.exists(F.array(F.lit("who is "), F.lit("what is "), F.lit("where is ")), lambda p: norm == F.concat(p, ans))
    generic = F.exists(F.array(*[F.lit(g) for g in GENERIC]), lambda g: norm.startswith(g))
    return (
        F.when(q == "", "empty").when(n < 8, "too_short").when(n > 250, "too_long").when(~q.endswith("?"), "no_question_mark").when(first.rlike(r"[?!.,;:/\-_]"), "leading_punctuation")
        .when(first.rlike(r"\p{L}") & ~first.rlike(r"\p{Lu}"), "small_first_letter").when(q.rlike(r"(?s)\?.*\?"), "several_questions").when(q.rlike(r"(?U)([?!.,])\s*([?!.,])"), "repeated_punctuation").when(F.coalesce(same, F.lit(False)), "same_as_source")
        .when(F.coalesce(norm == ans, F.lit(False)), "same_as_answer").when(F.coalesce(tautology, F.lit(False)), "tautology").when(generic, "generic").when(q.rlike(REFERRING) & ~q.rlike(ANCHORED), "ambiguous_reference")
        .when(q.rlike(DANGLING), "dangling").when(norm.isin(*VAGUE), "vague")
    )


def outside_names(question: Column, source: Column) -> Column:
    """Capitalised words of a question that its source doesn't have, in order."""
    names = F.regexp_extract_all(question, F.lit(r"(?U)\b([A-Z][a-z]{2,})\b"), F.lit(1))
    return F.filter(names, lambda x: ~x.isin(*QUESTION_STARTS) & ~F.contains(F.lower(source), F.lower(x)))


def judged(candidates: DataFrame) -> DataFrame:
    """candidates (question, answer, source, predicted, trigger) with reason (null: accepted), category and match.

    predicted: what a reader of the source answers to the question, null if nothing; trigger: the words that led to the answer, or null.
    Where the prediction is a definition_expansion or a clause_match, it is the answer from then on: match says which.
    """
    q, answer, source, predicted = (F.col(c) for c in ("question", "answer", "source", "predicted"))
    purpose = F.coalesce(F.col("trigger") == PURPOSE, F.lit(False)) & answer_text(q).rlike(r"^(how |by what method |what method |which method )")
    poor = quality_failure(q, answer, source)
    reason = (
        F.when(poor.isNotNull(), poor).when(purpose, "purpose_clause").when(~F.coalesce(F.contains(F.lower(source), F.lower(T.stripped(answer))), F.lit(False)), "ungrounded").when(F.size(outside_names(q, source)) > 0, "outside_name")
        .when(F.trim(F.coalesce(predicted, F.lit(""))) == "", "unanswerable").when(~answer_matches(predicted, answer, q, source), "answer_mismatch")
    )
    category = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    match = F.when(definition_expansion(predicted, answer, q, source), "definition_expansion").when(clause_match(predicted, answer, q), "clause").otherwise("content_words")
    j = candidates.withColumn("reason", reason).withColumn("category", F.coalesce(F.try_element_at(category, F.col("reason")), F.lit("accepted")))
    return j.withColumn("match", F.when(F.col("reason").isNull(), match))


def rejections(rows: DataFrame) -> DataFrame:
    """(category, n) of judged candidates."""
    return rows.groupBy("category").agg(F.count("*").alias("n"))
