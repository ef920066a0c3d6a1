"""Text as Column expressions: normalising, cleaning, sentences, counts, token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations after which a full stop ends no sentence, whatever their case; nor does one after a single letter.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "e.g", "i.e", "fig", "al", "vol", "p", "pp", "no", "sec", "dept", "approx", "est")
_STOPPED = "(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")"
#: Where a sentence ends: marks and closing quotes, not after an abbreviation or initial as the last token, before a capital, digit or
#: opening quote. One pattern for Column expressions and for the chunker's regex module.
SENTENCE_END = "([.!?]+[\"'”’)]*)(?<!(?:^|\\s)(?:(?i:" + _STOPPED + ")|\\p{L})[.!?\"'”’)\\]]{1,9})\\s+(?=[A-Z0-9\"'“‘])"

#: White space of any script, as (?U)\\s has it.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Words without content, a list for each use.
GROUNDING_STOPS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "over", "after", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "what", "which", "who", "whom", "this", "that", "these", "those", "how", "why", "where", "when", "can", "could", "will", "would", "regarding", "answer", "according", "terms", "question",
)
COMPLETENESS_STOPS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "over", "after", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "what", "which", "who", "whom", "this", "that", "these", "those", "how", "why", "where", "when", "can", "could", "will", "would", "terms", "between", "difference", "differences", "compare",
)
ELIGIBILITY_STOPS = (
    "the", "and", "or", "but", "if", "else", "when", "where", "how", "what", "why", "who", "which", "is", "are", "was", "were", "to", "of", "in", "for", "on", "by", "with", "a", "an", "as", "that", "this", "these", "those",
)
QUESTION_STOPS = (
    "is", "the", "are", "was", "were", "a", "an", "of", "in", "to", "for", "with", "by", "on", "at", "from", "does", "do", "did", "can", "could", "would", "should", "definition", "meaning", "concept", "type", "types", "it", "its",
    "they", "them", "their", "this", "that", "these", "those", "be", "been", "being",
)
ANSWER_STOPS = (
    "a", "an", "the", "and", "or", "but", "if", "because", "as", "what", "which", "this", "that", "these", "those", "then", "just", "so", "than", "such", "both", "through", "about", "for", "is", "of", "while", "during", "to", "from",
    "in", "out", "on", "off", "again", "further", "once", "here", "there", "when", "where", "why", "how", "all", "any", "each", "few", "more", "most", "other", "some", "no", "nor", "not", "only", "own", "same", "too", "very", "can",
    "will", "don", "should", "now", "it", "its", "they", "them", "their", "we", "us", "our", "he", "him", "his", "she", "her", "hers", "i", "me", "my", "you", "your", "yours", "was", "were", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "would", "could",
)
PLANNER_STOPS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "over", "after", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "what", "which", "who", "whom", "this", "that", "these", "those", "how", "why", "where", "when", "can", "could", "will", "would", "should", "may", "might", "must", "give", "tell", "explain", "describe", "compare", "list",
    "summarize", "define", "name", "show",
)


def stripped(s: Column) -> Column:
    """Without white space of any script around."""
    return F.btrim(s, F.lit(WHITE))


def line_endings(s: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(s, r"\r\n?", "\n")


def dehyphenate(s: Column) -> Column:
    """A word broken at a line's end is joined if it goes on in lower case; before a capital the hyphen stays."""
    low = F.regexp_replace(s, r"(?U)(\b[a-zA-Z]{2,})-[^\S\n]*\n[^\S\n]*([a-z]{2,})\b", "$1$2")
    both = F.regexp_replace(low, r"(?U)(\b[a-zA-Z]{2,})-[^\S\n]*\n[^\S\n]*([A-Z][a-zA-Z]+)\b", "$1-$2")
    # few texts have a hyphen at a line's end: the others don't go through the dearer patterns
    return F.when(s.rlike(r"(?U)-[^\S\n]*\n"), both).otherwise(s)


def horizontal(s: Column) -> Column:
    """Runs of white space other than line breaks become one space."""
    return F.regexp_replace(s, r"(?U)[^\S\n]+", " ")


def clean(s: Column) -> Column:
    """Line endings, hyphenation, white space; lines of a paragraph are joined unless one is structured; paragraphs stand apart by a blank line."""
    s = horizontal(dehyphenate(line_endings(s)))

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        marked = F.exists(lines, lambda x: x.rlike(r"^([-*•–—]\s|\d+[.)]\s|[>#]\s)"))
        return F.when(marked, F.array_join(lines, "\n")).otherwise(F.array_join(lines, " "))

    joined = F.transform(F.split(s, r"\n{2,}"), paragraph)
    joined = F.filter(F.transform(joined, lambda p: F.regexp_replace(p, " {2,}", " ")), lambda p: p != "")
    return F.trim(F.array_join(joined, "\n\n"))


def sentences(s: Column) -> Column:
    """Sentences, cut at SENTENCE_END."""
    cut = F.regexp_replace(s, SENTENCE_END, "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def char_count(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0))


def word_count(s: Column) -> Column:
    """Tokens between Unicode white space."""
    return F.size(F.filter(F.split(F.coalesce(s, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def tokens(s: Column) -> Column:
    """Lower-case alphanumeric tokens in order."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"([a-z0-9]+)"), F.lit(1))


def among(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def content_tokens(s: Column, stops: tuple[str, ...] = GROUNDING_STOPS) -> Column:
    """Distinct lower-case alphanumeric tokens without stop words."""
    return F.array_distinct(F.array_except(tokens(s), among(stops)))


def terms(s: Column, stops: tuple[str, ...], longer: int) -> Column:
    """Lower-case runs of ASCII letters, digits and + - * between word boundaries, longer than so many characters, without stop words."""
    found = F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\b([a-zA-Z0-9+\-*]+)\b"), F.lit(1))
    return F.filter(F.array_except(found, among(stops)), lambda x: F.length(x) > longer)


def question_key(s: Column) -> Column:
    """A question for comparison: lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", " "))


def question_tokens(s: Column) -> Column:
    """A question's set of content words; of all its words if none is left."""
    words = F.array_distinct(F.filter(F.split(question_key(s), " "), lambda x: x != ""))
    content = F.array_except(words, among(QUESTION_STOPS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalised_answer(s: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    s = F.regexp_replace(F.lower(s), r"[!-/:-@\[-`{-~]", "")
    s = F.regexp_replace(s, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def answer_tokens(s: Column) -> Column:
    return F.filter(F.split(normalised_answer(s), " "), lambda x: x != "")


def content_id(s: Column, prefix: str = "doc_") -> Column:
    """An id from the content: the prefix and 16 hex digits of its SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(s, 256), 1, 16))
