"""Answer candidates of chunks: typed spans, their validity, and what contrasts two neighbouring pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as T

# Fixed values: (type, group that is the span, whether case is ignored, pattern), in order of precedence.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
PATTERNS = (
    ("when", 0, True, rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:,\s+\d{{4}})?\b"),
    ("when", 0, True, rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b"),
    ("when", 0, False, r"\b(?:17|18|19|20)\d{2}\b"),
    ("numerical", 0, False, r"\b\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\s*%"),
    ("definition", 2, True, r"\b(?:our|the)\s+definition\s+of\s+([A-Za-z][A-Za-z0-9-]*(?:\s+[a-z][A-Za-z0-9-]*){0,3})\s+is\s+([^,.;\n]{10,160})(?=[,.;\n]|$)"),
    ("numerical", 0, True, r"\ba\s+constant\s+\d+(?:\.\d+)?\b"),
    ("numerical", 0, True, r"(?<![\d-])\b\d+(?:\.\d+)?\s*(?:%|(?:\b(?:percent|billion|million|trillion|thousand|hundred|meters|km|miles|kg|seconds|minutes|hours|days|years)\b))"),
    ("numerical", 1, True, r"(?:derivative\s+is\s+|derivative\s+equals\s+)(a\s+constant\s+\d+|\d+(?:\.\d+)?)"),
    ("definition", 2, True, r"\b([A-Z][A-Za-z0-9\s\-]{2,30})\s+(?:is defined as(?!\s+follows\b)|refers to|is a method for|is an algorithm that)\s+([^;\.\n]{10,160})(?=[;\.\n]|$)"),
    ("explanation", 2, True, r"\b(because|in order to|as a result of|by recursively applying)\s+([^;\.\n]{12,160})(?=[;\.\n]|$)"),
    ("comparison", 2, True, r"(?:in contrast(?:\s+to)?|unlike|whereas|compared to)\s+([^,\.\n]{3,100}),\s+([^,\.\n]{3,100})(?=[,\.\n]|$)"),
    ("direct_fact", 1, False, r"\b([A-Z][A-Za-z0-9]*(?:\s+[a-z][A-Za-z0-9-]*){0,3}\s+(?:maps?|optimizes?|computes?|calculates?|transforms?|connects?|minimizes?|maximizes?)\s+[^,;\.\n(]{10,160})(?=[,;\.\n(]|$)"),
    ("who", 0, False, r"\b[A-Z][a-z]+(?:\s+(?:van|von|de|la|of|the|and)\s+[A-Z][a-z]+|\s+[A-Z][a-z]+){1,3}\b"),
    ("factual", 0, False, r"\b[A-Z]{2,}(?:-[0-9A-Z]+|s)?\b"),
    ("definition", 2, False, r"(?<!\w)([\"'])([A-Za-z0-9][A-Za-z0-9\-]*(?:\s+[A-Za-z0-9][A-Za-z0-9\s\-]*){1,3})\1(?!\w)"),
    ("factual", 0, False, r"(?<=[a-z0-9,\(\)]\s)\b[A-Z][a-z]{2,}\b"),
)
# What surrounds a span is no part of it; words that say too little alone; words that no span begins with; headings;
# abbreviations that are no headings though in capitals; signs of publishing matter.
EDGE = " ,.;:'\"()[]"
GENERIC = (
    "linear", "unit", "model", "function", "system", "layer", "method", "process", "value", "term", "component", "program", "programs", "computer", "computers", "algorithm", "algorithms", "data", "problem", "problems", "processes",
)
DANGLING = ("and", "or", "but", "so", "then", "of", "to", "in", "with", "if", "because", "while", "whereas", "unlike", "although", "when", "as")
HEADINGS = ("CHAPTER", "CONTENTS", "INTRODUCTION", "APPENDIX", "FIGURE", "TABLE", "SECTION")
CAPITALS = ("nli", "cnn", "cnns", "relu", "lms", "svm", "svms", "id3", "alvinn", "sphinx", "ace")
NOISE = (
    "mitchell", "tom mitchell", "tom m. mitchell", "mcgraw-hill", "mcgraw hill", "copyright", "rights reserved", "library of congress", "isbn", "dlc", "product details", "publisher", "edition", "printed in",
)
# What a chunk sets against the page before.
CONTRAST = (
    r"(?iU)\b(?:in contrast(?:\s+to)?|unlike|whereas|compared to|on the other hand)\s*,?\s*([A-Za-z0-9][A-Za-z0-9-]*(?:\s+[A-Za-z0-9][A-Za-z0-9-]*){1,3})\s+"
    r"(?=(?:is|are|was|were|process|processes|use|uses|rely|relies|employ|employs|extract|extracts|update|updates)\b)"
)
SHORTEST, LONGEST, MOST = 2, 160, 8
# By pattern, what every match has one of: in any case where the pattern ignores it. Others go over every text.
NEEDS = (
    tuple(MONTHS.lower().split("|")), tuple(MONTHS.lower().split("|")), ("17", "18", "19", "20"), ("%",), ("definition",), ("constant",),
    ("%", "percent", "billion", "million", "trillion", "thousand", "hundred", "meters", "km", "miles", "kg", "seconds", "minutes", "hours", "days", "years"), ("derivative",),
    ("is defined as", "refers to", "is a method for", "is an algorithm that"), ("because", "in order to", "as a result of", "by recursively applying"), ("in contrast", "unlike", "whereas", "compared to"),
    ("map", "optimize", "compute", "calculate", "transform", "connect", "minimize", "maximize"), (), (), ("'", '"'), (),
)
_COMPILED = tuple((kind, group, re.compile(p, re.IGNORECASE if any_case else 0), any_case, needs) for (kind, group, any_case, p), needs in zip(PATTERNS, NEEDS, strict=True))
#: Characters that match a letter of ASCII where case is ignored.
_ALIKE = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def folded(text: str) -> str:
    """text such that what ASCII words match without case is found in it by their small letters."""
    return (text if text.isascii() else text.translate(_ALIKE)).lower()


def invalid(span: str, text: str, start: int | None = None, low_text: str | None = None) -> str | None:
    """Why a span of a text, at start, is no answer, the first reason; None if it is one. low_text: the text folded, if known."""
    words, low = span.lower().split(), span.lower()
    if not SHORTEST <= len(span) <= LONGEST:
        return "length"
    if span.strip() == text.strip():
        return "whole_passage"
    if len(words) == 1 and (low in T.ANSWER_STOPS or low in GENERIC):
        return "stop_word" if low in T.ANSWER_STOPS else "generic_word"
    compound, low_text = re.escape(span), folded(text) if low_text is None else low_text
    # patterns of a span's own are only made where it stands beside a hyphen
    beside = not span.isascii() or f"-{low}" in low_text or f"{low}-" in low_text
    if beside and re.search(rf"\b[A-Za-z0-9]+-{compound}\b|\b{compound}-[A-Za-z0-9]+\b", text, re.IGNORECASE):
        return "part_of_compound"
    if not any(map(str.isalnum, span)):
        return "no_letters"
    if words[0] in DANGLING:
        return "dangling"
    if low.startswith("follows:") or any(x in low for x in NOISE):
        return "publishing_matter"
    at = text.find(span) if start is None else start
    end = at + len(span)
    if span in HEADINGS or (len(words) <= 3 and re.match(r"\s*:", text[end:])):
        return "heading"
    if span.isupper() and low not in CAPITALS and (re.search(r"\b\d+(?:\.\d+)*\s+$", text[max(0, at - 28) : at]) or re.match(r"(?:\s+[A-Z][A-Z0-9-]*){1,4}\s+(?=[A-Z])", text[end : end + 45])):
        return "heading"
    if 0 <= at and end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        return "inside_a_word"
    return None


def spans(text: str) -> Iterator[tuple[str, str, int, int, str | None, str | None]]:
    """(type, span, start, end, trigger, why it is no answer) of each match, by pattern, then from left to right."""
    low = folded(text)
    for kind, group, pattern, any_case, needs in _COMPILED:
        where = low if any_case else text
        for m in pattern.finditer(text) if not needs or any(x in where for x in needs) else ():
            raw = m.group(group)
            span = raw.strip(EDGE)
            start = m.start(group) + len(raw) - len(raw.lstrip(EDGE))
            yield kind, span, start, start + len(span), m.group(1).lower() if kind == "explanation" else None, invalid(span, text, start, low)


def answer_candidates(chunks: DataFrame, most: int = MOST, *, rejected: bool = False) -> DataFrame:
    """chunks (document_id, chunk_id, page_number, chunk_index, text) with type, answer, start, end, trigger and position: up to most spans of
    a chunk by order of pattern and place, distinct without case. rejected: the spans before the last of them that are no answers instead, with reason."""
    keys = ["document_id", "chunk_id", "page_number", "chunk_index"]
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["text string", "position int", "type string", "answer string", "start int", "end int", "trigger string", "reason string"])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key in f.itertuples(index=False):
                text, seen, out = key[-1] or "", set(), 0
                for kind, span, start, end, trigger, why in spans(text) if text.strip() else ():
                    if why is None and span.lower() in seen:
                        continue
                    if (why is not None) == rejected:
                        rows.append((*key, out, kind, span, start, end, trigger, why))
                        out += 1
                    if why is None:
                        seen.add(span.lower())
                    if len(seen) >= most:
                        break
            yield pd.DataFrame(rows, columns=[*keys, "text", "position", "type", "answer", "start", "end", "trigger", "reason"])

    found = chunks.select(*keys, "text").mapInPandas(work, schema)
    return found if rejected else found.drop("reason")


def adjacent_pages(chunks: DataFrame, doc: str, page: str, order: str) -> DataFrame:
    """Each chunk with the next of its document (next_page, next_order, next_text) if that lies on another page, at most two on."""
    w = Window.partitionBy(doc).orderBy(page, order)
    c = chunks.withColumn("_next", F.lead(F.struct(F.col(page).alias("page"), F.col(order).alias("order"), F.col("text").alias("text"))).over(w))
    c = c.withColumns({"next_page": F.col("_next.page"), "next_order": F.col("_next.order"), "next_text": F.col("_next.text")}).drop("_next")
    return c.where((F.col("next_page") != F.col(page)) & (F.col("next_page") - F.col(page) <= 2))


def contrasts(chunks: DataFrame) -> DataFrame:
    """The terms that a chunk sets against the chunk of the page before: candidates of the type multi_page_synthesis, over both texts."""
    pairs = adjacent_pages(chunks, "document_id", "page_number", "chunk_index")
    term = F.regexp_replace(F.regexp_extract("next_text", CONTRAST, 1), r"^[ ,.;:'\"]+|[ ,.;:'\"]+$", "")
    found = pairs.withColumn("answer", term).where("answer <> ''")
    valid = F.pandas_udf(lambda spans_, texts: pd.Series([invalid(s, t) is None for s, t in zip(spans_, texts, strict=True)]), "boolean")
    whole = F.concat(T.stripped(F.col("text")), F.lit("\n\n"), T.stripped(F.col("next_text")))
    c = found.where(valid("answer", "next_text")).withColumn("text", whole)
    start = F.instr("text", F.col("answer")) - 1
    return c.select(
        "document_id", "chunk_id", "page_number", "chunk_index", "text", F.lit(0).alias("position"), F.lit("multi_page_synthesis").alias("type"), "answer", F.when(start >= 0, start).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("trigger"),
        F.array("page_number", "next_page").alias("pages"),
    )
