"""Deterministic stand-ins for language models, so simple that SQL can tell what they say."""

from __future__ import annotations

import re
from collections.abc import Iterable

from folio.functions.text import GROUNDING_STOPS
from folio.operators.grounding import DENIALS
from folio.operators.qa import Reading, reader
from folio.operators.scoring import Model, Scorer

READING = Reading(window=24, shared=8)


def content(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", text.lower())) - set(GROUNDING_STOPS)


def share(of: str, among: str) -> float:
    """The share of a text's content words that another has."""
    words = content(of)
    return round(len(words & content(among)) / len(words), 6) if words else 0.0


def overlap_reranker() -> Scorer:
    """(question, text): the share of the question's content words that the text has."""

    def load(_: str) -> Model:
        return lambda pairs: [share(q, t) for q, t in pairs]

    return Scorer("overlap", load, "double")


def lexical_judge() -> Scorer:
    """(evidence, claim): entailed by the share of the claim's content words; contradicted as much if just one of them denies."""

    def load(_: str) -> Model:
        def one(evidence: str, claim: str) -> dict[str, float]:
            e = share(claim, evidence)
            denies = [bool(set(re.findall(r"[a-z0-9]+", x.lower())) & set(DENIALS)) for x in (evidence, claim)]
            return {"entailment": e, "contradiction": e if denies[0] != denies[1] else 0.0, "neutral": round(1 - e, 6)}

        return lambda pairs: [one(*p) for p in pairs]

    return Scorer("lexical-judge", load, "struct<entailment: double, contradiction: double, neutral: double>")


def sentences(context: str) -> list[str]:
    blocks = re.sub(r"(^|\n)\[Page \d+\] ", r"\1", context).replace("\n\n", "\1")
    return [s for x in re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\1", blocks).split("\1") if (s := x.strip(" "))]


def best(question: str, parts: Iterable[str], most: int) -> str:
    """The sentences with most of the question's content words, first ones of equals, as they stand in the text."""
    n = [(-len(content(question) & content(s)), i, s) for i, s in enumerate(parts)]
    return " ".join(s for _, _, s in sorted(sorted(x for x in n if x[0] < 0)[:most], key=lambda x: x[1]))


def scripted_writer() -> Scorer:
    """(prompt): the context's best sentence, the best three if the prompt has an instruction. It errs by the question's first word: it
    names a page where asked where, adds something of its own where asked why, and denies what is asked by is."""

    def load(_: str) -> Model:
        def one(prompt: str) -> str:
            head, rest = prompt.split("Context:\n", 1)
            context, tail = rest.rsplit("\n\nQuestion:\n", 1)
            question = tail.removesuffix("\n\nAnswer:")
            said = best(question, sentences(context), 1 if head.startswith("Use only") else 3)
            first = question.split(" ")[0].lower()
            if not said:
                return ""
            return {"where": "p1", "why": f"{said} It is so said by all.", "is": f"It is not so that {said}"}.get(first, said)

        return lambda rows: [one(p) for (p,) in rows]

    return Scorer("scripted", load, "string")


def cloze_asker() -> Scorer:
    """(answer, source): the sentence of the source that holds the answer, with a question word in its place."""

    def load(_: str) -> Model:
        def one(answer: str, source: str) -> str:
            for s in re.split(r"(?<=[.!?])\s+", source):
                if answer in s:
                    return re.sub(r"[.!?]+$", "", s.replace(answer, "what", 1)) + "?"
            return f"What of {answer}"

        return lambda rows: [one(*r) for r in rows]

    return Scorer("cloze-asker", load, "string")


def cloze_reader() -> Scorer:
    """(question, source): what stands in the source where the question says what, between the words around it; nothing if they aren't there.

    It reads too little of every third question: only the answer's first word.
    """

    def load(_: str) -> Model:
        def one(question: str, source: str) -> str:
            before, found, after = question.rstrip("?").partition("what")
            if not found:
                before, found, after = question.rstrip("?").partition("What")
            low, left, right = source.lower(), before.lower(), after.lower().rstrip(".!? ")
            at = low.find(left)
            end = low.find(right, at + len(left)) if right else -1
            if not found or at < 0 or (right and end < 0):
                return ""
            said = source[at + len(left) : end if right else at + len(left) + 60].strip()
            return said.split(" ")[0] if len(question) % 3 == 0 else said

        return lambda rows: [one(*r) for r in rows]

    return Scorer("cloze-reader", load, "string")


def overlap_reader(reading: Reading) -> Scorer:
    """Span scores: a token is a good start, and a good end, by the question's content words among it and its two neighbours; one without a
    place in a window has the null answer at 1."""

    def logits(question: str, text: str, places: list[tuple[int, int]]) -> tuple[list[float], list[float]]:
        words = content(question)
        hit = [float(text[a:b].strip(".,;:!?").lower() in words) for a, b in places]
        near = [sum(hit[max(0, i - 1) : i + 2]) for i in range(len(hit))]
        return [0.5, *[n + h for n, h in zip(near, hit, strict=True)]], [0.5, *[n + h / 2 for n, h in zip(near, hit, strict=True)]]

    return reader(f"overlap-{reading.window}-{reading.shared}", lambda t: [m.span() for m in re.finditer(r"\S+", t)], logits, reading)
