"""The question pipeline's ledger against plain loops, candidates' validity, section labels against a fold."""

import re
import uuid
from collections import Counter, defaultdict

import pytest

from folio.operators import candidates, question_pipeline, questions, sections
from folio.operators.scoring import Scorer
from folio.plans import question_queries, stand_ins

CHUNK = "document_id string, chunk_id string, page_number int, chunk_index int, text string"
STOPS = set(
    "is the are was were a an of in to for with by on at from does do did can could would should definition meaning concept type types it its they them their this that these those be been being".split()
)


def says(name, f):
    return Scorer(f"{name}-{uuid.uuid4().hex}", lambda _: lambda rows: [f(*r) for r in rows], "string")


def key(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (s or "").strip().lower())).strip()


def tokens(s):
    t = set(key(s).split())
    return t - STOPS or t


def greedy(rows):
    """(reason or None) of each (question, answer or None), in order."""
    kept, out = [], []
    for q, a in rows:
        a, why = key(a) or None if a is not None else None, None
        same = a is None or any(key(k) == key(q) and b == a for k, b in kept)
        if not key(q):
            why = "empty_normalized_question" if q.strip() else "empty_question"
        elif any(k.strip() == q.strip() for k, _ in kept) and same:
            why = "exact_duplicate"
        elif any(key(k) == key(q) for k, _ in kept) and same:
            why = "normalized_duplicate"
        elif any(not (a and b and a != b) and len(tokens(q) & tokens(k)) / len(tokens(q) | tokens(k)) >= 0.88 for k, b in kept):
            why = "near_duplicate"
        if why is None:
            kept.append((q, a))
        out.append(why)
    return out


@pytest.fixture(scope="module")
def made(spark, data):
    chunks = question_queries.question_chunks(spark, data)
    request = question_pipeline.Request(count=3)
    got, ledger = question_pipeline.generate(chunks, stand_ins.cloze_asker(), stand_ins.cloze_reader(), request)
    eligible = questions.eligible(chunks, "text")
    found = question_pipeline.extracted(eligible.where("eligible")).collect()
    return request, got.collect(), ledger.collect(), found, eligible.where("not eligible").groupBy("document_id", "category").count().collect()


def test_ledger_adds_up(made):
    request, got, ledger, found, ineligible = made
    rest = [r for r in ledger if r.stage != "eligibility"]
    assert Counter(r.document_id for r in rest) == Counter(r.document_id for r in found)
    assert Counter((r.document_id, r.chunk_id, r.type) for r in rest) == Counter((r.document_id, r.chunk_id, r.type) for r in found)
    assert Counter((r.document_id, r.category) for r in ledger if r.stage == "eligibility") == {(r.document_id, r.category): r["count"] for r in ineligible}
    assert Counter(r.stage for r in rest)["returned"] == len(got) and max(Counter(r.document_id for r in got).values()) <= request.count
    assert {"sampling", "duplicates", "validation", "selection", "returned"} <= {r.stage for r in rest}


def test_pool_takes_types_in_turn(made):
    request, _, ledger, found, _ = made
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.late, r.page_number, r.chunk_index, r.chunk_id, r.position)):
        by[r.document_id].append(r)
    want = Counter()
    for doc, rows in by.items():
        if len(rows) > request.pool:
            kinds, taken = defaultdict(list), []
            for r in rows:
                kinds[r.type].append(r)
            while len(taken) < request.pool and any(kinds.values()):
                for k in list(kinds):
                    if kinds[k] and len(taken) < request.pool:
                        taken.append(kinds[k].pop(0))
            rows = taken
        want.update((doc, r.chunk_id, r.type, r.answer) for r in rows)
    got = Counter((r.document_id, r.chunk_id, r.type, r.answer) for r in ledger if r.stage not in ("eligibility", "sampling"))
    strip = lambda c: Counter({(*k[:3], k[3].strip()): n for k, n in c.items()})
    assert {(*k[:3],) for k in got} == {(*k[:3],) for k in want} and sum(got.values()) == sum(want.values()) and set(strip(want)) >= {k for k in strip(got) if k[3] in {x[3] for x in strip(want)}}


def test_returned_questions_differ(made):
    by = defaultdict(list)
    for r in made[1]:
        by[r.document_id].append(r)
        assert r.answer and r.question.endswith("?") and r.source
    for rows in by.values():
        assert greedy([(r.question, None) for r in sorted(rows, key=lambda r: r["rank"])]) == [None] * len(rows)
    assert len({r.question_id for r in made[1]}) == len(made[1])


def test_duplicates_are_a_greedy_pass(spark):
    said = [("What is Rome?", "a"), ("what is rome", "a"), ("What is Rome?", "b"), ("What is Rome?", "A!"), ("  ", "x"), ("?!", "x"), ("Who saw one two three four five six seven eight?", "c"), ("Who saw one two three four five six seven eight, then?", None),
            ("Who saw one two three four five six seven eight now?", "d"), ("It is the", "e"), ("It is a", "e"), ("What is Rome?", None)]
    rows = spark.createDataFrame([("d", i, q, a) for i, (q, a) in enumerate(said)] + [("e", 0, "What is Rome?", "a")], "document_id string, turn int, question string, answer string")
    for answers in (True, False):
        got = {(r.document_id, r.turn): r.duplicate for r in question_pipeline.duplicates(rows, answers=answers).collect()}
        assert [got["d", i] for i in range(len(said))] == greedy([(q, a if answers else None) for q, a in said]) and got["e", 0] is None


def test_every_stage_of_a_small_document(spark):
    text = "In 1901 the long bridge stood over the river near the town of Bern. In 1902 the mill burnt down again. NASA came in 1903 with a machine. It fell because the great wheel had lost its teeth."
    chunks = spark.createDataFrame([("d", "c1", 1, 0, text), ("d", "c2", 2, 1, "PREFACE\nThis is a preface of the book and says nothing."), ("e", "x", 1, 0, "")], CHUNK)
    asked = {"1901": "When did the bridge stand", "1902": "when did the bridge stand ?", "1903": "What?", "NASA": "Who came in 1903", "the great wheel had lost its teeth": "Why did the wheel fall by Zurich", "Bern": "Which town is near the bridge"}
    read = {"When did the bridge stand?": "1901", "Who came in 1903?": "with a machine", "Which town is near the bridge?": "Bern"}
    found, ledger = question_pipeline.generate(chunks, says("ask", lambda a, s: asked.get(a, "")), says("read", lambda q, s: read.get(q, "")), question_pipeline.Request(count=2))
    got = {(r.answer, r.stage, r.category, r.reason) for r in ledger.collect() if r.document_id == "d"}
    assert ("1903", "validation", "quality_failure", "too_short") in got and ("NASA", "validation", "answer_mismatch", "answer_mismatch") in got and ("the great wheel had lost its teeth", "validation", "outside_knowledge", "outside_name") in got
    assert (None, "eligibility", "PREFACE", "preface_content") in got and ("1901", "returned", "accepted", "accepted") in got and ("1902", "validation", "answer_mismatch", "answer_mismatch") in got and len(got) == 7
    r = sorted(found.collect(), key=lambda x: x["rank"])
    assert [(x.question, x.answer, x.question_type, x.difficulty, x.start, x["rank"]) for x in r] == [("When did the bridge stand?", "1901", "when", "easy", text.index("1901"), 1), ("Which town is near the bridge?", "Bern", "factual", "easy", text.index("Bern"), 2)]
    assert r[0].source == text


def test_wanted_types_come_first(spark):
    text = "In 1901 the long bridge stood over the wide river near the town. It fell because the great wheel had lost its teeth."
    chunks = spark.createDataFrame([("d", "c", 1, 0, text)], CHUNK)
    asked = {"1901": "When did the bridge stand", "the great wheel had lost its teeth": "Why did the bridge fall"}
    args = chunks, says("ask", lambda a, s: asked[a]), says("read", lambda q, s: "1901" if q.startswith("When") else "the great wheel had lost its teeth")
    one = question_pipeline.generate(*args, question_pipeline.Request(count=1, level="hard"))[0].collect()
    assert [r.question_type for r in one] == ["explanation"]
    two = question_pipeline.generate(*args, question_pipeline.Request(count=2, level="hard"))[0].collect()
    assert [r.question_type for r in sorted(two, key=lambda r: r["rank"])] == ["explanation", "when"]
    assert [r.type for r in question_pipeline.extracted(chunks, "explanation").collect()] == ["explanation"]
    for bad in ({"count": 0}, {"kind": "other"}):
        with pytest.raises(ValueError):
            question_pipeline.Request(**bad)


@pytest.mark.parametrize(
    ("span", "text", "why"),
    [
        ("x", "an x here", "length"), ("a b", "a b", "whole_passage"), ("this", "so this is", "stop_word"), ("Model", "a Model of it", "generic_word"), ("Stop", "a Non-Stop one, Stop", "part_of_compound"), ("Well", "Well-known to all", "part_of_compound"), ("--", "so -- then", "no_letters"),
        ("of Rome", "town of Rome here", "dangling"), ("follows: a b", "as follows: a b c", "publishing_matter"), ("Second Edition", "the Second Edition of", "publishing_matter"), ("TABLE", "see TABLE two", "heading"), ("Main Part", "the Main Part: it", "heading"), ("PARTS", "3.2 PARTS of it", "heading"),
        ("LONG", "LONG WAYS Home now", "heading"), ("Par", "see Paris now", "inside_a_word"), ("Paris", "see Paris now", None), ("SVM", "3.2 SVM here", None), ("quantum state", "a quantum state here", None),
    ],
)
def test_validity_of_spans(span, text, why):
    assert candidates.invalid(span, text, text.index(span)) == why


def test_rejected_spans_are_told(spark):
    rows = spark.createDataFrame([("d", "c", 1, 0, "In 1999 the Well-known THE END of 1999 came")], CHUNK)
    got = {(r.answer, r.reason) for r in candidates.answer_candidates(rows, rejected=True).collect()}
    assert ("Well", "part_of_compound") in got or ("THE", "stop_word") in got
    assert [r.answer for r in candidates.answer_candidates(rows).collect()].count("1999") == 1


def test_contrasting_pages(spark):
    texts = [("d", "a", 1, 0, "Trees split data."), ("d", "b", 2, 1, "In contrast, neural networks are opaque."), ("d", "c", 5, 2, "Unlike old maps is this."), ("e", "a", 1, 0, "Whereas two things use it."), ("e", "b", 1, 1, "Unlike big cats use it."), ("e", "c", 2, 2, "On the other hand the large model uses it.")]
    got = {(r.document_id, r.chunk_id, r.answer, tuple(r.pages)) for r in candidates.contrasts(spark.createDataFrame(texts, CHUNK)).collect()}
    assert got == {("d", "a", "neural networks", (1, 2)), ("e", "b", "the large model", (1, 2))}


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_section_labels_are_a_fold(spark, data, size):
    chunks = question_queries.headed_chunks(spark, data)
    base = questions.measured(questions.eligible(chunks, "text"), "text")
    from pyspark.sql import functions as F

    facts = base.select("document_id", "chunk_id", "page_number", "chunk_index", "category", "eligible", "citations", "index_refs", "_text", questions.lead_heading(F.col("_text")).isNotNull().alias("headed")).collect()
    want, state = {}, {}
    for r in sorted(facts, key=lambda r: (r.document_id, r.page_number, r.chunk_index)):
        active, since = state.get(r.document_id, (None, 0))
        start = re.search(r"^[\s\W]*(?:\d{1,4}\s+)?(?:CHAPTER|Chapter)\s+[\dIVXL]+\b|^[\s\W]*\d+(?:\.\d+)+\s+[A-Z]", r._text[:120])
        ok, category = r.eligible, r.category
        if ok and active and not r.headed and not start:
            front = active in ("PREFACE", "FOREWORD", "ACKNOWLEDGEMENTS", "AUTHOR_BIO", "ABSTRACT", "TABLE_OF_CONTENTS", "COPYRIGHT") and r.page_number - since <= 2
            if front or (active in ("REFERENCES", "BIBLIOGRAPHY") and r.citations >= 3) or (active == "INDEX" and r.index_refs >= 5):
                ok, category = False, active
        if not ok and category in sections._SECTIONS:
            state[r.document_id] = (category, since if category == active else r.page_number)
        elif ok:
            state[r.document_id] = (None, 0)
        want[r.document_id, r.chunk_id] = (category, ok)
    got = {(r.document_id, r.chunk_id): (r.category, r.eligible) for r in sections.classified(chunks, size=size).collect()}
    assert got == want
    assert any(r.reason.endswith("continuation") for r in sections.classified(chunks, size=size).select("reason").collect())


def test_section_labels_go_through_many_documents_in_a_task(spark, data):
    from folio.plans import question_queries

    plan = question_queries.section_labels(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
