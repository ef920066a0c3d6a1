"""Batch scorers, embeddings, claims' statements and grounded answers with table-driven fakes."""

import uuid

import pytest
from pyspark.sql import functions as F

from folio.operators import answering, embedding, grounding, qa, ranking, search, store
from folio.operators.scoring import Scorer, ScoringError, batches, device, labels_of, nli, probabilities, scored


def fake(name, table, returns="double", batch=4, log=None):
    """A scorer that looks its inputs up, and notes each batch in a folder."""

    def load(_):
        def model(rows):
            if log:
                with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(map(str, rows)))
            return [table[r] if r in table else table[None] for r in rows]

        return model

    return Scorer(f"{name}-{uuid.uuid4().hex}", load, returns, batch)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_equal_inputs_are_scored_once(spark, tmp_path):
    rows = [(i, f"q{i % 7}", None if i % 10 == 9 else f"t{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, q string, t string").repartition(5)
    table = {(f"q{i}", f"t{i}"): float(i) for i in range(7)}
    out = scored(df, fake("once", table, log=tmp_path), "score", "q", "t")
    again = out.collect() + out.collect()
    assert sorted((r.id, r.q, r.t) for r in again) == sorted(rows * 2)
    assert all(r.score == (None if r.t is None else float(r.q[1])) for r in again)
    seen = [x for f in tmp_path.iterdir() for x in f.read_text().split("\n")]
    assert sorted(seen) == sorted(map(str, table))
    assert all(len(f.read_text().split("\n")) <= 4 for f in tmp_path.iterdir())


@pytest.mark.parametrize("table", [{None: float("nan")}, {None: float("inf")}])
def test_scores_must_be_finite(spark, table):
    with pytest.raises(Exception, match="finite"):
        scored(spark.createDataFrame([("a",)], "q string"), fake("bad", table), "score", "q").collect()


def test_a_score_for_each_input():
    with pytest.raises(ScoringError, match="1 scores for 2 inputs"):
        batches(lambda rows: rows[:1], [(1,), (2,)], 5)
    with pytest.raises(ValueError, match="batch"):
        Scorer("x", lambda _: None, batch=0)
    assert batches(lambda rows: [{"a": 1.0}] * len(rows), [], 5) == [] and device() == "cpu"


def test_labels_are_found_by_name():
    assert labels_of({0: "CONTRADICTION", 1: "Entailment", 2: "neutral"}) == {"entailment": 1, "contradiction": 0, "neutral": 2}
    for names in ({0: "LABEL_0", 1: "LABEL_1", 2: "LABEL_2"}, {0: "entailment", 1: "entailed", 2: "neutral"}, {}):
        with pytest.raises(ScoringError):
            labels_of(names)


def test_outputs_become_probabilities(spark):
    assert probabilities([0.2, 0.3, 0.5]) == [0.2, 0.3, 0.5]
    p = probabilities([1000.0, 1001.0, 999.0])
    assert abs(sum(p) - 1) < 1e-9 and p[1] > p[0] > p[2]
    s = nli(f"n-{uuid.uuid4().hex}", lambda _: lambda pairs: [[0.1, 0.7, 0.2] for _ in pairs], {0: "contradiction", 1: "entailment", 2: "neutral"})
    r = scored(spark.createDataFrame([("p", "h")], "p string, h string"), s, "s", "p", "h").first().s
    assert (r.entailment, r.contradiction, r.neutral) == (0.7, 0.1, 0.2)


def test_embedding_checks(spark):
    e = embedding.hash_embedder()
    docs = spark.createDataFrame([(1, "one two"), (2, "two, ONE!"), (3, "...")], "vec_id bigint, text string")
    v = {r.vec_id: r.embedding for r in embedding.embed(docs, e, 64).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and set(v[3]) == {0.0}
    for bad in (None, "", "  "):
        with pytest.raises(Exception, match="blank"):
            embedding.embed(spark.createDataFrame([(1, bad)], "vec_id bigint, text string"), e, 64).collect()
        with pytest.raises(search.SearchError):
            embedding.embed_query(docs, bad, e)
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(docs, e, 32).collect()


def test_index_grows_behind_its_vectors(spark, tmp_path):
    e = embedding.hash_embedder()
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(6)], "vec_id bigint, text string")
    first = embedding.build_index(docs.where("vec_id < 3"), e, 64, str(tmp_path / "a"))
    both = embedding.build_index(docs.where("vec_id >= 3"), e, 64, str(tmp_path / "b"), first)
    assert [(r.slot, r.vec_id) for r in both.collect()] == [(i, i) for i in range(6)]
    found = embedding.search_texts(both.withColumn("label", F.col("vec_id") % 2), spark.createDataFrame([(0, "word4 text", 0), (4, "word5", 1)], "query_id bigint, text string, label bigint"), e, 1, same_label=True)
    assert {(r.query_id, r.vec_id) for r in found.collect()} == {(0, 4), (4, 5)}


def test_missing_vectors_are_embedded(spark):
    e = embedding.hash_embedder()
    c = spark.createDataFrame([(i, f"t{i}", 10 - i, [1.0] * 64 if i == 2 else None) for i in range(5)], "id bigint, text string, at int, embedding array<float>")
    done = {r.id: r.embedding for r in embedding.embed_missing(c, e, 64, "at", "id", 2).collect()}
    assert {i for i, v in done.items() if v is not None} == {2, 3, 4} and done[2] == [1.0] * 64
    assert all(v is not None for v in (r.embedding for r in embedding.embed_missing(c, e, 64, "at", "id").collect()))


@pytest.mark.parametrize(
    ("question", "fragment", "want"),
    [
        ("What is the capital of France?", "Paris", "The capital of France is Paris."), ("Which are the layers?", "a, b and c.", "The layers are a, b and c."), ("What is used?", "x and y", "The used are x and y."),
        ("What drives it?", "the wind!", "Regarding what drives it, it is the wind."), ("Why does it fall?", "gravity", "it fall because gravity."), ("Why is it so?", "because of x", "it so because of x."),
        ("How does it work?", "steam", "it work by steam."), ("How can one win?", "Using luck", "one win Using luck."), ("Who came?", "Ann", "Regarding Who came, the answer is Ann."), ("Who came?", "Ann came and was late.", "Ann came and was late."), ("  ", "Ann", "Ann"),
    ],
)
def test_statements_of_fragments(spark, question, fragment, want):
    assert one(spark, grounding.contextual(F.col("q"), F.col("f")), q=question, f=fragment) == want


@pytest.mark.parametrize(
    ("claim", "form"),
    [
        ("It may rain on Tuesday, or so", "declarative"), ("Prices, or rates, could fall", "declarative"), ("a constant 5", "numerical"), ("-3.5%", "numerical"), ("12 layers", "numerical"), ("5 years", "short_span"), ("red, green and blue", "list"),
        ("the long list of many things in the old red house", "noun_phrase"), ("", "short_span"), ("It computes sums", "declarative"),
    ],
)
def test_claim_forms(spark, claim, form):
    assert one(spark, grounding.claim_form(F.col("c")), c=claim) == form


def say(e, c=0.0):
    return {"entailment": e, "contradiction": c, "neutral": max(0.0, 1 - e - c)}


FIRST = "What is the first letter alpha?"
#: (question, label, what the writer says first and when told more, scores of the claims, outcome, status, completeness)
CASES = [
    (FIRST, 1, ("Alpha is the first letter of all.", ""), say(0.9), "answered", "grounded", "complete"),
    ("How do letters perform?", 1, ("x", ""), say(0.9), "needs_clarification", "unsupported", "complete"), ("What is alpha?", 9, ("x y z", ""), say(0.9), "no_evidence", "empty", "complete"),
    ("What is the first letter, alpha?", 1, ("  ", ""), say(0.9), "no_answer", "empty", "complete"), ("What is the first letter Alpha?", 1, ("p1", ""), say(0.9), "no_claims", "empty", "complete"),
    ("What is the first letter of all alpha?", None, ("Alpha is one first.", ""), say(0.9), "isolation_error", "unsupported", "complete"), ("What is first letter alpha?", 1, ("Alpha is the last.", ""), say(0.1, 0.9), "refused", "contradicted", "complete"),
    ("What is a first letter alpha?", 1, ("Alpha is one last.", ""), say(0.9, 0.9), "refused", "conflicted", "complete"), ("What is our first letter alpha?", 1, ("Alpha is a last.", ""), say(0.3), "refused", "unsupported", "complete"),
    ("Compare alpha and gamma", 1, ("Alpha is a first.", "Alpha is a first. Gamma is a letter."), say(0.95), "answered", "grounded", "complete"), ("Compare gamma and alpha", 1, ("Alpha is first.", "Alpha is still the first."), say(0.95), "refused", "grounded", "incomplete_after_retry"),
    ("Compare the alpha and gamma", 1, ("Alpha was the first.", " "), say(0.95), "answered", "grounded", "incomplete_attempt_1"), ("Compare alpha and beta", 1, ("Alpha and beta are letters.", "never asked"), say(0.95), "answered", "grounded", "complete"),
]


def run(spark, judged=True, **limits):
    """Three chunks of two documents, all CASES at once; the index holds no vector of the document 9."""
    e = embedding.hash_embedder()
    texts = [(1, 1, "1", 1, "Alpha is the first letter of all. Beta follows alpha."), (2, 1, "1", 2, "Gamma is a letter too."), (3, 2, "2", 1, "Delta is a river mouth. Alpha is the first letter of all.")]
    chunks = embedding.embed(spark.createDataFrame(texts, "vec_id bigint, label bigint, document_id string, page_number int, text string"), e, 64)
    said = {q: pair for q, _, pair, *_ in CASES}
    question = lambda p: p.rsplit("\n\nQuestion:\n", 1)[1].removesuffix("\n\nAnswer:")
    writer = Scorer(f"w-{uuid.uuid4().hex}", lambda _: lambda rows: [said[question(p)][not p.startswith("Use only")] for (p,) in rows], "string")
    table = {c: s for _, _, pair, s, *_ in CASES for text in pair for c in text.replace(". ", ".|").split("|")}
    kind = "struct<entailment: double, contradiction: double, neutral: double>"
    none = say(0.0)
    judge = Scorer(f"j-{uuid.uuid4().hex}", lambda _: lambda rows: [table.get(c, none) for _, c in rows], kind) if judged else None
    asked = spark.createDataFrame([(i, q, label) for i, (q, label, *_) in enumerate(CASES)], "query_id bigint, query string, label bigint")
    g = answering.answer(asked, chunks, answering.Models(e, writer, judge), answering.Limits(**limits))
    return {r.query_id: r for r in g.answers.collect()}, g.claims.collect(), g.citations.collect()


def test_outcomes_of_the_strict_policy(spark):
    got, _, cites = run(spark)
    for i, (q, _, pair, _, outcome, status, completeness) in enumerate(CASES):
        r = got[i]
        assert (r.outcome, r.grounding_status, r.completeness) == (outcome, status, completeness), q
        stands = pair[1] if r.regenerated and completeness == "complete" else pair[0]
        assert r.answer == (stands if outcome == "answered" else None) and r.answerable == (outcome == "answered"), q
    assert [got[i].regenerated for i in range(9, 13)] == [True, True, True, False]
    assert {c.answer_id for c in cites} == {i for i, c in enumerate(CASES) if c[4] == "answered"}
    assert {(c.citation, c.kind) for c in cites if c.answer_id == 0} == {("cite_1", "supports"), ("cite_2", "supports")}


def test_outcomes_of_the_permissive_policy_and_without_a_judge(spark):
    got, _, _ = run(spark, strict=False)
    assert {i for i, r in got.items() if r.outcome == "answered"} == {0, 6, 7, 8, 9, 10, 11, 12} and got[8].answer == "Alpha is a last." and got[8].grounding_status == "unsupported"
    got, claims, cites = run(spark, judged=False)
    assert {got[i].outcome for i in (0, 4, 5, 6)} == {"unchecked"} and got[0].grounding_status == "disabled" and got[0].score == 1.0 and not claims and not cites
    assert {got[i].outcome for i in (1, 2, 3)} == {"needs_clarification", "no_evidence", "no_answer"}


def test_fragments_are_judged_as_statements_too(spark):
    """A fragment that a chunk lacks is entailed by it at 0.2 at most, one that it has by the greater of both scores."""
    claims = spark.createDataFrame([(1, 0, "Beta", "What follows alpha?"), (1, 1, "Omega", "What follows alpha?"), (1, 2, "It is so.", "What follows alpha?")], "answer_id int, claim_index int, claim string, question string")
    ev = spark.createDataFrame([(1, 1, "Beta follows alpha.")], "answer_id int, evidence_rank int, text string")
    table = {("Beta follows alpha.", "Beta"): say(0.1, 0.5), ("Beta follows alpha.", "Regarding what follows alpha, it is Beta."): say(0.9, 0.05), ("Beta follows alpha.", "Omega"): say(0.85), None: say(0.81)}
    got = {r.claim_index: (r.entailment, r.contradiction, r.neutral) for r in grounding.judge(claims, ev, fake("j", table, "struct<entailment: double, contradiction: double, neutral: double>")).collect()}
    assert got[0] == (0.9, 0.05, pytest.approx(0.05)) and got[1][0] == 0.2 and got[2][0] == 0.81


def test_scratch_is_not_shared_between_indexes(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load_index(spark, str(tmp_path / "none"))


def test_extractive_answers_are_the_best_spans_of_all_windows(spark, data):
    from folio.plans import answer_queries, stand_ins

    reading, places = stand_ins.READING, lambda t: [m.span() for m in __import__("re").finditer(r"\S+", t)]
    model = stand_ins.overlap_reader(reading).load("cpu")
    questions, evidence = answer_queries.reading_inputs(spark, data)
    got = {r.query_id: r for r in qa.answer(questions, evidence, stand_ins.overlap_reader(reading), reading).collect()}
    rows = {}
    for r in sorted(evidence.collect(), key=lambda r: (r.query_id, r["rank"])):
        rows.setdefault(r.query_id, []).append(r)
    assert set(got) == {r.query_id for r in questions.collect()}
    for q in questions.collect():
        found = []
        for n, e in enumerate(rows.get(q.query_id, []), 1):
            logits = model([(q.query.strip(), e.text)])[0] if (e.text or "").strip() else []
            for w in sorted({x["window"] for x in logits}):
                own = [x for x in logits if x["window"] == w]
                null, body = own[0]["start"] + own[0]["end"], own[1:]
                starts = sorted(body, key=lambda x: (-x["start"], x["token"]))[: reading.best]
                ends = sorted(body, key=lambda x: (-x["end"], x["token"]))[: reading.best]
                found += [(s["start"] + t["end"] - null, s["start"] + t["end"], -n, -w, -s["token"], -t["token"], e.text[s["begins"] : t["stops"]], s["begins"], e.chunk_id) for s in starts for t in ends if s["token"] <= t["token"] < s["token"] + reading.longest]
        r = got[q.query_id]
        assert r.n_evidence == len(rows.get(q.query_id, []))
        if found:
            b = max(found, key=lambda x: x[:6])
            assert (r.qa_score, r.chunk_id, r.answerable) == (round(b[1], 4), b[8], b[0] > 0) and r.no_answer_score == pytest.approx(b[1] - b[0])
            assert (r.answer, r.answer_start, r.answer_end) == ((b[6], b[7], b[7] + len(b[6])) if b[0] > 0 else (None, None, None))
    assert len(places("a b")) == 2


def test_reading_windows():
    assert qa.windows(10, qa.Reading(4, 1)) == [(0, 4), (3, 7), (6, 10)] and qa.windows(0, qa.Reading()) == [(0, 0)] and qa.windows(4, qa.Reading(4, 1)) == [(0, 4)] and qa.windows(11, qa.Reading(4, 1))[-1] == (9, 11)
    for bad in ({"window": 4, "shared": 4}, {"best": 0}, {"longest": 0}, {"window": 0}):
        with pytest.raises(ValueError):
            qa.Reading(**bad)


def test_blank_evidence_counts_and_blank_questions_fail(spark):
    read = Scorer(f"r-{uuid.uuid4().hex}", lambda _: lambda rows: [[{"window": 0, "token": 0, "start": 9.0, "end": 9.0, "begins": None, "stops": None}, {"window": 0, "token": 1, "start": 1.0, "end": 2.0, "begins": 0, "stops": 3}] for _ in rows], qa.LOGITS)
    kind = "query_id int, rank int, chunk_id string, document_id string, page_number int, text string"
    ev = spark.createDataFrame([(1, 1, "c", "d", 1, " "), (1, 2, "e", "d", 1, " ab cd")], kind)
    ask = lambda q: spark.createDataFrame([(1, q), (2, "other")], "query_id int, query string")
    got = {r.query_id: r for r in qa.answer(ask("what"), ev, read).collect()}
    assert (got[1].answerable, got[1].answer, got[1].qa_score, got[1].chunk_id, got[1].evidence_rank, got[1].n_evidence) == (False, None, 3.0, "e", 2, 2) and (got[2].answerable, got[2].n_evidence, got[2].qa_score) == (False, 0, None)
    low = {r.query_id: r for r in qa.answer(ask("what"), ev, read, qa.Reading(threshold=-20.0)).collect()}
    assert (low[1].answer, low[1].answer_start, low[1].answer_end) == ("ab", 1, 3)
    with pytest.raises(Exception, match="blank"):
        qa.answer(ask(" "), ev, read).collect()


def test_board_filters(spark):
    results = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 2, 1), (1, "c", 3, None)], "answer_id int, chunk_id string, rank int, original_rank int")
    cites = spark.createDataFrame([(1, "b", "cite_1")], "answer_id int, chunk_id string, citation string")
    assert {r.chunk_id: (r.citation, r.used, r.promoted) for r in ranking.board(results, cites).collect()} == {"a": (None, False, True), "b": ("cite_1", True, False), "c": (None, False, False)}
    assert [r.chunk_id for r in ranking.board(results, cites, show="used").collect()] == ["b"] and [r.chunk_id for r in ranking.board(results, cites, show="promoted").collect()] == ["a"]
    with pytest.raises(ValueError):
        ranking.board(results, cites, show="other")


def test_best_spans_pair_starts_and_ends_without_rows_of_pairs(spark):
    rows = [(q, w, t, float((t * 7 + w * 3 + q) % 5), float((t * 11 + q) % 6)) for q in range(3) for w in range(2) for t in range(30)] + [(9, 0, 0, 1.0, 1.0), (8, 0, 1, 5.0, 5.0)]
    got = qa.best_span(spark.createDataFrame(rows, "query_id int, window int, token int, start double, end double"), top=6, longest=4)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {9: (None, None, None)}
    for q in range(3):
        found = []
        for w in range(2):
            body = [r for r in rows if r[:2] == (q, w) and r[2] > 0]
            null = sum(next(r for r in rows if r[:3] == (q, w, 0))[3:])
            s, e = (sorted(body, key=lambda r: (-r[at], r[2]))[:6] for at in (3, 4))
            found += [(a[3] + b[4] - null, a[3] + b[4], -w, -a[2], -b[2]) for a in s for b in e if a[2] <= b[2] < a[2] + 4]
        best = max(found)
        want[q] = tuple(-x for x in best[2:]) if best[0] > 0 else (None, None, None)
    assert {r.query_id: (r.window, r.start_token, r.end_token) for r in got.collect()} == want
