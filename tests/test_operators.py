import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import candidates, chunking, evidence, question_checks, questions, ranking, store


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("a\r\nb\rc", "a b c"), ("infor-\nmation", "information"), ("Smith-\nJones", "Smith-Jones"), ("x  y\t z", "x y z"), ("- one\n- two\n\nend", "- one\n- two\n\nend"), ("", ""), ("  \n\n ", "")])
def test_clean(spark, raw, want):
    assert one(spark, T.clean(F.col("s")), s=raw) == want


def test_sentences_keep_abbreviations(spark):
    assert one(spark, T.sentences(F.col("s")), s="Dr. Smith came. He left! \"Why?\" she said.") == ["Dr. Smith came.", "He left!", "\"Why?\" she said."]


@given(st.lists(st.text("ab .", min_size=1, max_size=60), max_size=30), st.integers(20, 60), st.integers(0, 30), st.integers(0, 19))
@settings(max_examples=150, deadline=None)
def test_chunks_hold_their_limits(parts, target, more, overlap):
    sizes = chunking.Sizes(target, target + more, overlap)
    text = "\n\n".join(parts)
    out = chunking.chunk(text, sizes)
    assert all(len(c) <= sizes.most for c in out)
    for w in text.split():
        assert len(w) > sizes.most or any(w in c for c in out)


def test_sizes_are_checked():
    with pytest.raises(ValueError):
        chunking.Sizes(100, 50)


def test_chunks_are_numbered_over_the_document(spark):
    pages = spark.createDataFrame([("d", 1, "A first page. It ends."), ("d", 2, "  "), ("d", 3, "The third page.")], "document_id string, page_number int, text string")
    rows = chunking.chunk_pages(pages).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == ["d_p001_c0000", "d_p003_c0001"]


def test_budget_stops_at_the_first_misfit_and_cuts_the_first(spark):
    e = spark.createDataFrame([(1, 1, 1, "x" * 70), (1, 2, 2, "y" * 700), (1, 3, 3, "z"), (2, 1, 1, "w" * 900), (3, 1, 1, " "), (3, 2, 2, "ok")], "query_id int, rank int, page int, text string")
    got = {(r.query_id, r["rank"]): r.cut for r in evidence.pack(e, 110, 10).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 2): False}


def test_merge_prefers_the_first_of_equal_scores(spark):
    p = spark.createDataFrame([(1, 0, "a", 7, 0.5, 3), (1, 1, "b", 7, 0.5, 1), (1, 1, "b", 8, 0.9, 2)], "plan_id int, position int, sub_query string, item int, score double, rank int")
    rows = {r.item: (r.original_rank, r.matched, r["rank"]) for r in ranking.merge(p).collect()}
    assert rows == {7: (3, "a,b", 2), 8: (2, "b", 1)}


def test_greedy_chain_keeps_what_only_a_dropped_row_resembles(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert {r.id: r.kept for r in questions.greedy_kept(ids, pairs).collect()} == {1: True, 2: False, 3: True}


def test_greedy_neardup_drops_repeats_of_a_token_set(spark):
    base = " ".join(f"w{i}" for i in range(20))
    texts = [base, base, base + " extra", base + " extra", " ".join(reversed(base.split())), "quite other words", "the the", "The  the", "?!", None, "Other quite the words", base + " extra more again", base + " extra more again", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    tokens = [frozenset(re.findall("[a-z0-9]+", (t or "").lower())) - set(T.GROUNDING_STOPS) for t in texts]
    bare = [None if t is None else " ".join(t.lower().split()) for t in texts]
    alike = lambda i, j: len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j]) >= 0.88 if tokens[i] and tokens[j] else not tokens[i] and not tokens[j] and bare[i] == bare[j]
    kept = []
    for i in range(len(texts)):
        if not any(alike(i, j) for j in kept):
            kept.append(i)
    got = {r.id: r.kept for r in questions.greedy_neardup(rows, "id", F.col("text"), T.content_tokens(F.col("text"))).collect()}
    assert got == {i: i in kept for i in range(len(texts))} and 1 not in kept and 4 not in kept and 10 not in kept


def test_upsert_refuses_a_wrong_dimension(spark):
    chunks = spark.createDataFrame([(1, None)], "id int, v array<float>")
    with pytest.raises(ValueError):
        store.upsert_vectors(chunks, spark.createDataFrame([(1, [1.0])], "id int, v array<float>"), "id", "v", 2)


def test_question_checks(spark):
    f = lambda q: one(spark, question_checks.quality_failure(F.col("q"), F.lit("Paris"), F.lit("A source.")), q=q)
    asked = ["Hi?", "What is the capital of France?", "What is this about then?", "Where is the house from?", "No question mark here", "Is it true?? Yes?", "who is it?", "What is Paris?", "A source?", "What did they see of it?", "What is it that Rome saw?"]
    assert [f(q) for q in asked] == ["too_short", None, "generic", "dangling", "no_question_mark", "several_questions", "small_first_letter", "tautology", None, "ambiguous_reference", "generic"]
    m = lambda p, e, q="Who?", s="": one(spark, question_checks.answer_matches(F.col("p"), F.col("e"), F.col("q"), F.col("s")), p=p, e=e, q=q, s=s)
    assert m("Rome in 1998 and later", "Rome 1998") and not m("Rome 1998", "Rome 1999") and not m("big old Rome town", "Rome") and not m("", "x") and m("!Rome?", "rome") and not m("...", "...")
    assert m("an orderly measure", "measure", "What is the definition of measure?", "The definition of measure is an orderly measure.") and m("cold rivers run north", "in winter cold rivers run north fast", "What runs fast in winter?")
    k = lambda q, h=None, s=False: one(spark, question_checks.question_type(F.col("q"), F.lit(h).cast("string"), F.lit(s)), q=q)
    assert [k("Who came?"), k("How many came?"), k("How many came?", "numerical"), k("What is a river?"), k("Who came?", "definition"), k("Is it so?", "direct_fact"), k("Who came?", None, True)] == ["who", "how_many", "numerical_fact", "what", "definition", "direct_fact", "multi_page_synthesis"]


def test_pool_is_cut_before_it_is_scored(spark, data):
    from folio.plans import catalog

    plan = catalog.QUERIES["rerank_order"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_answer_candidates_of_every_kind(spark):
    said = {"October 14, 1947": "It flew on October 14, 1947 at noon", "14 October 1947": "on 14 October 1947 it flew", "1991": "seen in 1991 here", "10-20%": "of 10-20% each", "the slope of a line at a point": "the definition of derivative is the slope of a line at a point.", "a constant 7": "gives a constant 7 there", "42 percent": "about 42 percent of it",
            "3.5": "its derivative equals 3.5 here", "a measure of the disorder": "Entropy is defined as a measure of the disorder.", "the valves were closed": "it stopped because the valves were closed.", "trees split the data": "unlike linear models, trees split the data.", "Training minimizes the squared error": "Training minimizes the squared error.",
            "Marie Curie": "it was Marie Curie who", "NASA": "then NASA came", "hidden unit": "a 'hidden unit' is", "Paris": "he saw Paris today"}
    rows = spark.createDataFrame([("d", a, 1, 0, t) for a, t in said.items()], "document_id string, chunk_id string, page_number int, chunk_index int, text string")
    got = candidates.answer_candidates(rows).collect()
    assert {a for a in said if not any(g.chunk_id == a and g.answer == a for g in got)} == set()
    assert all(said[g.chunk_id][g.start : g.start + len(g.answer)] == g.answer for g in got)


def test_answer_candidates_reach_the_end_of_a_long_document(spark, tmp_path):
    from folio.plans import catalog

    text = " ".join(f"In {1900 + i} they met." for i in range(90)) + " " + "plain words go on here. " * 200 + "At last Marie Curie came."
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["answer_candidates"](spark, str(tmp_path)).collect()
    assert any("Marie Curie" in g.answer for g in got) and len({g.chunk_id for g in got}) > 1
    assert max(sum(h.chunk_id == g.chunk_id for h in got) for g in got) <= 8


def test_ingest_lands_every_turn(spark, tmp_path):
    from folio.plans import catalog

    turns = [(c, t, "user", f"Marker{c}x{t} " + "and some words more. " * 5) for c in range(4) for t in range(6)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.QUERIES["stream_ingest_idempotent"](spark, str(tmp_path)).collect()
    assert sum(g.char_count for g in got) >= sum(len(t[3].strip()) for t in turns)
    assert len({(g.document_id, g.chunk_index) for g in got}) == len(got)


def test_generation_report(spark):
    from folio.operators import evaluation

    kind = "chunk_id string, page_number int, outcome string, complete boolean, grounded boolean"
    rows = [("a", 1, "accepted", True, True), ("a", 1, "near_duplicate", None, None), ("b", 2, "accepted", True, True), ("b", 2, "accepted", None, True), ("c", 2, "syntax_error", None, None)]
    got = evaluation.generation_report(spark.createDataFrame(rows, kind)).first()
    assert (got.chunks, got.pages, got.raw, got.accepted, got.rejected, got.duplicate_rate, got.quality_rate, got.provenance_rate, got.grounding_rate, got.status) == (3, 2, 5, 3, 2, 0.2, 0.2, 0.3333, 1.0, "WARNING")
    none = evaluation.generation_report(spark.createDataFrame([], kind)).first()
    assert (none.raw, none.accepted_rate, none.provenance_rate, none.status) == (0, 0.0, 1.0, "FAIL")
    pairs = spark.createDataFrame([("Red Fox", "the RED hen"), ("blue", "the red hen"), (None, "x"), ("ed h", "Red hen")], "a string, t string")
    assert [r[0] for r in pairs.select(evaluation.grounded(pairs.a, pairs.t)).collect()] == [True, False, True, True]


def test_shared_tokens_count_repeats():
    import pyarrow as pa

    from folio.operators import evaluation

    a, b = [["x", "y", "x"], [], None, ["q"], ["z"] * 5, ["é", "x"]], [["x", "x", "x", "z"], ["x"], ["x"], None, ["z"] * 3, ["x", "é"]]
    kind = pa.list_(pa.string())
    assert evaluation.shared_counts(pa.array(a, kind), pa.array(b, kind)).to_pylist() == [2, 0, 0, 0, 3, 2]
    assert evaluation.shared_counts(pa.array(a, kind).slice(4), pa.array(b, kind).slice(4)).to_pylist() == [3, 2]
    assert evaluation.shared_counts(pa.array([], kind), pa.array([], kind)).to_pylist() == []


def test_top_k_holds_few_scores_and_joins_labels(spark, monkeypatch):
    from pyspark.sql import functions as F

    from folio.operators import vectors

    monkeypatch.setattr(vectors, "CELLS", 7)
    rows = [(i, i % 3, [float((i * 7 + k * i) % 5) / 8 for k in range(4)]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id bigint, label bigint, embedding array<float>")
    got = lambda d: sorted(map(tuple, d.select("query_id", "vec_id", "score", "rank").collect()))

    def want(same):
        out = []
        for i, x, e in rows[::5]:
            near = sorted((-round(max(-1.0, min(1.0, sum(a * b for a, b in zip(e, f)))), 6), j) for j, y, f in rows if j != i and (not same or x == y))[:3]
            out += [(i, j, -s + 0.0, r + 1) for r, (s, j) in enumerate(near)]
        return sorted(out)

    asked = v.where("vec_id % 5 = 0")
    assert got(vectors.top_k_batch(v, asked, 3)) == want(False)
    assert got(vectors.top_k_batch(v, asked, 3, same_label=True)) == got(vectors.top_k_joined(v, asked, 3)) == want(True)
    assert vectors.top_k_joined(v, asked.withColumn("label", F.lit(None).cast("bigint")), 3).count() == 0


def test_jaccard_pairs_order_their_sets_once(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "x y")], "id bigint, text string")
    pairs = questions.jaccard_pairs(rows, "id", F.split("text", " "))
    # the ordered sets are read three times: their counts and collected words are no part of the plan that reads them
    assert "collect_list" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 0.909091)]


def near_copies(clusters: int, copies: int, size: int) -> list[tuple[int, str]]:
    """Texts of distinct words: near copies that differ in up to a tenth of their words, shuffled over the ids."""
    r, texts = random.Random(3), []
    for c in range(clusters):
        words = [f"{r.getrandbits(40):010x}" for _ in range(size)]
        for _ in range(copies):
            new = r.randrange(size // 10)
            texts.append(" ".join([*r.sample(words, size - new), *(f"{r.getrandbits(40):010x}" for _ in range(new))]))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_jaccard_pairs_are_all_pairs(spark, monkeypatch):
    texts = near_copies(6, 7, 30) + near_copies(2, 12, 140) + [(0, "a b c"), (0, "a b c"), (0, "the"), (0, ""), (0, None)]
    rows = [(i * 7 % 101, t) for i, (_, t) in enumerate(texts)]
    tokens = {}
    for i, t in rows:
        s = frozenset((t or "").split())
        if s:
            tokens[s] = min(i, tokens.get(s, i))
    sets = sorted((i, s) for s, i in tokens.items())
    want = {(i, j, round(len(x & y) / len(x | y), 6)) for n, (i, x) in enumerate(sets) for j, y in sets[n + 1 :] if round(len(x & y) / len(x | y), 6) >= 0.88}
    d = spark.createDataFrame(rows, "id bigint, text string")
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    assert len(want) > 30 and {tuple(x) for x in questions.jaccard_pairs(d, "id", tokens).collect()} == want
    # places cut into grids, hashes ordered row by row, few buckets: the same pairs
    for name, value in (("PLACE", 150), ("HELD", 20), ("BUCKETS", 16)):
        monkeypatch.setattr(questions, name, value)
    got = questions.jaccard_pairs(d, "id", tokens).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


@pytest.mark.parametrize("query", ["jaccard_pairs", "greedy_neardup"])
def test_near_copies_send_a_clusters_words_once(spark, query):
    rows = near_copies(1, 80, 300)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    d = spark.createDataFrame(rows, "id bigint, text string")
    tokens = F.split("text", " ")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        found = (questions.jaccard_pairs(d, "id", tokens) if query == "jaccard_pairs" else questions.greedy_neardup(d, "id", F.col("text"), tokens)).count()
        time.sleep(1)
        sent = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # once by id, once to their place; prefixes and prints besides
    assert found >= 80 and 0 < sent < 4 * sum(len(t) for _, t in rows), (found, sent, sum(len(t) for _, t in rows))
