"""Evaluation runs, transactional storage, quantiles by selection, token F1 in the row, against plain models."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import evaluation, evaluation_run, store


def docs(spark, ids, word, pages=2):
    rows = [(i, p + 1, f"{word} {i} {p}") for i in ids for p in range(pages)]
    t = spark.createDataFrame(rows, "document_id bigint, page_number int, text string")
    return {"documents": t.select("document_id").distinct(), "pages": t, "chunks": t.withColumn("chunk_index", F.col("page_number") - 1)}


def words(spark, root):
    return Counter((r.document_id, r.text.split()[0]) for r in store.committed_rows(spark, root, "pages").collect())


def test_a_broken_attempt_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    store.persist(root, docs(spark, [1, 2], "old"), "a", "failed")
    assert words(spark, root) == {(1, "old"): 2, (2, "old"): 2}
    # killed after the rows are staged, before the manifest
    store.stage(root, "b", docs(spark, [1, 2, 3], "half"))
    assert words(spark, root) == {(1, "old"): 2, (2, "old"): 2}
    # run again under its name
    assert store.persist(root, docs(spark, [1, 2, 3], "new", 3), "b").count() == 0
    assert words(spark, root) == {(i, "new"): 3 for i in (1, 2, 3)}


def test_processed_documents_are_left_out(spark, tmp_path):
    root = str(tmp_path / "t")
    store.persist(root, docs(spark, [1], "old"), "a")
    store.persist(root, docs(spark, [2], "old"), "b", "failed")
    out = store.persist(root, docs(spark, [1, 2, 3], "new"), "c")
    assert [r.document_id for r in out.collect()] == [1] and words(spark, root) == {(1, "old"): 2, (2, "new"): 2, (3, "new"): 2}
    assert {r.document_id: r.status for r in store.latest(spark, root).collect()} == {1: "processed", 2: "processed", 3: "processed"}


def test_broken_rows_are_not_committed(spark, tmp_path):
    root = str(tmp_path / "t")
    store.persist(root, docs(spark, [1], "old"), "a", "failed")
    bad = docs(spark, [1], "new")
    bad["pages"] = bad["pages"].unionByName(bad["pages"])
    with pytest.raises(store.BrokenRows, match="page unique"):
        store.persist(root, bad, "b")
    bad = docs(spark, [1], "new")
    bad["chunks"] = bad["chunks"].withColumn("page_number", F.col("page_number") + 9)
    with pytest.raises(store.BrokenRows, match="chunk has page"):
        store.persist(root, bad, "c")
    assert words(spark, root) == {(1, "old"): 2}


@pytest.mark.parametrize("n", [1, 2, 3, 997])
def test_quantiles_by_selection(spark, n):
    r = random.Random(n)
    rows = [(g, r.choice([r.random() * 100, float(r.randint(0, 5))])) for g in ("a", "b") for _ in range(n)] + [("a", None), ("c", None)]
    got = {x.g: x for x in evaluation.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        want = np.percentile([v for k, v in rows if k == g and v is not None], [0, 50, 95, 100])
        assert [got[g][f"q{i}"] for i in range(4)] == pytest.approx(want.tolist())


def test_token_f1_in_the_row(spark):
    r = random.Random(3)
    pairs = [(i, r.choices("abcd", k=r.randint(0, 9)), r.choices("abcde", k=r.randint(0, 9))) for i in range(60)] + [(60, None, ["a"]), (61, [], [])]
    got = {x.pair_id: (x.common, x.f1) for x in evaluation.token_f1(spark.createDataFrame(pairs, "pair_id int, a array<string>, b array<string>"), F.col("a"), F.col("b")).collect()}
    for i, a, b in pairs:
        n = sum((Counter(a or []) & Counter(b)).values())
        assert got[i] == (n, round(2 * n / (len(a or []) + len(b)), 4) if n else 0.0)


@pytest.fixture(scope="module")
def inputs(spark):
    hits = spark.createDataFrame([(q, i, i + 1, i == q) for q in range(3) for i in range(4)], "query_id int, item int, rank int, relevant boolean")
    worse = hits.withColumn("rank", 5 - F.col("rank"))
    answers = [(0, True, "grounded", "Rome", "Rome", 2, 2, 0, 0, 0, [1], [1], "x"), (1, True, "unsupported", None, "Paris", 2, 1, 1, 0, 0, [2], [1], "x"), (2, False, "unsupported", "It is so", None, 2, 1, 0, 1, 0, [1], [], None), (3, False, "empty", None, None, 0, 0, 0, 0, 0, [], [], "y")]
    kind = "query_id int, answerable boolean, status string, answer string, expected string, claims int, supported int, unsupported int, contradicted int, conflicted int, cited array<int>, relevant array<int>, category string"
    several = spark.createDataFrame([(0, [1, 2], [1, 2], [1, 2], False, 1.0, 0, 0), (1, [1, 2], [1], [1], False, 1.0, 0, 0)], "query_id int, required array<int>, retrieved array<int>, cited array<int>, refused boolean, support_rate double, unsupported int, contradicted int")
    samples = spark.createDataFrame([("retrieval", 60.0), ("retrieval", 80.0), ("other", 5.0)], "stage string, ms double")
    return evaluation_run.Inputs(hits, worse, spark.createDataFrame([(q, 1) for q in range(3)], "query_id int, n_relevant int"), spark.createDataFrame(answers, kind), several, samples)


def test_an_evaluation_run_is_read_back(spark, inputs, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(evaluation_run.IncompleteRun):
        evaluation_run.read(spark, path)
    evaluation_run.run(inputs, "Marks", path)
    got = {n: t.collect() for n, t in evaluation_run.read(spark, path).items()}
    assert set(got) == {"retrieval", "movement", "grounding", "categories", "safety", "query_types", "multipage", "latency", "latency_total"}
    g = got["grounding"][0]
    assert (g.questions, g.answerable, g.claims, g.supported, g.support_rate, g.answerable_support_rate, g.refusals, g.incorrect_answers, g.refusal_precision, g.success_rate, g.mean_f1) == (4, 2, 6, 4, 0.6667, 0.75, 1, 1, 0.5, 0.5, 0.5)
    c = {r.category: r for r in got["categories"]}
    assert set(c) == {"x", "y", "uncategorized"} and (c["y"].success_rate, c["uncategorized"].success_rate, c["x"].success_rate, c["y"].support_rate) == (1.0, 0.0, 0.5, 0.0)
    assert got["multipage"][0].status == "FAIL" and got["multipage"][0]["pass"] == 1 and got["safety"][0].status == "FAIL"
    assert {r.stage: (r.mean, r.bottleneck) for r in got["latency"]} == {"retrieval": (70.0, True), "other": (5.0, False)} and got["latency_total"][0].slowest == "retrieval"
    assert {r.category: r.status for r in got["query_types"]}["y"] == "PASS" and {r.stage for r in got["retrieval"]} == {"retrieval", "reranking"}
    assert "# Marks" in (tmp_path / "run" / "summary.md").joinpath(next(f.name for f in (tmp_path / "run" / "summary.md").iterdir() if f.name.startswith("part-"))).read_text()
    spark.createDataFrame([("x",)], "a string").write.mode("append").json(f"{path}/safety.json")
    with pytest.raises(evaluation_run.IncompleteRun, match="safety"):
        evaluation_run.read(spark, path)
