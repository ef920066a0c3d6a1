"""Every catalogue query against its SQL oracle, and the queries without one against their own properties."""

import os

import duckdb
import pytest

from folio.plans import catalog

TABLES = "events documents embeddings pages benchmark labels conversations".split()


def canon(df):
    df = df[sorted(df.columns)]
    text = lambda x: "~" if x is None or x != x else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__.startswith(("float", "int")) else str(x)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{os.path.join(data, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, duck, name):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_queries_without_sql_have_models():
    """tests/test_models.py and others compare these with models of them."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"clean_text", "split_sentences", "chunk_pages", "chunk_documents", "eligible_chunks", "answer_candidates", "greedy_neardup", "stream_ingest_idempotent", "question_ledger", "generated_questions", "section_labels", "extractive_answers"}


def test_entry():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
