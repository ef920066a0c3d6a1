"""Collocations, exact duplicates and fill-in-the-middle against brute force: nulls, empties, long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from folio.llm import collocations, exact_dedup, infill

KIND = "doc_id bigint, text string, lang string, source string, n bigint, phrase string, file string, digest string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = "New york Straße été 東京 a b c x1 the The of".split()
    text = lambda k: "".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\n", " \r"]) for w in r.choices(words, k=k))
    out = [(i, text(r.randint(1, 40)), r.choice(["en", "de", None, "und"]), "s", 1, "clash", "clash", "clash") for i in range(120)]
    out += [(200, out[0][1], "en", "s", 1, "x", "y", "z"), (201, out[0][1].upper(), "en", "s", 1, "x", "y", "z"), (None, "null id", "en", "s", 1, "x", "y", "z"), (None, "null id", "en", "s", 1, "x", "y", "z"), (None, out[1][1], "en", "s", 1, "x", "y", "z")]
    out += [(202, None, None, None, None, None, None, None), (203, "", "en", "s", 0, "x", "y", "z"), (204, " \n\n", "en", "s", 0, "x", "y", "z"), (205, "has <S> in it\nand more", "en", "s", 0, "x", "y", "z"), (3, out[3][1], "en", "s", 1, "x", "y", "z"), (3, "other text", "en", "s", 1, "x", "y", "z")]
    out += [(206, "é" * 70_000 + "\n" + "line of words, \n" * 9_000 + "end", "en", "s", 1, "x", "y", "z"), (207, "no line end " * 12_000, "de", "s", 1, "x", "y", "z")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def brute_collocations(rows, least, most):
    f, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            c = f.setdefault(lang, Counter())
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, b.decode(), -a, left, right, total[lang], -s) for i, (s, a, b, left, right) in enumerate(sorted(kept)[:most])]
    return Counter(out)


@pytest.mark.parametrize(("least", "most", "limits"), [(10, 2000, {}), (3, 7, {"words": 50, "part": 20, "block": 100}), (3, 2000, {"bits": 2})])
def test_collocations(docs, rows, least, most, limits):
    """Small blocks, pivots in parts, and four buckets for all words change nothing."""
    assert Counter(tuple(r) for r in collocations.collocations(docs, least, most, **limits).collect()) == brute_collocations(rows, least, most)


def test_fragments_own_their_ngrams(docs, rows):
    """Every occurrence of an n-gram lies in one fragment: fragments' n-grams add up to all n-grams."""
    import numpy as np

    texts = docs.selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text")
    got = collocations.mined(collocations.fragments(texts, np.ones(1 << collocations.BITS, np.int64), 1), 1)
    want = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert {(r.lang, r.phrase): r.f for r in got.collect()} == want


def test_collocation_products_pass_64_bits(spark):
    grams = spark.createDataFrame([("en", "a", 10**12), ("en", "b", 10**12 + 1), ("en", "a b", 10**12 - 1)], "lang string, phrase string, f bigint")
    r = collocations.scored(grams).first()
    assert r.score == 10**6 * (10**12 - 1) ** 2 // (10**12 * (10**12 + 1))


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).count() == 0


def check_dedup(got, rows):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    key = lambda x: -1 if x is None else x
    assert Counter((r.text_sha256, r.doc_id) for r in got) == Counter((h, i) for h, ids in of.items() for i in ids)
    for r in got:
        ids = of[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(ids), max(ids, key=key))
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(of))


@pytest.mark.parametrize(("width", "batch"), [(16, 1 << 36), (1, 1 << 36), (16, 1)])
def test_exact_dedup(spark, docs, rows, tmp_path, width, batch):
    """Also with digests of one byte, which unequal texts share, and with one file a micro-batch."""
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    check_dedup(exact_dedup.deduplicate(spark, str(tmp_path / "documents.parquet"), width, batch).collect(), rows)


def test_exact_dedup_state_meets_later_files(spark, rows, tmp_path):
    """The state of an earlier run is there when more files arrive; entries have no expiry."""
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    kinds = spark.createDataFrame([], KIND).select("doc_id", "text").schema
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
        exact_dedup.retain(exact_dedup.located(spark.readStream.schema(kinds).parquet(path), 16).select("doc_id", "digest", "file", "row"), folder)
    state = exact_dedup.entries(spark, folder)
    assert state.agg({"n": "sum"}).first()[0] == len(rows)
    got = exact_dedup.resolve(exact_dedup.located(spark.read.parquet(path), 16), state).selectExpr("doc_id", "keep_id", "group_size", "kept", "lower(hex(sha)) as text_sha256")
    check_dedup(got.collect(), rows)


def test_exact_dedup_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert exact_dedup.deduplicate(spark, str(tmp_path / "documents.parquet")).count() == 0


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (doc_id, len(units), "plain", None, None, text)
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_infill(docs, rows, block):
    some = rows if block > 5 else [r for r in rows if len(r[1] or "") < 1000]
    got = [tuple(r) for r in infill.transform(docs.where(f"length(coalesce(text, '')) < {10**9 if block > 5 else 1000}"), size=block).collect()]
    assert Counter(got) == Counter(brute_infill(r[0], r[1]) for r in some)


def test_infill_round_trip(docs, rows, empty):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = infill.digests(docs).collect()
    assert Counter((r.doc_id, r.restored_sha256) for r in got) == Counter((r[0], sha(r[1] or "")) for r in rows)
    assert Counter((r.doc_id, r.output_sha256) for r in got) == Counter((r[0], sha(brute_infill(r[0], r[1])[5])) for r in rows)
    assert infill.digests(empty).count() == 0


def test_infill_rates(docs):
    assert {r.form for r in infill.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.transform(docs, spm=100).collect()} == {"plain", "spm"}
