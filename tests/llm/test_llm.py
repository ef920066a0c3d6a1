"""The training-data operators against brute force, on small fixtures with nulls, empties, ties, repeats, clashing and missing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from folio.llm import attention, decontam, edit_embed, fm_index, html_cut, langid, lm_score, mixing, ngrams, quality, simhash, toxicity, url_tree
from folio.llm.components import components

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, sid string"
WORDS = "the of and stone river cloud green apple house night bright road winter summer little song over under again never".split()


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 60))), r.choice(["en", "de"]), r.choice(["a", "b", None]), 1, "clash", "clash") for i in range(40)]
    out += [(40, out[0][1], "en", "a", 1, "x", "y"), (41, None, None, None, None, None, None), (42, "", "en", "b", 0, "x", "y"), (None, "some stone", "en", "a", 3, "x", "y"), (43, "x " * 70_000, "en", "a", 1, "x", "y"), (1, out[1][1], "en", "b", 1, "x", "y"), (44, "123 !!", "de", "b", 1, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_simhash_matches_brute_force(docs, rows):
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs).collect()]
    fp = [brute_fingerprint(r[1]) for r in rows]
    assert Counter((d, f) for d, f, _ in got) == Counter((r[0], f) for r, f in zip(rows, fp))
    g = groups([(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3], range(len(fp)))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[g[i]] = min(least.get(g[i], 1 << 60), r[0])
    assert Counter((d, c) for d, _, c in got) == Counter((r[0], least.get(g[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("cap", [1 << 22, 2000])
def test_ball_hashing_finds_every_link(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "VARIANTS", cap)
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(150)]
    for base in list(fps[:60]):
        for _ in range(3):
            fps.append(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    centre = r.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    links = [(x.u, x.v) for x in simhash.near_links(df, len(fps)).collect()]
    assert links
    want = groups([(signed(a), signed(b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3], [signed(f) for f in fps])
    assert groups(links, [signed(f) for f in fps]) == want
    found = {x.u: x.v for x in components(simhash.near_links(df, len(fps))).collect()}
    assert {f: found.get(f, f) for f in [signed(f) for f in fps]} == want


def test_simhash_of_nothing(empty):
    assert simhash.near_groups(empty).count() == 0 and simhash.dedup(empty).count() == 0


def test_dedup_keeps_one_of_each_group(docs):
    kept = simhash.dedup(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 40 not in ids and ids.count(1) == 1 and 0 in ids and ids.count(None) == 1


def test_dedup_judges_rows_without_or_with_equal_ids_by_their_texts(spark):
    r = random.Random(21)
    text = [" ".join(r.choices(WORDS, k=50)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (8, text[2]), (5, text[3]), (5, text[4]), (5, text[4]), (9, text[4]), (6, text[5]), (None, None), (None, "")]
    got = [tuple(g) for g in simhash.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    null = [t for d, t in got if d is None]
    assert sorted(g for g in got if g[0] is not None) == sorted([(8, text[2]), (5, text[3]), (5, text[4]), (6, text[5])])
    assert sorted(t for t in null if t) == sorted([text[0], text[1]]) and len(null) == 3


def test_dedup_keeps_a_whole_row(spark):
    rows = [(1, "one two three", "b"), (1, "one two three", "a"), (2, "four five six seven", None), (2, "four five six seven", None), (None, None, "x"), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    got = Counter(tuple(r) for r in simhash.dedup(docs).collect())
    assert sum(got.values()) == 3 and got <= Counter(rows) and {r[1] or "" for r in got} == {"one two three", "four five six seven", ""}


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<p>a<b>b</b>&amp;amp;<br>c</p>", "ab&amp; c"), ("just text", "just text"),
    ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One  two.<p>Three.<section class='comments'><p>I agree with all of that.</p></section></article><footer>c</footer><script>if (a<b) x('</p>')</script>", "T One two. Three."),
    ("<main><p>Kept words here.</p><form><p>Your name</p></form><div class='ad'>Buy now</div><p>Also kept.</p></main><aside>Other things to read today</aside>", "Kept words here. Also kept."),
    ("<p>broken < markup & <i>more", "broken < markup & more"),
])
def test_html_main_text(html, want):
    assert html_cut.main_text(html) == want


def test_minimum_cut_is_least():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(1, 9)
        t = [r.uniform(-2, 2) for _ in range(n)]
        e = [(a, b, r.uniform(0, 1.5)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda x: sum(max(0, v) if not y else max(0, -v) for v, y in zip(t, x)) + sum(w for a, b, w in e if x[a] != x[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_cut.minimum_cut(t, e)) == pytest.approx(best, abs=0.02)


LONG = "words of the article " * 30


@pytest.mark.parametrize("html, want", [
    (f"<div class='search-engine'><article><h1>T</h1><p>{LONG}</p><p>Short.</p></article></div><nav><a href=x>Home</a></nav>", f"T {LONG}Short."),
    (f"<nav><a href=x>Home page</a></nav><div class='recommended-reading'><h1>Head</h1><p>{LONG}</p><p>Short.</p></div><div class='sidebar'>Sign up for mails</div><footer>(c) us</footer>", f"Head {LONG}Short."),
    (f"<article><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><section class='comments'><p>{'a long comment on it ' * 10}</p><p>First!</p></section></article>", f"{LONG}Yes. {LONG.strip()}"),
    ("<p>a</p><svg><path></path><p>Rest of it</p>", "a Rest of it"), ("<svg><svg></svg>in</svg>out", "out"), ("<object><p>b</p><iframe><p>c</p>", "b c"),
    ("<p>kept</p><style>p{}<p>lost</p>", "kept"), ("<p>x</p><p hidden>not shown</p>", "x"),
])
def test_html_no_name_or_open_tag_takes_the_page(html, want):
    assert html_cut.main_text(html) == want.strip()


def test_html_labels_are_the_cuts_not_the_classifiers():
    found, prefer, label = html_cut.labelled(f"<article><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><div>Buy</div></article><div>Buy</div>")
    assert [p > 0 for p in prefer] == [True, False, True, False, False] and label == [True, True, True, True, False]


def test_html_of_open_tags_takes_time_in_proportion():
    import time

    for part in ("<a ", "<div>", "<div class='ad'>x", "</p>", "<svg>", "<!", "<a href='"):
        begin = time.time()
        html_cut.main_text("<div>" * 20_000 + part * 20_000 + "</p>" * 20_000)
        assert time.time() - begin < 5, part


def test_extract_of_an_empty_table_and_repeats(spark):
    p = spark.createDataFrame([(1, "u", "<p>x</p>")] * 3, "page_id bigint, url string, html string")
    assert html_cut.extract(p.limit(0)).count() == 0 and html_cut.extract(p).distinct().count() == 1 and html_cut.extract(p).count() == 3


def test_extract_keeps_rows(spark):
    p = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 5), (None, None, None, None, None)], "page_id int, url string, html string, text string, n_chars int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_cut.extract(p).collect()) == [(0, "", 0), (1, "x", 1)]


def test_fm_index_against_a_scan():
    r = np.random.default_rng(2)
    for _ in range(30):
        runs = [r.integers(1, 5, r.integers(1, 30)) for _ in range(r.integers(1, 12))]
        seq = np.concatenate([np.append(x, 0) for x in runs])
        ix = fm_index.FMIndex(seq, 5, every=4)
        for n in (1, 2, 5):
            pats = r.integers(1, 5, (10, n))
            lo, hi = ix.search(pats)
            for p, a, b in zip(pats, lo, hi):
                want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]
                assert sorted(ix.locate(np.arange(a, b)).tolist()) == want


def brute_contamination(rows, items, width=13):
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))
    wins = {}
    for i, t in items:
        w = find(t)
        n = min(width, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in rows:
        w, hit, its = find(t), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit |= set(range(a, a + n))
                    its |= wins[k]
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("shard, block", [(3_000_000, 1 << 20), (50, 7)])
def test_decontamination_matches_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    r = random.Random(9)
    items = [(i, " ".join(r.choices(WORDS, k=r.choice([3, 13, 14, 30])))) for i in range(12)] + [(99, ""), (100, None), (3, "Stone, RIVER stone"), (None, "green apple house")]
    text = [" ".join(r.choices(WORDS, k=200)) for _ in range(20)]
    for i in range(12):
        text.append(" ".join(r.choices(WORDS, k=5)) + " " + items[i][1].upper() + "; " + items[i][1] + " end")
    rows = [(i, t) for i, t in enumerate(text)] + [(7, text[7]), (None, "a green apple house"), (500, None), (501, ""), (502, "Ünder stone-river/STONE")]
    got = decontam.judged(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).drop("spans", "items").collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, got)) == sorted(map(key, brute_contamination(rows, items)))


def test_a_full_block_of_windows_takes_bounded_memory():
    """Of words that are all different, the worst case; what is sent is about the text, and both stay far below the driver's memory."""
    import pickle
    import tracemalloc

    words = [b"w%06x" % i for i in range(decontam.BLOCK_WINDOWS + 12)]
    tracemalloc.start()
    w = decontam.Windows([("1", words)])
    sent = pickle.dumps(w)
    got = pickle.loads(sent)
    windows, items, first = got.by_length[13]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(windows) == decontam.BLOCK_WINDOWS and len(items) == len(first) - 1 and got.ids[words[5]] == 6
    assert peak < 300e6 and len(sent) < 10e6


def test_long_items_are_cut_into_pieces_that_share_words(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 10)
    item = " ".join(f"w{i}" for i in range(60))
    docs = [(1, f"a {item} b"), (2, " ".join(item.split()[20:33])), (3, " ".join(item.split()[20:32]))]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.judged(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (60, 1), 2: (13, 1), 3: (0, 0)}


def test_decontamination_of_nothing(spark, empty, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.judged(empty, none).count() == 0
    assert decontam.judged(docs, none).where("n_hit > 0").count() == 0 and decontam.clean(docs, none).count() == docs.count()


def test_clean_judges_each_row_by_its_own_text(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    free = [" ".join(f"{a}{i}" for i in range(30)) for a in "abc"]
    rows = [(1, free[0], "p", 1), (1, item, "q", 2), (None, free[1], "r", 3), (None, item.upper(), "s", 4), (None, None, "t", 5), (3, "", "u", 6), (4, item + " " + free[2] * 30, "v", 7), (1, free[0], "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string, n_words int")
    bench = spark.createDataFrame([(1, item), (2, free[2][:20])], "item_id bigint, text string")
    for block in (16 << 20, 10):
        monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
        kept = decontam.clean(docs, bench)
        assert kept.schema == docs.schema and Counter(tuple(r) for r in kept.collect()) == Counter(r for r in rows if r[3] not in (2, 4))
    assert decontam.clean(docs.limit(0), bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == len(rows)


def brute_attention(m, seq, targets):
    """Log-probabilities of one sequence's targets, a position at a time in plain arithmetic."""
    w, s, out = m.w, m.stride, []
    for i, y in enumerate(targets):
        slot = i % s
        seen = range(max(0, i - slot - s), i + 1)  # the window begins a stride before the position's own stride
        q = w["emb"][seq[i]] @ w["wq"]
        a = np.array([q @ (w["emb"][seq[j]] @ w["wk"]) * w["wq"].shape[1] ** -0.5 + w["pos"][slot, j - (i - slot - s)] for j in seen])
        a = np.exp(a - a.max())
        h = w["emb"][seq[i]] + sum(p * (w["emb"][seq[j]] @ w["wv"]) for p, j in zip(a / a.sum(), seen)) @ w["wo"]
        h = np.append(h + np.maximum(h @ w["w1"] + w["b1"], 0) @ w["w2"], 1)
        lp = 0
        for level in range(attention.LEVELS):
            logits = h @ w[f"out{level}"][m.prefix[level][y]]
            lp += logits[m.digit[level][y]] - np.log(np.exp(logits).sum())
        out.append(lp)
    return out


def some_attention(tokens=20, stride=4):
    m = attention.Attention.new(np.concatenate([[0], np.arange(tokens, 0, -1)]).astype(float), 8, 12, stride)
    r = np.random.default_rng(3)
    for k in m.w:
        m.w[k] = (m.w[k] + r.standard_normal(m.w[k].shape) * 0.2 * (m.w[k] > -29)).astype(np.float32)
    return m


def test_attention_scores_are_those_of_plain_arithmetic_and_sum_to_one():
    m = some_attention()
    r = np.random.default_rng(1)
    lengths = np.array([1, 4, 5, 23])
    x, y = r.integers(1, 21, lengths.sum()), r.integers(1, 21, lengths.sum())
    ends = np.cumsum(lengths)
    want = [v for a, b in zip(ends - lengths, ends) for v in brute_attention(m, x[a:b], y[a:b])]
    for batch, block in ((1, 8), (3, 64), (128, 1 << 15)):
        assert np.allclose(attention.Scorer(m, batch, block)(x, lengths, y), want, atol=1e-4)
    total = sum(np.exp(attention.Scorer(m)(x, lengths, np.full(lengths.sum(), k))) for k in range(1, 21))
    assert np.allclose(total, 1, atol=1e-4)
    later = x.copy()
    later[-1] = 1 + later[-1] % 20
    assert np.allclose(attention.Scorer(m)(later, lengths, y)[:-1], want[:-1], atol=1e-4)  # causal


def test_attention_gradient_is_that_of_small_steps():
    m = some_attention(9)
    r = np.random.default_rng(2)
    win, want = attention.examples(m, r.integers(1, 10, 30), np.array([11, 19]), r.integers(1, 10, 30))
    g, loss = attention._gradient(m, win, want)
    for name in m.w:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        up, down = m.copy(), m.copy()
        up.w[name][at] += 0.004
        down.w[name][at] -= 0.004
        slope = (attention._gradient(up, win, want)[1] - attention._gradient(down, win, want)[1]) / 0.008
        assert slope == pytest.approx(g[name][at], rel=0.1, abs=1e-3), name


def test_attention_learns():
    seq = np.array([2, 3, 4, 5] * 200)
    m = attention.Attention.new(np.ones(6), 8, 8, 4)
    win, want = attention.examples(m, seq[:-1], np.array([len(seq) - 1]), seq[1:])
    pick = np.random.default_rng(1)
    attention.train(m, ((win[p], want[p]) for p in (pick.integers(0, len(win), 32) for _ in range(120))), 120)
    assert attention.Scorer(m)(seq[:-1], np.array([len(seq) - 1]), seq[1:])[8:].mean() > -0.5
    assert (attention.flat(attention.filled(m, attention.flat(m))) == attention.flat(m)).all()


def test_attention_training_is_adams():
    """Weights after some steps are those of plain Adam, also of tokens and codes that a batch lacks."""
    r = np.random.default_rng(4)
    m = some_attention(60)
    win, want = attention.examples(m, r.integers(1, 20, 400), np.array([150, 250]), r.integers(1, 20, 400))
    order, steps, plain = r.permutation(len(win)), 9, m.copy()
    first, second = ({k: np.zeros(v.shape) for k, v in m.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        g, _ = attention._gradient(plain, win[order[step::steps]], want[order[step::steps]])
        for k, x in g.items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * x, 0.99 * second[k] + 0.01 * x.astype(float) ** 2
            rate = 0.02 * step / 50 * (1 - 0.95 * step / steps)
            plain.w[k] = (plain.w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    attention.train(m, ((win[order[i::steps]], want[order[i::steps]]) for i in range(1, steps + 1)), steps, 0.02)
    assert np.abs(attention.flat(m) - attention.flat(plain)).max() < 1e-4


def test_attention_fit_is_training_without_the_tokens_that_no_window_has():
    r = np.random.default_rng(6)
    m = some_attention(60)
    x = r.choice([2, 3, 17, 40, 41, 59], 200)
    win, want = attention.examples(m, x, np.array([80, 120]), np.roll(x, -1))
    picks, whole, begun = [r.integers(0, len(win), 16) for _ in range(12)], m.copy(), m.copy()
    attention.train(whole, ((win[p], want[p]) for p in picks), 12, 0.02)
    attention.fit(m, win, want, iter(picks), 12, 0.02)
    assert np.allclose(attention.flat(m), attention.flat(whole), atol=1e-5) and not np.allclose(attention.flat(m), attention.flat(begun), atol=1e-2)
    assert (m.w["emb"][4] == begun.w["emb"][4]).all()


@pytest.fixture
def small_lm(monkeypatch):
    for k, v in (("COMMON", 10), ("STEPS", 3), ("WARM", 20_000), ("SHARD", 20_000), ("RATE", 0.5)):
        monkeypatch.setattr(lm_score, k, v)


def test_lm_baseline_is_exact(docs, rows, small_lm):
    learnt = Counter()
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + ["\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    for r in rows:
        if not held(r[0]):
            learnt.update(tok(r[1]))
    n, v = sum(learnt.values()), len(learnt)
    want = sorted((str(r[0]), held(r[0]), len(w := tok(r[1])), sum(learnt[x] > 0 for x in w), n, round(sum(math.log10((learnt[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for r in rows)
    got = lm_score.score(docs).collect()
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 4)) for g in got) == want
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)
    by = {g.doc_id: g.score for g in got}
    assert by[0] == pytest.approx(by[40], rel=1e-5) and by[41] == pytest.approx(by[42], rel=1e-5)


def test_lm_score_is_the_attention_models(spark, small_lm):
    r = random.Random(5)
    texts = [None, "", "Aa bb", "long" * 60, " ".join(r.choices(WORDS, k=90)), " ".join(r.choices(WORDS, k=9)) + "\n\tÜber café 日本"] + [" ".join(r.choices(WORDS, k=40)) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = lm_score.word_counts(d).cache()
    m = lm_score.train(d, counts)
    lm_score.know(m, counts)
    got = {g.doc_id: g.score for g in lm_score.scored(d.withColumn("held_out", ~lm_score.learns()), m, counts).collect()}
    encode, end = lm_score.encoder(m.ranks), lm_score.VOCABULARY + 1
    for i, t in enumerate(texts):
        seq = [k for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for k in encode(w.encode())] + [end]
        assert got[i] == pytest.approx(sum(brute_attention(m.attention, [end] + seq[:-1], seq)) / math.log(10), rel=1e-4)


def test_lm_beats_its_base_on_held_out_texts_of_two_languages(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "STEPS", 300)
    r = random.Random(3)
    words = [[a + b + c for a in x for b in x for c in x] for x in (("ka", "lo", "mi", "tu", "re"), ("sch", "ber", "ung", "ein", "and"))]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words[i % 2], k=60))) for i in range(300)], "doc_id bigint, text string")
    held = [g for g in lm_score.score(docs).collect() if g.held_out]
    assert len(held) > 30 and sum(g.score for g in held) > sum(g.base_score for g in held) + 0.1 * sum(g.n_tokens for g in held)


def test_lm_words_spelt_in_one_call_are_those_spelt_one_by_one():
    words = [b"the", b"x" * 62, b"x" * 63, b"x" * 64, b"x" * 200, "日本".encode() * 70, "a\u00a0b\u2003c\x1c".encode(), b"\xff\xe4\xb8", b"\xe4\xb8", "straße".encode(), b"!?..", b"the"]
    vocabulary = lm_score.ranks()
    encode, s = lm_score.encoder(vocabulary), lm_score.Spelling(words, lm_score.speller(vocabulary), lm_score.begins_word(vocabulary))
    assert [s.flat[a : a + n].tolist() for a, n in zip(s.begin, s.size)] == [encode(w) for w in words]
    assert len(lm_score.Spelling([], lm_score.speller(vocabulary), lm_score.begins_word(vocabulary)).size) == 0


def test_lm_passages_come_from_all_of_a_text(spark):
    text = " ".join(f"w{i}" for i in range(4000))
    d = spark.createDataFrame([(7, text), (8, None), (9, "x" * 9000)], "doc_id bigint, text string")
    got = lm_score.passages(d, 1.0, 1).collect()
    words = sorted((bytes(g.text).strip() for g in got if bytes(g.text).strip()[:1] == b"w"), key=lambda t: text.index(t.decode()))
    assert b" ".join(words) == text.encode()
    assert sum(g.begins for g in got) == 3 and all(len(g.text) <= 3 * lm_score.SPAN for g in got)
    few = lm_score.passages(d, 0.3, 1).count()
    assert 0 < few < len(got)


def test_lm_fits_its_weights_on_all_learning_text(spark, monkeypatch):
    taught = []
    real = lm_score.passages
    monkeypatch.setattr(lm_score, "passages", lambda d, rate, seed: taught.append(real(d, rate, seed)) or taught[-1])
    monkeypatch.setattr(lm_score, "STEPS", 3)
    texts = [" ".join(f"w{i}x{j}" for j in range(600)) for i in range(60)]
    lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    fitted = Counter(w for r in taught[-1].collect() for w in bytes(r.text).split())
    assert fitted == Counter(w.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())


def test_lm_of_nothing(empty, small_lm):
    assert lm_score.score(empty).count() == 0


def test_language_id(docs, empty, spark):
    r = random.Random(5)
    de, en = "und der die nicht ein schön straße".split(), "and the this not one nice street".split()
    d = spark.createDataFrame([(i, " ".join(r.choices(de if i % 2 else en, k=30)), "de" if i % 2 else "en") for i in range(200)] + [(900, None, "en"), (901, "12 -", "de"), (None, "the nice street", None)], "doc_id bigint, text string, lang string")
    got = {g.doc_id: g for g in langid.identify(d).collect()}
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") and 0 <= got[i].score <= 1 for i in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "en" and len(got) == 203
    assert all(g.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, g in got.items())
    assert langid.identify(empty).count() == 0
    kept = langid.known_language(d)
    assert kept.count() == 201 and kept.columns == d.columns


def test_temperature_and_penalty():
    rows = [(i % 2, np.array([i % 2, 2]), np.array([1, 0.1], np.float32)) for i in range(60)]
    w, _ = langid.ftrl(rows, 2, 5)
    assert w[0, 0] > 0 > w[1, 0] and not w[:, 3:].any()
    assert langid.temperature(np.array([[9.0, 0.0], [9.0, 0.0]]), np.array([0, 1])) > 1


def test_ngram_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Grüße an alle 😀 " * 40
    want = ngrams.counts(text)
    monkeypatch.setattr(ngrams, "_CHUNK", 7)
    assert (ngrams.counts(text) == want).all()


def test_quality_orders_grades(spark, empty):
    r = random.Random(6)
    make = {0: lambda: " | ".join(r.choices(WORDS, k=20)), 1: lambda: " ".join(r.choices(WORDS, k=20)), 2: lambda: ". ".join(r.choices(WORDS, k=20)).title()}
    rows = [(i, make[i % 3]()) for i in range(240)] + [(999, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, i % 3, 0) for i in range(240)] + [(None, 1, 0), (5000, None, None)], "doc_id bigint, quality int, toxic int")
    got = {g.doc_id: g for g in quality.graded(d, lab).collect()}
    grade = [np.mean([got[i].expected_grade for i in range(240) if i % 3 == k and got[i].held_out]) for k in range(3)]
    assert grade[0] < grade[1] < grade[2] and len(got) == 241
    assert np.mean([got[i].keep == (i % 3 > 0) for i in range(240) if got[i].held_out]) > 0.9
    assert quality.graded(empty, lab).count() == 0
    none = quality.good(d, lab.limit(0))
    assert none.count() == 241 and none.columns == d.columns


def test_toxicity(spark, empty):
    r = random.Random(7)
    bad = lambda: r.choice(["grum", "zork"]) + r.choice(["pel", "nax", "tid", ""])
    rows = []
    for i in range(600):
        w = r.choices(WORDS, k=40)
        if i % 4 == 0:
            w[r.randrange(40)] = bad()
            w[r.randrange(40)] = bad()
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows + [(700, None), (701, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(700, 0), (None, 1)], "doc_id bigint, toxic int")
    got = {g.doc_id: g for g in toxicity.toxicity(d, lab).collect()}
    held = [g for g in got.values() if g.held_out and g.doc_id < 600]
    assert np.mean([g.predicted == (g.doc_id % 4 == 0) for g in held]) > 0.95
    assert got[700].predicted == got[701].predicted == 0 and got[700].score == got[701].score
    assert toxicity.toxicity(empty, lab).count() == 0
    flat = toxicity.toxicity(d, lab.limit(0)).collect()
    assert len({g.score for g in flat}) == 1 and 0 <= flat[0].score <= 1


def brute_log_likelihoods(texts, prior, symbols):
    """Each class's log-probability of every symbol of symbols (context, symbol), by Kneser-Ney counts in dictionaries."""
    c = [Counter(), Counter()]
    for y, t in texts:
        for w in t.split():
            w += b" "
            for i in range(len(w)):
                c[y][w[max(0, i - toxicity.CONTEXT) : i], w[i : i + 1]] += 1
    seen = set(c[0]) | set(c[1])
    size = lambda g: len(g[0]) + 1
    follows = {g: sum(max(prior[y], 0.02) * (c[y][g] > 0) for y in range(2)) for g in seen}
    out = []
    for y in range(2):
        p = []
        for h, s in symbols:
            n = sum(v for g, v in c[y].items() if g[0] == h)
            left = sum(min(v, toxicity.DISCOUNT) for g, v in c[y].items() if g[0] == h) / n if n else 1
            like = [g for g in seen if size(g) == len(h) + 1 and g[0][1:] == h[1:]]
            low = sum(follows[g] for g in like if (g[0] + g[1])[1:] == (h + s)[1:]) / max(1e-300, sum(follows[g] for g in like))
            p.append((max(c[y][h, s] - toxicity.DISCOUNT, 0) / n if n else 0, left, low))
        out.append(p)
    return out


def test_log_ratios_are_those_of_the_two_models():
    r = random.Random(11)
    texts = [(int(r.random() < 0.4), " ".join(r.choices(["gruen", "gruem", "grued", "rot", "rost", "ab", "abenteuerlich"], k=6)).encode()) for _ in range(40)]
    prior = np.array([0.9, 0.1])
    m = toxicity.count(texts, prior)
    for w in (b"gruen", b"grued", b"gruex", b"rotx", b"abenteuerlich", b"zzz"):
        keys, _ = toxicity.spelt(w)
        full = w + b" "
        got = toxicity.ratios(m, keys)
        for k, (o, t) in enumerate(zip(*brute_log_likelihoods(texts, prior, [(full[max(0, i - toxicity.CONTEXT) : i], full[i : i + 1]) for i in range(len(full))]))):
            low = o[2] or 1e-4  # any shared value: both classes multiply it alike
            assert got[k] == pytest.approx(math.log((t[0] + t[1] * low) / (o[0] + o[1] * low)), abs=1e-4)


def test_evidence_is_that_of_the_most_toxic_passage(monkeypatch):
    m = toxicity.count([(0, b"aa bb cc dd aa bb cc dd ee ff"), (1, b"aa bb xx dd xx yy")], np.array([0.5, 0.5]))
    judge = toxicity.Judge(m)

    def brute(text):
        words = text.split()
        one = {w: (toxicity.ratios(m, toxicity.spelt(w)[0]).sum(), len(w) + 1) for w in words}
        n = min(toxicity.PASSAGE, len(words))
        return max(sum(one[w][0] for w in words[i : i + n]) / sum(one[w][1] for w in words[i : i + n]) for i in range(len(words) - n + 1)) if n else 0

    some = [b"", b"xx", b"xx yy", b"aa bb cc dd xx ee ff aa yy", b"qq " * 50 + b"xx yy aa", None, b" ?! ", b"xx"]
    assert judge.evidence(some) == pytest.approx([brute(t or b"") if t != b" ?! " else 0 for t in some])
    long = b"aa bb cc dd " * 90_000 + b"xx xx yy " + b"cc dd " * 90_000
    want = pytest.approx([brute(b"aa bb cc dd xx xx yy cc dd"), brute(b"xx")])
    assert judge.evidence([long, b"xx"]) == want and judge.evidence([]).tolist() == []
    monkeypatch.setattr(toxicity, "KNOWN", 12)
    assert toxicity.Judge(m).evidence([long, b"xx"]) == want


def test_toxicity_of_repeats_and_clashing_columns(spark):
    rows = [(i % 50, f"some words {'vile' if i % 5 == 0 else 'mild'} end", 0.5, 1) for i in range(200)] + [(None, None, 0.1, 0), (None, "vile", 0.2, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, predicted int")
    labels = spark.createDataFrame([(i % 50, int(i % 5 == 0), "x") for i in range(100)], "doc_id bigint, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 202 and all((g.predicted == 1) == (g.doc_id % 5 == 0) for g in got if g.doc_id is not None)


def test_mixing_targets():
    assert mixing.targets([10, 10, 10]) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.targets([100, 1, 0]) == pytest.approx([149.5, 2, 0]) or sum(mixing.targets([100, 1, 0])) <= 151.5
    assert mixing.targets([]) == []


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 77).tolist()) == list(range(n))


def test_mixing(docs, rows, monkeypatch, spark):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "RUN_DOCS", 7)
    got = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(3)).collect()
    key = lambda g: tuple(str(v) for v in g)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert all(g.taken <= 2 * g.size for g in got)
    for s in ("a", "b", None):
        mine = [g for g in got if g.source == s]
        size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows if r[3] == s)
        assert {g.source_size for g in mine} == {size} and abs(sum(g.taken for g in mine) - mine[0].target) <= 16
    text = mixing.materialise(docs.where("doc_id between 2 and 39"))
    laid = mixing.taken(docs.where("doc_id between 2 and 39")).groupBy().sum("taken").first()[0]
    assert sum(len(r.text.split()) for r in text.collect()) == laid


def test_mixed_is_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    r = random.Random(12)
    rows = [(i if i % 9 else None, "\n ".join(r.choices(WORDS, k=r.randint(1, 30))), ["hot", "a", None][i % 3], i) for i in range(90)]
    rows += [(200, "", "hot", 1), (None, None, "a", 2), (5, "another text of doc five", rows[5][2], 3), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")
    got = mixing.mixed(docs).collect()
    decided = mixing.taken(docs).collect()
    assert Counter((g.doc_id, g.source, g.size, g.taken) for g in decided if not g.taken) == Counter((g.doc_id, g.source, g.size, g.taken) for g in got if g.text is None)
    assert Counter(g.slot for g in got if not g.taken) <= Counter(r[3] for r in rows) and got[0].__fields__[:4] == docs.columns
    assert any(g.size and not g.taken for g in decided) and all((g.mix_slot is None) == (g.text is None) == (g.shard is None) for g in got)
    assert len({g.mix_slot for g in got if g.source == "hot" and g.mix_slot is not None}) == max(g.mix_slot for g in got if g.source == "hot" and g.mix_slot is not None) + 1
    words, streams = Counter(), {}
    for g in got:
        if g.text is not None:
            assert any(d == g.doc_id and s == g.source and g.text.split(" ") == t.split()[g.start : g.start + len(g.text.split(" "))] for d, t, s, _ in rows if t)
            words[g.source] += len(g.text.split())
            streams.setdefault((g.source, g.mix_slot), []).append((g.first + g.start, len(g.text.split())))
    for s in ("hot", "a", None):
        mine = [g for g in decided if g.source == s]
        assert words[s] == sum(g.taken for g in mine) and abs(words[s] - mine[0].target) <= 16
    for parts in streams.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 8 and parts[0][0] % 8 == 0


def test_mixing_broadcasts_no_slots(docs):
    # slots grow with the input: the plan must shuffle them whatever size Spark takes them to have
    out = mixing.mix(docs)[2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_mixing_draws_every_stratum_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 10)
    monkeypatch.setattr(mixing, "STRATUM", 64)
    sources = spark.createDataFrame([(0, 700, 500), (1, 3, 2), (2, 0, 0), (3, 90, 45)], "sid int, quota bigint, blocks bigint")
    got = mixing.slots(sources).collect()
    assert len(got) == 793
    for sid, quota, blocks in ((0, 700, 500), (1, 3, 2), (3, 90, 45)):
        mine = sorted(((g.slot, g.block) for g in got if g.sid == sid))
        assert [s for s, _ in mine] == list(range(quota)) and sorted(b for _, b in mine[:blocks]) == list(range(min(blocks, quota)))
        assert max(Counter(b for _, b in mine).values()) <= -(-quota // blocks)
    assert max(Counter(g.shard for g in got).values()) <= 10 and len({g.shard for g in got}) >= 80
    share = [sum(g.sid == 3 for g in got if g.shard == k) for k in {g.shard for g in got}]
    assert 0 < np.var(share) < 3


def test_mixed_rows_of_one_id_keep_their_own_columns(spark):
    rows = [(1, "a b c " * 50, "s", "first"), (1, "d e f " * 90, "s", "second"), (1, "a b c " * 50, "s", "third"), (None, "g h " * 10, "s", None), (None, "i j " * 20, "s", "x"), (None, "i j " * 20, "s", "x"), (7, None, None, "y")]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")).collect()
    plans = {}
    for g in got:
        plans.setdefault((g.doc_id, g.size, g.mix_size, g.first, g.taken), 0)
    assert Counter((i, z, n) for i, z, n, _, _ in plans) == Counter((r[0], r[3], len((r[1] or "").split())) for r in rows)
    assert mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string").limit(0)).count() == 0


def test_pipeline_gives_the_mix(spark, data):
    import corpus_pipeline as cp

    out = cp.run(spark, data).collect()
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        laid = sum(len(r.text.split()) for r in mine if r.text is not None)
        assert laid == sum({r.doc_id: r.taken for r in mine}.values()) and abs(laid - mine[0].target) <= 2 * mixing.BLOCK
    assert all(r.text is None for r in out if not r.taken)


def test_mixing_of_nothing(empty):
    assert mixing.taken(empty).count() == 0


def test_edit_embedding(docs, rows, empty):
    got = edit_embed.compare(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t = r[1] or ""
        k = len(t) // 4
        want.append((str(r[0]), len(t), hashlib.sha256((t[: len(t) - k] + (nxt[1] or "")[:k]).encode()).hexdigest()))
    assert sorted((str(g.doc_id), g.n_chars, g.edited_sha256) for g in got) == sorted(want)
    by = {g.doc_id: g for g in got}
    assert by[0].fingerprint == by[40].fingerprint and by[41].fingerprint == by[42].fingerprint
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert edit_embed.compare(empty).count() == 0


def test_edit_embedding_tells_distance():
    r = random.Random(8)
    base = "".join(r.choices("abcdefgh  ", k=3000))
    few = "".join(c if r.random() > 0.01 else r.choice(["", "xy"]) for c in base)
    many = "".join(c if r.random() > 0.3 else r.choice(["", "xy"]) for c in base)
    other = "".join(r.choices("abcdefgh  ", k=3000))
    f = edit_embed.embed([base, few, many, other])
    a, b, c = (float(edit_embed.likeness(f[:1], f[i : i + 1])[0]) for i in (1, 2, 3))
    assert a > 0.5 > b and a > b and c < 0.35


@pytest.mark.parametrize("least", [0.97, 0.9, 0.8])
def test_edit_bands_find_near_pairs(spark, least):
    r = random.Random(2)
    texts = []
    for _ in range(50):
        base = "".join(r.choices("abcdefgh  ", k=2500))
        texts += ["".join(c if r.random() > rate else r.choice(["", "xy"]) for c in base) for rate in (0, 0.0005, 0.001, 0.002, 0.004, 0.01)]
    f = np.unique(edit_embed.embed(texts), axis=0)
    alike = {(i, j): x for i in range(len(f)) for j, x in enumerate(edit_embed.likeness(f[i : i + 1], f)) if j < i and x >= least}
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(f)], "id bigint, fp binary")
    links = edit_embed.near_links(df, len(f), least).collect()
    assert len(alike) > 40 and all((max(x.u, x.v), min(x.u, x.v)) in alike for x in links)
    got, want = groups([(x.u, x.v) for x in links], range(len(f))), groups(list(alike), range(len(f)))
    assert sum(got[i] == got[j] for i, j in alike) >= 0.9 * len(alike)
    assert all(want[i] == want[j] for i in range(len(f)) for j in range(i) if got[i] == got[j])


def test_edit_spanning_pairs_connect_what_all_pairs_do():
    r = np.random.default_rng(5)
    base = r.integers(0, 2, (6, 512))
    fp = np.packbits(np.concatenate([base[k // 20] ^ (r.random(512) < r.choice([0.01, 0.04]))[None, :] for k in range(120)]).astype(np.uint8), axis=1).view(np.uint64)
    for most in (5, 20, 40):
        near = [(i, j) for i in range(120) for j in range(i) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= most]
        assert groups(edit_embed._spanning(fp, most), range(120)) == groups(near, range(120))


def test_edit_groups_of_rows(spark, empty):
    r = random.Random(7)
    base = "".join(r.choices("abcdefgh  ", k=6000))
    rows = [(5, base), (3, base), (9, base[:-2] + "zz"), (None, base), (4, "another text"), (2, None), (7, ""), (None, "x" * 300)]
    got = Counter((g.doc_id, g.near_group) for g in edit_embed.grouped(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter([(5, 3), (3, 3), (9, 3), (None, 3), (4, 4), (2, 2), (7, 2), (None, None)])
    assert edit_embed.grouped(empty).count() == 0


URLS = [("http://A.ORG/x?q", "a.org", "/x", "org/", "allow"), ("https://m.example.org/es/1#t", "m.example.org", "/es/1", "example.org/es/", "block"), ("x://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("x://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"), ("http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"), ("http://borg/", "borg", "/", None, "allow"), ("http://a.org", "a.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow")]


def test_url_rules(spark):
    d = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_tree.judge(d).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_tree.judge(d.limit(0)).count() == 0


def test_url_trees_learn_from_labels(spark):
    bad = [f"http://h.net/bad/{i}" for i in range(60)]
    good = [f"http://h.net/good/{i}" for i in range(60)]
    rules = tuple(("h.net", f"/bad/{i}", "block") for i in range(30, 60)) + tuple(("h.net", f"/good/{i}", "allow") for i in range(30, 60))
    d = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id bigint, url string")
    got = {r.page_id: r for r in url_tree.judge(d, rules).collect()}
    assert got[1].template == "/bad/*/" and got[1].verdict == "block" and got[61].verdict == "allow"


def test_url_siblings_merge_and_match_sql(spark, data, tmp_path):
    import duckdb

    from folio.llm import queries

    r = random.Random(3)
    parts = {"bad": 1.0, "worse": 0.97, "mixed": 0.5, "fine": 0.02, "unseen": None}
    urls, rules = [], []
    for i in range(1500):
        name = r.choice(list(parts))
        host = r.choice(["a.net", "b.net", "b.net", "b.net"])
        path = f"/{name}/{i}" + r.choice(["", "/x", "/x/y/z/w", "/" + "long" * 500])
        urls.append(f"http://{host}{path}")
        if parts[name] is not None and i % 3:
            rules.append((host, f"/{name}/{i}", "block" if r.random() < parts[name] else "allow"))
    urls += [urls[0]] * 20 + [None, "no scheme", "://", "http://c.net"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {x.page_id: x for x in url_tree.judge(d, tuple(rules[:40])).collect()}
    assert len(got) == len(urls)
    # merged siblings share one rate; unlike ones don't
    p = url_tree.parsed(d).withColumn("r", url_tree.by_rule(tuple(rules[:300])))
    from pyspark.sql import functions as F
    u = p.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("r.verdict").alias("seen"), F.count_if(F.col("r.verdict") == "block").alias("blocked"))
    rate = {(x.host, x.node): x.rate for x in url_tree.rates(url_tree.templates(u)).collect()}
    assert rate["b.net", "/bad/"] == rate["b.net", "/worse/"] > rate["b.net", "/mixed/"] > rate["b.net", "/fine/"]
    assert min(rate["b.net", "/fine/"], rate["b.net", "/bad/"]) < rate["b.net", "/unseen/"] < rate["b.net", "/bad/"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{data}/pages.parquet')")
    want = con.execute(queries.oracle_sql()["op10_url_filters"]).fetchall()
    assert Counter(want) == Counter(tuple(x) for x in queries.op10_url_filters(spark, data).collect())


def test_url_rates_of_many_labels_match_sql(spark, monkeypatch, tmp_path):
    import duckdb

    from folio.llm import queries

    r = random.Random(4)
    rules = tuple(("h.net", f"/{a}/{b}", "block" if r.random() < p else "allow") for a, p in (("a", 0.95), ("b", 0.9), ("c", 0.4), ("d", 0.1)) for b in range(10, 40))
    monkeypatch.setattr(url_tree, "RULES", rules)
    urls = [f"http://{r.choice(['h.net', 'm.h.net'])}/{r.choice('abcde')}/{r.randrange(100)}{r.choice(['', '/', '/q/r/s'])}" for _ in range(900)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    con = duckdb.connect()
    con.register("pages", d.toPandas())
    want = con.execute(queries.oracle_sql()["op10_url_filters"]).fetchall()
    got = [tuple(x) for x in url_tree.judge(d, rules).drop("template").collect()]
    assert Counter(want) == Counter(got) and {v[4] for v in got if v[3] is None} == {"allow", "block"}


@pytest.fixture(scope="module")
def odd_table(spark, tmp_path_factory):
    """A folder of tables with null and repeated ids, empty, null and long texts, repeated rows, and columns with clashing names."""
    d = str(tmp_path_factory.mktemp("odd"))
    r = random.Random(31)
    good = lambda: " ".join(r.choices(WORDS, k=60)) + "."
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(i, good(), "en", ["a", "b", None][i % 3], 1, "k", 1.0) for i in range(60)]
    rows += [(None, good(), "en", "a", 1, "x", 0.5), (None, good(), None, "a", 1, "y", 0.5), (None, good(), "en", None, 1, "z", 0.5)]
    rows += [(5, good(), "en", "b", 1, "other text of five", 0.1), rows[7], (8, rows[8][1], "en", "b", 2, "same text, other columns", 0.2)]
    rows += [(100, item + " " + item, "en", "a", 1, "bad", 0.3), (None, item.upper(), "en", "a", 1, "bad", 0.3), (6, item, "en", "a", 1, "bad", 0.3)]
    rows += [(101, None, None, None, None, None, None), (102, "", "en", "a", 0, "", 0.0), (103, "1234 !!", "en", "a", 7, "digits", 0.0), (104, (good() + "\n") * 900, "en", "b", 1, "long", 0.9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, items string, score double").withColumnRenamed("score", "size")
    labels = spark.createDataFrame([(i, 1, 0, "t") for i in range(60)] + [(None, 0, 1, "t"), (3, 1, 0, "t"), (4, None, None, "t")], "doc_id bigint, quality int, toxic int, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (None, None), (2, "")], "item_id bigint, text string")
    for name, t in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        t.coalesce(2).write.parquet(f"{d}/{name}.parquet")
        t.limit(0).write.parquet(f"{d}/empty/{name}.parquet")
    return d, rows


def test_stages_judge_each_row(spark, odd_table):
    import corpus_pipeline as cp

    d, rows = odd_table
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {name: f(spark, docs, d) for name, f in cp.STAGES}
    assert all(out[n].columns == docs.columns for n, _ in cp.STAGES[:-1])
    got = {n: Counter(tuple(x) for x in out[n].collect()) for n, _ in cp.STAGES[:-1]}
    whole = Counter(rows)
    assert got["quality"] == whole  # one grade among the labels: nothing is rejected
    assert got["language"] == Counter(x for x in rows if any(map(str.isalpha, x[1] or "")))
    bad = {x for x in rows if x[5] == "bad"}
    assert got["decontamination"] == Counter(x for x in rows if x not in bad)
    fp = [brute_fingerprint(x[1]) for x in rows]
    g = groups([(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3], range(len(fp)))
    kept = got["near_dedup"]
    assert sum(kept.values()) == len(set(g.values())) and kept <= whole
    for root in set(g.values()):
        members = [rows[i] for i in g if g[i] == root]
        mine = [x for x in kept if x in members]
        assert len(mine) == 1 and mine[0][0] == min((m[0] for m in members if m[0] is not None), default=None)
    mix = out["mixing"].collect()
    assert [c for c in out["mixing"].columns[:7]] == docs.columns and "mix_size" in out["mixing"].columns
    plans = Counter((x.doc_id, x.items, x.mix_size, x.first, x.taken) for x in mix)
    assert Counter((i, c, n) for i, c, n, _, _ in plans) == Counter((x[0], x[5], len((x[1] or "").split())) for x in rows)


def test_stages_and_pipeline_of_nothing(spark, odd_table):
    import corpus_pipeline as cp

    d, _ = odd_table
    docs = spark.read.parquet(f"{d}/empty/documents.parquet")
    assert all(f(spark, docs, f"{d}/empty").count() == 0 for _, f in cp.STAGES) and cp.run(spark, f"{d}/empty").count() == 0


def test_pipeline_of_odd_rows(spark, odd_table):
    import corpus_pipeline as cp

    d, rows = odd_table
    out = cp.run(spark, d).collect()
    left = [x for x in rows if any(map(str.isalpha, x[1] or "")) and x[5] != "bad"]
    assert {x.items for x in out} <= {x[5] for x in left} and {"x", "y", "z", "other text of five", "long"} <= {x.items for x in out}


def test_classifiers_of_odd_rows(spark, odd_table):
    d, rows = odd_table
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    graded = labels.where("doc_id < 60").selectExpr("doc_id", "int(doc_id % 3) as quality", "int(doc_id % 4 = 0) as toxic", "text")
    for got in (langid.identify(docs), quality.graded(docs, graded), toxicity.toxicity(docs, graded)):
        assert Counter(x.doc_id for x in got.collect()) == Counter(x[0] for x in rows)
    told = {}
    for x in langid.identify(docs).collect():
        told.setdefault(x.doc_id, []).append((x.lang_pred, x.score))
    assert told[7][0] == told[7][1] and told[101] == told[102] == told[103] == [("und", 0.0)] and told[104][0][0] == "en"


def brute_fit_scores(text, idf, lower):
    """TF-IDF of hashed n-grams in dictionaries: what ngrams.row gives."""
    code = [ord(c) for c in text]
    if lower:
        code = [ord(chr(c).lower()) if c < 0x10000 and len(chr(c).lower()) == 1 else c for c in code]  # as they are beyond the first plane
    p = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
    m = (1 << 32) - 1
    c = Counter()
    for i in range(len(code)):
        a = code[i] * p[0] & m
        c[(a + 1) * p[1] & m] += 1
        if i + 1 < len(code):
            b = code[i + 1] * p[1] & m
            b ^= b >> 15
            c[((a ^ b) + 2) * p[1] & m] += 1
            if i + 2 < len(code):
                e = code[i + 2] * p[2] & m
                e ^= e >> 13
                c[((a ^ b ^ e) + 3) * p[1] & m] += 1
    slots = Counter()
    for h, n in c.items():
        slots[h >> (32 - ngrams.BITS)] += n
    v = {k: math.log1p(n) * idf[k] for k, n in slots.items()}
    size = math.sqrt(sum(x * x for x in v.values())) or 1
    return {k: x / size for k, x in v.items()}


def test_rows_of_ngrams_match_brute_force():
    idf = np.random.default_rng(1).uniform(1, 3, ngrams.SIZE).astype(np.float32)
    for text in ("", "a", "Grüße ÀÉ 😀 zz", "the cat sat on the mat " * 40):
        for lower in (True, False):
            at, v = ngrams.row(text, idf, lower)
            assert dict(zip(at.tolist(), v.tolist())) == pytest.approx(brute_fit_scores(text, idf, lower), rel=1e-4)


def test_ftrl_matches_a_plain_loop():
    r = np.random.default_rng(4)
    rows = [(int(r.integers(0, 3)), np.sort(r.choice(12, 4, replace=False)), r.random(4).astype(np.float32)) for _ in range(30)]
    w, b = langid.ftrl(rows, 3, 12, epochs=2, seed=1)
    z, n = np.zeros((3, 13)), np.zeros((3, 13))  # place 12: the bias, without the first penalty
    weight = lambda k, j: 0.0 if abs(z[k, j]) <= (langid.L1 if j < 12 else 0) else -(z[k, j] - math.copysign(langid.L1 if j < 12 else 0, z[k, j])) / ((langid.BETA + math.sqrt(n[k, j])) / langid.ALPHA + langid.L2)
    rng = np.random.default_rng(1)
    for _ in range(2):
        for i in rng.permutation(30).tolist():
            y, at, v = rows[i]
            x = [*zip(at.tolist(), v.tolist()), (12, 1.0)]
            s = [sum(weight(k, j) * u for j, u in x) for k in range(3)]
            e = [math.exp(a - max(s)) for a in s]
            step = []
            for k in range(3):
                p = e[k] / sum(e) - (k == y)
                step += [(k, j, p * u, weight(k, j)) for j, u in x]
            for k, j, g, now in step:
                z[k, j] += g - (math.sqrt(n[k, j] + g * g) - math.sqrt(n[k, j])) / langid.ALPHA * now
                n[k, j] += g * g
    assert np.allclose(w, [[weight(k, j) for j in range(12)] for k in range(3)], atol=1e-4) and np.allclose(b, [weight(k, 12) for k in range(3)], atol=1e-4)


def test_pipeline_matches_its_stages(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {r.doc_id: r for r in cp.run(spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet")
    keep = {r.doc_id for r in quality.graded(docs, labels).where("keep").collect()}
    left = docs.where(docs.doc_id.isin(sorted(keep)))
    left = left.where(left.doc_id.isin([r.doc_id for r in langid.identify(left).collect() if r.lang_pred != "und" and r.score >= 0.3]))
    texts = {r.doc_id: r.text for r in left.collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    g = groups([(a, b) for a in fp for b in fp if b < a and (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    texts = {i: texts[i] for i in sorted(set(g.values()))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(list(texts.items()), items) if r[-1]}
    assert set(out) == set(texts) - bad
    assert all(out[i].taken <= 2 * out[i].size and out[i].size == len(texts[i].split()) for i in out)
