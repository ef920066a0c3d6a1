"""Language-model scores by causal self-attention over subword ids, beside a word-unigram baseline over the whole corpus.

One attention model gives every subword of a text, and its end, a probability after the subwords before it, in overlapping windows; the
sum of their logarithms is the text's score. A word is spelt alike wherever it stands, in the first VOCABULARY merges of a public
byte-level BPE. The model's outputs begin as the subwords' frequencies over all learning documents; its weights begin with a first fit
on about WARM bytes of passages and are then fitted, from there, on every passage of every learning document, in shards whose weights
are averaged. The baseline's word counts stay distributed; only COMMON words at most are broadcast, the rest are joined.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import attention as A
from folio.llm.common import as_batch, bytes_column, fold, pieces, sliced, stash, table

FOLDS, HELD_OUT = 5, 1
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Merges of the vocabulary in use; with the end of a text a full code of three digits of 16.
VOCABULARY = 4095
#: Words with counts in one broadcast table, at most.
COMMON = 1 << 16
#: Bytes of a passage, of the first fit and of a shard; the share of the learning documents in all shards: all of them.
SPAN, WARM, SHARD, RATE = 1000, 1_500_000, 1_000_000, 1.0
WIDTH, HIDDEN, STRIDE, BATCH = 24, 48, 8, 192
STEPS, FAST, SLOW = 1500, 2e-2, 3e-3
#: Bytes of text and texts scored together.
TOGETHER, TEXTS = 1_000_000, 2000
#: Weights in one row while they are averaged.
CHUNK = 4096
END = b"\n"  # no word has a line break: the end of a text
_LOG10 = 1 / np.log(10)


def ranks(path: str = TOKENIZER, size: int = VOCABULARY) -> dict[bytes, int]:
    """The first size merges of a vocabulary file; all bytes are among them."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if int(b) < size}


def encoder(vocabulary: dict[bytes, int]):
    """Word -> tokens from 1 on; a leading space marks the word's begin. Very long words go by pieces of 64 characters."""
    import tiktoken

    encode = tiktoken.Encoding("words", pat_str=r"[\s\S]{1,64}", mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
    return lambda word: [i + 1 for i in encode(" " + word.decode("utf-8", "replace"))]


def learns() -> F.Column:
    """Whether a row is learnt from; one without doc_id is."""
    return F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, seen) over the learning documents and over all, the end of each text included; c of a word not learnt is 0."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("seen", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush(learnt: int) -> pa.RecordBatch:
            n = np.fromiter(seen[learnt].values(), np.int64, len(seen[learnt]))
            out = as_batch(schema, word=list(seen[learnt]), c=n * learnt, seen=n)
            seen[learnt].clear()
            return out

        for b in sliced(batches):
            for t, learnt in zip(bytes_column(b), b.column(1).to_pylist(), strict=True):
                for p in pieces(t or b"", 1 << 20):
                    seen[learnt].update(p.lower().split())
                    if len(seen[learnt]) > 100_000:
                        yield flush(learnt)
                seen[learnt][END] += 1
        yield from map(flush, (0, 1))

    return docs.select("text", learns()).mapInArrow(work, "word binary, c bigint, seen bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def speller(vocabulary: dict[bytes, int]):
    """Words -> their tokens, end to end, as encoder gives them one by one; all words are spelt in one call."""
    import tiktoken

    encode = tiktoken.Encoding("words", pat_str=r" [^ ]{1,63}|[^ ]{1,64}", mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
    return lambda words: np.array(encode(" " + b" ".join(words).decode("utf-8", "replace")) if words else [], np.int64) + 1


def begins_word(vocabulary: dict[bytes, int]) -> np.ndarray:
    """Whether a token begins a word: those with a leading space; words have no other."""
    out = np.zeros(max(vocabulary.values()) + 3, bool)
    out[[i + 1 for t, i in vocabulary.items() if t[:1] == b" "]] = True
    return out


class Spelling:
    """Words' tokens, end to end. begins: begins_word of the vocabulary."""

    def __init__(self, words: list[bytes], spell, begins: np.ndarray) -> None:
        self.flat = spell(words)
        self.begin = np.flatnonzero(begins[self.flat])
        self.size = np.diff(np.append(self.begin, len(self.flat)))


def subword_counts(counts: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each token occurs in all learnt words (place 0 is the pad); each distinct word is spelt once."""
    held = counts.sparkSession.sparkContext.broadcast(vocabulary)
    n = max(vocabulary.values()) + 3
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, begins, out = speller(held.value), begins_word(held.value), np.zeros(n)
        for b in sliced(batches, 20_000):
            s = Spelling(b.column(0).to_pylist(), spell, begins)
            out += np.bincount(s.flat, np.repeat(b.column(1).to_numpy(zero_copy_only=False), s.size), n)
        at = np.flatnonzero(out)
        yield as_batch(schema, id=at.astype(np.int32), n=out[at].astype(np.int64))

    out = np.zeros(n)
    for r in counts.select("word", "c").mapInArrow(work, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[r.id] = r.n
    return out


def passages(docs: DataFrame, rate: float, seed: int) -> DataFrame:
    """(u, begins, ends, text) of a share rate of the passages of about SPAN bytes of docs (doc_id, text), drawn by a hash; whole texts are cut up."""
    schema = pa.schema([("u", pa.float64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("text", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), bytes_column(b), strict=True):
                t = t or b""
                k = np.arange(max(1, -(-len(t) // SPAN)), dtype=np.uint64)
                h = (k + np.uint64(zlib.crc32(str((i, seed, len(t))).encode()))) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                u = (h >> np.uint64(11)) / float(1 << 53)
                for j in np.flatnonzero(u < rate).tolist():
                    a, e = (_space(t, x) if x else 0 for x in (j * SPAN, (j + 1) * SPAN))
                    rows.append((u[j], j == 0, e >= len(t), t[a:e].lower()))
            if rows:
                u, first, last, text = zip(*rows, strict=True)
                yield as_batch(schema, u=list(u), begins=list(first), ends=list(last), text=list(text))

    return docs.select("doc_id", "text").mapInArrow(work, "u double, begins boolean, ends boolean, text binary")


def _space(t: bytes, at: int) -> int:
    """The first white space from at on, or at most 2 * SPAN further (inside a very long word)."""
    end = min(len(t), at + 2 * SPAN)
    while at < end and t[at] not in b" \t\n\v\f\r":
        at += 1
    return min(at, end)


def lessons(m: A.Attention, rows: list[tuple[bool, bool, bytes]], spell) -> tuple[np.ndarray, np.ndarray]:
    """Windows and targets of passages (begins, ends, text); what a passage that begins inside a text begins with is no target."""
    end = len(m.digit[0]) - 1
    lines = [np.concatenate([[end] * begins, spell(text.split()), [end] * ends]).astype(np.int64) for begins, ends, text in rows]
    lines = [q for q in lines if len(q) > 1]
    x, y = (np.concatenate([q[part] for q in lines] or [np.zeros(0, np.int64)]) for part in (slice(None, -1), slice(1, None)))
    return A.examples(m, x, np.array([len(q) - 1 for q in lines], np.int64), y)


_WEIGHTS = pa.schema([("k", pa.int32()), ("n", pa.float64()), ("w", pa.list_(pa.float64()))])


def _in_chunks(weights: np.ndarray, n: float) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(weights), CHUNK):
        yield as_batch(_WEIGHTS, k=[k // CHUNK], n=[n], w=[weights[k : k + CHUNK].astype(float)])


def warmed(docs: DataFrame, m: A.Attention, vocabulary: dict[bytes, int], size: float) -> A.Attention:
    """m after its first fit, in one task, on about WARM bytes of passages; size: bytes of all texts."""
    held = docs.sparkSession.sparkContext.broadcast((m, vocabulary))
    steps = STEPS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = held.value
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            win, want = lessons(own, rows, speller(words))
            rng = np.random.default_rng(6)
            if len(win):
                A.fit(own, win, want, (rng.integers(0, len(win), BATCH) for _ in range(steps)), steps, FAST)
            yield from _in_chunks(A.flat(own), 1.0)

    drawn = passages(docs, WARM / max(1.0, size), 1).orderBy("u", "text").limit(int(1.2 * WARM / SPAN)).select("begins", "ends", "text")
    got = drawn.coalesce(1).mapInArrow(learn, "k int, n double, w array<double>").collect()  # as many rows as the model has chunks
    return A.filled(m, np.concatenate([np.array(r.w) for r in sorted(got)])) if got else m


def averaged(docs: DataFrame, m: A.Attention, vocabulary: dict[bytes, int], size: float) -> A.Attention:
    """The mean of the models that each shard of passages makes of m in one pass, weighted by their targets."""
    shards = max(1, round(size * RATE / SHARD))
    held = docs.sparkSession.sparkContext.broadcast((m, vocabulary))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words = held.value
        spell, total, n = speller(words), None, 0.0
        rows: list[tuple[bool, bool, bytes]] = []
        now = None

        def done() -> None:
            nonlocal total, n
            own = start.copy()
            win, want = lessons(own, rows, spell)
            rows.clear()
            if len(win):
                order = np.random.default_rng(now).permutation(len(win))
                steps = -(-len(order) // BATCH)
                A.fit(own, win, want, (order[i::steps] for i in range(steps)), steps, SLOW)
                k = float((want >= 0).sum())
                total, n = k * A.flat(own).astype(float) + (0 if total is None else total), n + k

        for b in batches:
            for shard, begins, ends, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and shard != now:
                    done()
                now = shard
                rows.append((begins, ends, text))
        if rows:
            done()
        if total is not None:
            yield from _in_chunks(total, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by k; one sum is held."""
        now, n, w = None, 0.0, None
        for b in batches:
            for k, m_, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = x.values.to_numpy(zero_copy_only=False)
                if k != now and now is not None:
                    yield as_batch(_WEIGHTS, k=[now], n=[n], w=[w])
                n, w = (n + m_, w + x) if k == now else (m_, x.copy())
                now = k
        if now is not None:
            yield as_batch(_WEIGHTS, k=[now], n=[n], w=[w])

    drawn = passages(docs, RATE, 2).withColumn("shard", F.pmod(F.xxhash64("u", "text"), F.lit(shards))).select("shard", "begins", "ends", "text", "u")
    dealt = drawn.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "u", "text").select("shard", "begins", "ends", "text")
    sums = dealt.mapInArrow(learn, "k int, n double, w array<double>").repartition(F.col("k")).sortWithinPartitions("k", "n").mapInArrow(add, "k int, n double, w array<double>")
    got = sums.orderBy("k").collect()  # as many rows as the model has chunks
    return A.filled(m, np.concatenate([np.array(r.w) / r.n for r in got])) if got else m


@dataclass
class Model:
    ranks: dict[bytes, int]
    attention: A.Attention
    total: int  # words and ends learnt from
    distinct: int
    words: dict[bytes, int]  # common words
    count: np.ndarray


def train(docs: DataFrame, counts: DataFrame, path: str = TOKENIZER) -> Model:
    """counts: word_counts(docs), stored."""
    vocabulary = ranks(path)
    learnt = counts.where(F.col("c") > 0)
    total, distinct, size = learnt.agg(F.sum("c"), F.count("*"), F.sum(F.col("c") * (F.octet_length("word") + 1.0))).first()
    n = subword_counts(learnt.where(F.col("word") != F.lit(END)), vocabulary)
    n[-1] = learnt.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    m = A.Attention.new(n, WIDTH, HIDDEN, STRIDE)
    own = docs.where(learns())
    m = averaged(own, warmed(own, m, vocabulary, size or 0), vocabulary, size or 0)
    return Model(vocabulary, m, int(total or 0), int(distinct or 0), {}, np.zeros(0, np.int64))


def know(m: Model, words: DataFrame) -> None:
    """Gives m the COMMON most frequent of words at most, whole groups of alike counts only. Held-out texts count too, so no other word is hot."""
    words = words.where(F.col("word") != F.lit(END))
    sizes = words.groupBy(F.floor(F.log2("seen") * 4).alias("g")).agg(F.count("*").alias("n"), F.min("seen").alias("seen")).orderBy(F.desc("g")).collect()
    least, room = None, COMMON
    for r in sizes:
        if (room := room - r.n) < 0:
            break
        least = r.seen
    common = sorted(words.where(F.col("seen") >= least).select("word", "c").collect(), key=lambda r: bytes(r.word)) if least is not None else []  # COMMON at most
    m.words = {bytes(r.word): i for i, r in enumerate(common)}
    m.count = np.array([r.c for r in common], np.int64)


def score(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; a null text is empty: its end only.

    A row without doc_id is learnt from. Repeated rows each have their row, alike. Texts of any length are scored whole, in windows; other
    columns, also clashing ones, fall away. Empty docs: no rows. path: the vocabulary file.
    """
    d = table(docs, {"doc_id": "bigint", "text": "string"})
    counts = stash(word_counts(d))
    m = train(d, counts, path)
    know(m, counts)
    return scored(d.withColumn("held_out", ~learns()), m, counts)


def scored(d: DataFrame, m: Model, counts: DataFrame) -> DataFrame:
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.max("c")).first()[0] or 0
    held = d.sparkSession.sparkContext.broadcast(m)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", rare_type)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        spell, begins, scorer, end = speller(m.ranks), begins_word(m.ranks), A.Scorer(m.attention), len(m.attention.digit[0]) - 1
        logs, k = np.log10(m.count + 0.5), len(m.words)
        common = Spelling(list(m.words), spell, begins)
        rid = TaskContext.get().partitionId() << 40
        texts: list[bytes | None] = []
        meta: list[tuple] = []

        def done() -> pa.RecordBatch:
            nonlocal rid
            new: dict[bytes, int] = {}  # this batch's rare words; their ids follow the common ones, and the end's theirs
            parts, n = [], np.zeros(len(texts), np.int64)
            get = m.words.get
            for r, t in enumerate(texts):
                for p in pieces(t or b""):
                    w = p.lower().split()
                    i = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
                    for j in np.flatnonzero(i < 0).tolist():
                        i[j] = k + new.setdefault(w[j], len(new))
                    parts.append(i)
                    n[r] += len(i)
            flat, row = np.concatenate(parts), np.repeat(np.arange(len(n)), n)
            own = Spelling(list(new), spell, begins)
            size = np.concatenate([common.size, own.size, [1]])
            begin = np.concatenate([common.begin, own.begin + len(common.flat), [len(common.flat) + len(own.flat)]])
            tokens = np.concatenate([common.flat, own.flat, [end]])
            last = np.cumsum(n + 1) - 1
            seq = np.full(len(flat) + len(n), k + len(new))
            word = np.ones(len(seq), bool)
            word[last] = False
            seq[word] = flat
            many = size[seq]
            stop = np.cumsum(many)
            y = tokens[np.repeat(begin[seq] - (stop - many), many) + np.arange(stop[-1])]
            x = np.empty_like(y)
            x[1:] = y[:-1]
            first = np.concatenate([[0], stop[last][:-1]])
            x[first] = end
            total = np.add.reduceat(scorer(x, np.diff(np.append(first, len(y))), y).astype(np.float64), first) * _LOG10
            old = flat < k
            ids, at = flat[old], row[old]
            base, known = (np.bincount(at, v[ids], len(n)) for v in (logs, m.count > 0))
            pair, c = np.unique(row[~old] * max(1, len(new)) + flat[~old] - k, return_counts=True)
            r, w = np.divmod(pair, max(1, len(new)))
            rare = pa.StructArray.from_arrays([pa.array(list(new), pa.binary()).take(pa.array(w)), pa.array(c, pa.int64())], fields=list(rare_type.value_type))
            rares = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(n) + 1)), pa.int32()), rare, type=rare_type)
            out = as_batch(schema, rid=rid + np.arange(len(n)), doc_id=[a for a, _ in meta], held_out=[b for _, b in meta], n_tokens=n + 1, known=known.astype(np.int64) + (ends > 0), base=base + np.log10(ends + 0.5), score=total, rare=rares)
            rid += len(n)
            texts.clear()
            meta.clear()
            return out

        size = 0
        for b in sliced(batches):
            for i, t, h in zip(b.column(0).to_pylist(), bytes_column(b), b.column(2).to_pylist(), strict=True):
                texts.append(t)
                meta.append((i, h))
                size += len(t or b"")
                if size > TOGETHER or len(texts) >= TEXTS:
                    yield done()
                    size = 0
        if texts:
            yield done()

    kind = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, rare array<struct<word:binary,n:bigint>>"
    rows = stash(d.select("doc_id", "text", "held_out").mapInArrow(work, kind))
    rare = rows.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n")
    rare = rare.join(counts.select("word", "c"), "word", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
    )
    log_n = float(np.log10(m.total + 0.5 * (m.distinct + 1)))
    return rows.drop("rare").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(m.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * log_n).alias("base_score"), "score",
    )
