"""Phrase collocations by pivot partitioning.

Each n-gram belongs to the rarest of its words, its pivot. A task rewrites texts to fragments: a pivot with the words beside it that are
more frequent than it, up to the phrase's length; a rarer word ends the fragment, since phrases with it belong to that word. Equal
fragments are counted together and shuffled to their pivot, all of a pivot's in one row of a task; there the n-grams that hold the pivot
are mined, a few pivots at a time. Each occurrence of an n-gram is mined from its leftmost pivot, so it is counted once.

Rarity is read from a table of 2^BITS hashed counts, the only thing that is broadcast: 8 MB at any corpus. A bucket's count is never below
a word's own, so a word left out by it is too rare for sure; words that share a bucket only change where an n-gram is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import csv
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import as_batch, sliced, stash, table

LEAST, TOP, SUBSUMED = 10, 2000, 50
BITS = 20
#: Words that a task rewrites at once; it joins texts of four times as many bytes before.
WORDS = 1 << 19
#: A pivot is split into parts of about so many occurrences; bytes of fragments that are mined at once, whole parts at least.
PART, BLOCK = 1 << 20, 1 << 23
#: Parts in which a language's phrases are ranked before all are.
PARTS = 64
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\n\v\f\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Up to WORDS words of joined texts, and two more on either side for context: codes into the distinct (lang, word) pairs, pieces."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray, row: np.ndarray, lang_of: np.ndarray, langs: list[str], first: int, last: int):
        low, high = max(0, first - 2), min(len(starts), last + 2)
        self.own = slice(first - low, last - low)
        part = raw[starts[low] : ends[high - 1]]
        sizes = ends[low:high] - starts[low:high]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = part[_KIND[part] == 0]
        coded = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        lang = lang_of[row[low:high]].astype(np.int64)
        pairs, self.code = np.unique(coded.indices.to_numpy().astype(np.int64) * len(langs) + lang, return_inverse=True)
        self.word = coded.dictionary.take(pa.array(pairs // len(langs))).cast(pa.string())
        self.lang = pairs % len(langs)
        heads = [x.encode() + b"\0" for x in langs]
        self.hash = np.array([xxhash.xxh64_intdigest(heads[g] + w) for g, w in zip(self.lang.tolist(), self.word.cast(pa.binary()).to_pylist(), strict=True)], np.uint64)
        self.piece = piece[low:high]

    def bucket(self, counts: np.ndarray) -> np.ndarray:
        """Of each pair in a table of counts, whose length is a power of two."""
        return (self.hash >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], list[str]]]:
    texts, langs, held = [], [], 0
    for b in sliced(batches, 100):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            texts.append(text)
            langs.append(lang)
            held += len(text)
            if held >= most:
                yield texts, langs
                texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


def words_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[Words, list[str]]]:
    """Batches of (lang, text), texts whole; a text of any length is taken in several Words."""
    for texts, row_langs in joined(batches, 4 * words):
        langs = sorted(set(row_langs))
        at = {x: i for i, x in enumerate(langs)}
        lang_of = np.array([at[x] for x in row_langs], np.int32)
        raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = _KIND[raw]
        edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        for first in range(0, len(starts), words):
            yield Words(raw, starts, ends, piece, row, lang_of, langs, first, min(len(starts), first + words)), langs


def count_words(texts: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(lang, bucket, n): words of each hashed bucket (lang null), and all words of each lang (bucket null)."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = np.zeros(1 << bits, np.int64), {}
        for w, langs in words_of(batches, words):
            n = np.bincount(w.code[w.own], minlength=len(w.word))
            np.add.at(counts, w.bucket(counts), n)
            for lang, k in zip(langs, np.bincount(w.lang, weights=n, minlength=len(langs)).tolist(), strict=True):
                of[lang] = of.get(lang, 0) + int(k)
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 16):
            b = some[at : at + (1 << 16)]
            yield as_batch(schema, lang=pa.nulls(len(b), pa.string()), bucket=b.astype(np.int32), n=counts[b])
        yield as_batch(schema, lang=list(of), bucket=pa.nulls(len(of), pa.int32()), n=list(of.values()))

    return texts.mapInArrow(work, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fragments_of(w: Words, counts: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes (two words before the pivot, one before, the pivot, one after, two after; -1: none) of distinct fragments by pivot, and their counts."""
    count = counts[w.bucket(counts)]
    order = np.lexsort((w.hash, count))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (np.diff(count[order]) != 0) | (np.diff(w.hash[order]) != 0)]))[: len(order)]
    code, r = np.concatenate([[-1, -1], w.code, [-1, -1]]), np.concatenate([[-1, -1], rank[w.code], [-1, -1]])
    piece = np.concatenate([[-1, -1], w.piece, [-1, -1]])
    i = np.arange(w.own.start, w.own.stop)
    i = i[count[w.code[i]] >= least] + 2
    beside = []
    for step, above in ((-1, 1), (1, 0)):  # words before must be more frequent, so that this is the leftmost pivot
        one = (piece[i + step] == piece[i]) & (r[i + step] >= r[i] + above)
        two = one & (piece[i + 2 * step] == piece[i]) & (r[i + 2 * step] >= r[i] + above)
        beside += [np.where(two, code[i + 2 * step], -1), np.where(one, code[i + step], -1)]
    l2, l1, r2, r1 = beside
    size, p = len(order) + 1, code[i]
    inner, outer = (p * size + l1 + 1) * size + r1 + 1, (l2 + 1) * size + r2 + 1
    by = np.lexsort((outer, inner))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(inner[by]) != 0) | (np.diff(outer[by]) != 0)])) if len(by) else by
    lead = by[new]
    return [x[lead] for x in (l2, l1, p, r1, r2)], np.diff(np.append(new, len(by)))


def fragments(texts: DataFrame, counts: np.ndarray, least: int, words: int = WORDS, size: int = PART) -> DataFrame:
    """(key, lang, p, whole, lines): a pivot's fragments in a task. Lines hold the words before and after (empty: none) and a count, apart by
    tabs, which no word has. key: the pivot's hash, and the part's, if it is split; whole: it isn't."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("p", pa.string()), ("whole", pa.bool_()), ("lines", pa.string())])
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, turn = shared.value, TaskContext.get().partitionId()
        for w, langs in words_of(batches, words):
            codes, n = fragments_of(w, counts, least)
            p = codes[2]
            if not len(p):
                continue
            said = [pc.fill_null(w.word.take(pa.array(c, mask=c < 0)), "") for c in codes[:2] + codes[3:]]
            lines = pc.binary_join_element_wise(*said, pa.array(n).cast(pa.string()), "\t")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(p) != 0]))
            blocks = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(p)).astype(np.int32)), lines), "\n")
            own = p[starts]
            parts = 1 + counts[w.bucket(counts)[own]] // size
            turn += 1
            key = (w.hash[own] + (turn % parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            names = pa.array(langs, pa.string())
            for at in range(0, len(own), 1 << 12):
                cut = slice(at, at + (1 << 12))
                yield as_batch(schema, key=key[cut], lang=names.take(pa.array(w.lang[own[cut]])), p=w.word.take(pa.array(own[cut])), whole=parts[cut] == 1, lines=blocks[cut])

    return texts.mapInArrow(work, "key bigint, lang string, p string, whole boolean, lines string")


def _parsed(lines: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """The four words of each line of all, and the counts."""
    head = b"-\t-\t-\t-\t0\n"  # a byte order mark would be taken off the first line
    raw = pa.BufferReader(head + b"\n".join(lines.cast(pa.binary()).to_pylist()) + b"\n")
    names = ["l2", "l1", "r1", "r2", "n"]
    t = csv.read_csv(
        raw, csv.ReadOptions(column_names=names, use_threads=False, block_size=1 << 26), csv.ParseOptions(delimiter="\t", quote_char=False, double_quote=False, ignore_empty_lines=False),
        csv.ConvertOptions(column_types={x: pa.int64() if x == "n" else pa.string() for x in names}, null_values=[], strings_can_be_null=False),
    ).slice(1)
    return [t.column(x) for x in names[:4]], t.column("n").to_numpy()


def mine(rows: pa.Table, least: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(langs, phrases, counts) of the n-grams that fragments' pivots own; of whole pivots only those of count least or more."""
    pivots = pc.binary_join_element_wise(rows.column("lang"), rows.column("p"), "\t").combine_chunks().dictionary_encode()
    whole = np.zeros(len(pivots.dictionary), bool)
    whole[pivots.indices.to_numpy()] = rows.column("whole").to_numpy()
    words, n = _parsed(rows.column("lines").combine_chunks())
    pivot = np.repeat(pivots.indices.to_numpy().astype(np.int64), pc.add(pc.count_substring(rows.column("lines"), "\n"), 1).to_numpy())
    coded = pa.chunked_array([c for x in words for c in x.chunks]).combine_chunks().dictionary_encode()
    known = coded.dictionary
    empty = pc.index(known, "").as_py()
    codes = coded.indices.to_numpy().astype(np.int64).reshape(4, -1)
    l2, l1, r1, r2 = np.where(codes == empty, -1, codes)
    names = pivots.dictionary.to_pylist()
    size = len(known) + 1
    langs, phrases, counts = [], [], []
    none = np.full(len(n), -1)
    for a, b, order in ((none, none, "{p}"), (l1, none, "{a} {p}"), (none, r1, "{p} {b}"), (l2, l1, "{a} {b} {p}"), (l1, r1, "{a} {p} {b}"), (r1, r2, "{p} {a} {b}")):
        here = ((a >= 0) if "{a}" in order else True) & ((b >= 0) if "{b}" in order else np.ones(len(n), bool))
        gram, at = np.unique((pivot[here] * size + a[here] + 1) * size + b[here] + 1, return_inverse=True)
        f = np.bincount(at, weights=n[here], minlength=len(gram)).astype(np.int64)
        keep = (f >= least) | ~whole[gram // (size * size)]
        gram = gram[keep]
        text = known.take(pa.array(gram // size % size - 1, mask=gram // size % size == 0)).to_pylist(), known.take(pa.array(gram % size - 1, mask=gram % size == 0)).to_pylist()
        for i, x, y in zip((gram // (size * size)).tolist(), *text, strict=True):
            lang, p = names[i].rsplit("\t", 1)
            langs.append(lang)
            phrases.append(order.format(p=p, a=x, b=y))
        counts.append(f[keep])
    return pa.array(langs, pa.string()), pa.array(phrases, pa.string()), np.concatenate(counts)


def mined(frags: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to 3 words with f >= least. A pivot's n-grams are mined where its fragments are; those of a
    pivot in several parts are summed after that, so only whole pivots' rare n-grams fall away before."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            lang, phrase, n = mine(pa.Table.from_batches(held), least)
            held.clear()
            for at in range(0, len(n), 1 << 14):
                yield as_batch(schema, lang=lang[at : at + (1 << 14)], phrase=phrase[at : at + (1 << 14)], n=n[at : at + (1 << 14)])

        size, last = 0, None
        for b in batches:
            key = b.column(0).to_numpy()
            ends = np.cumsum(pc.binary_length(b.column(4)).to_numpy())
            first, before = 0, 0
            for at in np.flatnonzero(np.diff(key, prepend=key[0] if last is None else last)).tolist():  # a key's rows stand together
                gone = int(ends[at - 1]) if at else 0
                if size + gone - before >= block:
                    if at > first:
                        held.append(b.slice(first, at - first))
                    yield from done()
                    first, before, size = at, gone, 0
            held.append(b.slice(first))
            size, last = size + int(ends[-1]) - before, key[-1]
        if held:
            yield from done()

    local = frags.repartition("key").sortWithinPartitions("key").mapInArrow(work, "lang string, phrase string, n bigint")
    return local.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _first(words: Column, k: Column | int) -> Column:
    return F.array_join(F.slice(words, 1, k), " ")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words and more, by the cut of the lowest score, ties to the earliest cut."""
    w = F.split("phrase", " ")
    cut = grams.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), w.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _first(F.col("w"), F.col("k")).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    of = lambda part, name: grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    both = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(1000000 AS DECIMAL(38, 0)) * a * a) div (CAST(l AS DECIMAL(38, 0)) * r)")
    least = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return least.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def maximal(phrases: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """phrases (lang, phrase, a, ...) without those inside a longer one that has at least share percent of their count."""
    w = F.split("phrase", " ")
    inner = F.array(_first(w, 2), F.array_join(F.slice(w, 2, 2), " "))
    above = phrases.where(F.size(w) == 3).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(above, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")


def top(phrases: DataFrame, most: int = TOP) -> DataFrame:
    """The first of each lang, with rank: first among PARTS parts of its phrases, then among what is left, so no task ranks all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    cut = part.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= most).drop("_part", "_rank")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, most: int = TOP, words: int = WORDS, bits: int = BITS, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (text, lang): each language's collocations of two and three words.

    A null text counts as empty and gives no words, a null lang counts as `und`. Every row counts, repeated ones too. Texts of any length
    are mined whole. Ties of score go by count, then by the phrase's bytes. Other columns, also clashing ones, fall away; an empty table,
    and a language without a phrase that is frequent enough, gives no rows.
    """
    texts = table(docs, {"lang": "string", "text": "string"}).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = stash(count_words(texts, words, bits))
    counts = np.zeros(1 << bits, np.int64)
    got = counted.where("bucket IS NOT NULL").select("bucket", "n").toArrow()
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    grams = stash(mined(fragments(texts, counts, least, words, part), least, block))
    first = top(maximal(stash(scored(grams))), most)
    n = counted.where("bucket IS NULL").select("lang", "n")
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
