"""Benchmark decontamination: an FM-index per shard of training words, searched for the benchmark's windows.

Words outside the benchmark's vocabulary can't be part of a hit, so a shard's index holds only the runs of known words that are
as long as the shortest window. The benchmark is broadcast in blocks of at most BLOCK_WINDOWS windows, as word ids in one array; each
further block is another pass in the same task over the rows, which carry their hits along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from folio.llm.common import pieces, table
from folio.llm.fm_index import FMIndex

WINDOW = 13
#: Words of a shard's texts that are indexed together.
SHARD_WORDS = 3_000_000
#: Windows of benchmark text in one broadcast; windows searched for at once.
BLOCK_WINDOWS, SEARCHED = 1 << 19, 1 << 17
_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_WORD).split()


class Windows:
    """The windows of a block of items, (id, words) each. What is sent is the words' text and ids; the rest is made of it where it is used."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = WINDOW) -> None:
        ids: dict[bytes, int] = {}
        seqs = [np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int32, len(words)) for _, words in items]
        self.width, self.vocabulary = width, b" ".join(ids)
        self.seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
        self.lengths = np.array([len(x) for x in seqs], np.int64)
        self.items = [i for i, _ in items]

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.vocabulary.split(b" "), 1)} if self.vocabulary else {}

    @cached_property
    def by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each length: the distinct windows, and the items of each as a flat array and where each window's begin in it."""
        out = {}
        begin = np.cumsum(self.lengths) - self.lengths
        size = np.minimum(self.lengths, self.width)
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            many = self.lengths[own] - n + 1
            item = np.repeat(own, many)
            start = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            rows = np.ascontiguousarray(self.seq[start[:, None] + np.arange(n)])
            windows, at = np.unique(rows.view(np.dtype((np.void, 4 * n))).ravel(), return_inverse=True)
            pairs = np.unique(at.ravel() * np.int64(len(self.items)) + item)
            first = np.searchsorted(pairs, np.arange(len(windows) + 1) * np.int64(len(self.items)))
            out[n] = windows.view(np.int32).reshape(-1, n), pairs % len(self.items), first
        return out

    @property
    def least(self) -> int:
        return min(self.by_length, default=0)

    def __getstate__(self) -> dict[str, object]:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "by_length")}


def find(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids: word ids of a shard, 0 unknown or a text's end; doc, at: of each its row and word position. -> row, start, length, item."""
    empty = np.zeros(0, np.int64)
    known = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= w.least
    starts, ends = starts[long], ends[long]
    if not len(starts) or not w.least:
        return empty, empty, empty, empty
    size = ends - starts + 1  # and a separator
    base = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(starts - base[:-1], size) + np.arange(base[-1])
    seq = ids[np.minimum(place, len(ids) - 1)]
    seq[base[1:] - 1] = 0
    index = FMIndex(seq, len(w.ids) + 1)
    out = []
    for n, (windows, items, first) in w.by_length.items():
        for part in range(0, len(windows), SEARCHED):
            lo, hi = index.search(windows[part : part + SEARCHED])
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            many = (hi - lo)[hit]
            rows = np.repeat(lo[hit], many) + _within(many)
            pos = place[index.locate(rows)]
            which = np.repeat(hit + part, many)
            share = first[which + 1] - first[which]
            item = items[np.repeat(first[which], share) + _within(share)]
            out.append((np.repeat(doc[pos], share), np.repeat(at[pos], share), np.full(len(item), n), item))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty, empty)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Half-open spans, overlapping or touching ones merged."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return list(zip(start[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])].tolist(), strict=True))


def _pass(windows, text_at: int, first: bool, finish):
    """A mapInArrow function for one block of items. Rows keep their order and columns; behind these come, but for the first block, their hits so far.

    finish(rows, n_words, spans, items) makes the batch to hand on.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = windows.value
        held: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        docs: list[int] = []
        n = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal n
            if not held:
                return
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            doc = np.repeat(np.array(docs, np.int64), lengths)
            begins = np.cumsum(lengths) - lengths
            at = np.arange(len(flat)) - np.repeat(begins, lengths)
            d, s, k, item = find(flat, doc, at, w)
            order = np.argsort(d, kind="stable")
            d, s, k, item = d[order], s[order], k[order], item[order]
            cut = np.searchsorted(d, np.arange(len(docs) + 1))
            row = 0
            for b in held:
                own_spans, own_items, counts = [], [], []
                before = (b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()) if not first else None
                for i in range(b.num_rows):
                    x, y = cut[row], cut[row + 1]
                    sp = merged(s[x:y], s[x:y] + k[x:y]) if y > x else []
                    it = sorted({w.items[j] for j in item[x:y].tolist()})
                    if before:
                        old = before[0][i]
                        if old and sp:
                            both = np.array([[v["start"], v["end"]] for v in old] + [list(v) for v in sp])
                            sp = merged(both[:, 0], both[:, 1])
                        elif old:
                            sp = [(v["start"], v["end"]) for v in old]
                        it = sorted({*it, *before[1][i]})
                    own_spans.append(sp)
                    own_items.append(it)
                    counts.append(int(lengths[row]) - 1)
                    row += 1
                yield finish(b if first else b.select(list(range(b.num_columns - 3))), counts, own_spans, own_items)
            held.clear()
            ids.clear()
            docs.clear()
            n = 0

        get = w.ids.get
        for batch in batches:
            texts = batch.column(text_at).cast(pa.string()).cast(pa.binary())
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                held.append(part)
                for t in texts.slice(a, 256).to_pylist():
                    found = [np.fromiter(map(get, toks := words_of(p), repeat(0)), np.int32, len(toks)) for p in pieces_of_words(t)]
                    ids.append(np.concatenate([*found, [0]]).astype(np.int64))
                    docs.append(len(docs))
                    n += len(ids[-1])
                if n >= SHARD_WORDS:
                    yield from done()
        yield from done()

    return work


def pieces_of_words(text: bytes | None) -> Iterator[bytes]:
    """A text's pieces cut at white space, where no word goes on."""
    return pieces(text or b"")


def _blocks(benchmark: DataFrame, width: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in blocks of at most so many windows, one block on the driver at a time; at least one block, perhaps empty.

    An item of more windows is cut into pieces that share width - 1 words, under one id: each of its windows lies in one piece.
    """
    items = table(benchmark, {"item_id": "string", "text": "string"}).select(F.coalesce("item_id", F.lit("null")).alias("item_id"), "text").where("text is not null")
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in items.toLocalIterator():
        words = words_of(r.text.encode())
        for a in range(0, max(1, len(words) - width + 1), most):
            n = min(most, max(1, len(words) - width + 1 - a))
            if size + n > most:
                yield block
                block, size = [], 0
            block.append((r.item_id, words[a : a + n + width - 1]))
            size += n
    yield block


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, out: StructType, finish) -> DataFrame:
    """docs (with a column text) searched for all blocks of items, one pass a block, the last one ending in finish."""
    text_at = docs.columns.index("text")
    names = [*docs.columns, *_HITS.names]
    carried = StructType([*docs.schema.fields, *_CARRIED.fields])

    def carry(rows: pa.RecordBatch, counts: list, own: list, items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, *_hit_columns(counts, own, items)], names=names)

    waiting, df, first = None, docs, True
    for block in _blocks(benchmark, width, BLOCK_WINDOWS):
        if waiting:
            df, first = df.mapInArrow(_pass(waiting, text_at, first, carry), carried), False
        waiting = docs.sparkSession.sparkContext.broadcast(Windows(block, width))
    return df.mapInArrow(_pass(waiting, text_at, first, finish), out)


def _hit_columns(counts: list[int], own: list[list[tuple[int, int]]], items: list[list[str]]) -> list[pa.Array]:
    flat = np.array([x for sp in own for x in sp], np.int64).reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_HITS.field(1).type.value_type))
    ends = pa.array(np.concatenate([[0], np.cumsum([len(sp) for sp in own])]), pa.int32())
    return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, pairs, type=_HITS.field(1).type), pa.array(items, pa.list_(pa.string()))]


_HITS = pa.schema([("_n_words", pa.int64()), ("_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("_items", pa.list_(pa.string()))])
_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
_CARRIED = StructType([StructField("_n_words", LongType()), StructField("_spans", _SPANS), StructField("_items", ArrayType(StringType()))])


def spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: spans are merged half-open word ranges to remove, items the ids whose windows occur.

    A null text has no words. Item ids are kept as strings; a null id reads "null"; items that repeat an id count once. Repeated rows have
    a row each. Texts and items of any length are searched whole. Other columns fall away. Without docs, no rows; without items, no spans.
    """

    def finish(rows: pa.RecordBatch, counts: list, own: list, items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(0), *_hit_columns(counts, own, items)], names=["doc_id", "n_words", "spans", "items"])

    out = StructType([StructField("doc_id", LongType()), *[StructField(f.name[1:], f.dataType) for f in _CARRIED]])
    return _searched(table(docs, {"doc_id": "bigint", "text": "string"}), benchmark, width, out, finish)


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of every document, and the spans and items that they come from; odd rows and tables as in spans."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("bigint"))
    return (
        spans(docs, benchmark)
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "spans", "items")
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs without the contaminated rows, all columns kept, whatever they are called.

    Each row is judged by its own text, in place: rows that share a doc_id, or have none, go or stay by themselves; repeated rows go
    or stay together. Null, empty and wordless texts stay. Without docs, no rows; without items, or without a column text, all rows.
    """
    if "text" not in docs.columns:
        return docs

    def finish(rows: pa.RecordBatch, counts: list, own: list, items: list) -> pa.RecordBatch:
        hit = [sum(e - s for s, e in sp) for sp in own]
        return rows.filter(pa.array([not (h > 0 and 20 * h >= n) for h, n in zip(hit, counts, strict=True)], pa.bool_()))

    return _searched(docs, benchmark, width, docs.schema, finish)
