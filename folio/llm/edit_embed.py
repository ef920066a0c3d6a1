"""Document fingerprints by randomised edit embedding.

A text is cut where its content says so (a hash of six code points, at least LEAST and at most MOST code points apart), so an
edit moves no distant cut. Every segment is walked by the same random walk: at step j the symbol at the walk's place is put out,
and whether the walk moves on is a random bit of (j, symbol). Segments at a small edit distance fall into step again, so their
outputs differ at few steps: edit distance becomes Hamming distance. A segment's output is folded into BITS signed sums, times a
sign pattern that its anchor (the content at its cut) picks; their sum over the text has the fingerprint as its signs. The share
of equal bits tells the share of equal steps. Segments, not texts, are walked together, so a long text costs as its length does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import as_batch, stash, table
from folio.llm.components import components

BITS, LANES = 512, 8
GROUPS = BITS // LANES
PERIOD, SEED = 4096, 9176
#: Code points and texts walked together; rows of one range of ids.
BATCH_CHARS, BATCH_TEXTS, RANGE_ROWS = 6_000_000, 8192, 6000
#: Likeness at which the query links documents; share of such pairs that the bands find.
LEAST_LIKENESS, RECALL = 0.97, 0.95
#: Segment lengths in code points, one cut in EVERY of them on average; segments walked together; patterns to pick from.
LEAST, EVERY, MOST, TOGETHER, PATTERNS = 64, 192, 1024, 8192, 4096
_tables: tuple[np.ndarray, ...] | None = None


def tables() -> tuple[np.ndarray, ...]:
    """Moves (step x symbol), signs (step x symbol x lane), group of each step, sign patterns; symbol 0 ends a segment: no move, no sign."""
    global _tables
    if _tables is None:
        rng = np.random.default_rng(SEED)
        move = rng.integers(0, 2, (PERIOD, 256), np.int32)
        sign = (rng.integers(0, 60, (PERIOD, 256, LANES), np.int16) * 2 + 1) * (rng.integers(0, 2, (PERIOD, 256, LANES), np.int16) * 2 - 1)
        move[:, 0] = 0
        sign[:, 0] = 0
        _tables = move, sign, rng.integers(0, GROUPS, 1 << 16), rng.integers(0, 2, (PATTERNS, BITS), np.int8) * 2 - 1
    return _tables


def symbols(text: str) -> np.ndarray:
    """Code points as 1..255: ASCII as it is, others by a hash."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(c < 128, np.where(c == 0, 127, c), 128 + (c * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(127)).astype(np.uint8)


def cuts(seq: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the segments of a symbol sequence begin, and the pattern that each one's anchor picks."""
    n = len(seq)
    if n == 0:
        return [], []
    begin, anchor = [0], [0]
    if n > LEAST:
        c = seq.astype(np.uint32)
        h = np.zeros(n - 5, np.uint32)
        for k in range(6):
            h = h * np.uint32(0x01000193) ^ c[k : n - 5 + k]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        for at in np.flatnonzero(h % np.uint32(EVERY) == 0).tolist():
            if at - begin[-1] >= LEAST:
                while at - begin[-1] > MOST:
                    begin.append(begin[-1] + MOST)
                    anchor.append(1 + len(begin) % 7)
                begin.append(at)
                anchor.append(int(h[at]) // EVERY % PATTERNS)
        while n - begin[-1] > MOST:
            begin.append(begin[-1] + MOST)
            anchor.append(1 + len(begin) % 7)
    return begin, anchor


def walked(segments: list[bytes]) -> np.ndarray:
    """The signed sums (segments x BITS) of each segment's walk."""
    move, sign, group, _ = tables()
    out = np.zeros((len(segments), BITS), np.int16)
    order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
    for k in range(0, len(order), TOGETHER):
        rows = np.array(order[k : k + TOGETHER])
        size = np.array([len(segments[i]) for i in rows.tolist()], np.int64)
        flat = np.frombuffer(b"\0".join([segments[i] for i in rows.tolist()]) + b"\0", np.uint8)
        at = (np.cumsum(size + 1) - size - 1).astype(np.int32)
        sums = np.zeros((GROUPS, len(rows), LANES), np.int16)
        n, step = len(rows), 0
        while n:  # longest first: the first n still walk, and whoever among them has ended stands on a 0
            c, r, s, now = np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros((n, LANES), np.int16), at[:n]
            for _ in range(64):
                j = step % PERIOD
                np.take(flat, now, out=c, mode="clip")
                np.take(move[j], c, out=r, mode="clip")
                np.take(sign[j], c, axis=0, out=s, mode="clip")
                now += r
                sums[group[step & 0xFFFF], :n] += s
                step += 1
            live = np.flatnonzero(flat[now])
            n = int(live[-1]) + 1 if len(live) else 0
        out[rows] = sums.transpose(1, 0, 2).reshape(len(rows), BITS)
    return out


def embed(texts: list[str]) -> np.ndarray:
    """Fingerprints, a row of BITS / 8 bytes per text. Segments that texts share are walked once."""
    known: dict[bytes, int] = {}
    seg, pat, size = [], [], []
    for t in texts:
        q = symbols(t)
        begin, anchor = cuts(q)
        raw = q.tobytes()
        seg += [known.setdefault(raw[a:b], len(known)) for a, b in zip(begin, begin[1:] + [len(q)][: len(begin)], strict=True)]
        pat += anchor
        size.append(len(begin))
    one = walked(list(known))
    signs = tables()[3]
    sums, at = np.zeros((len(texts), BITS), np.int64), 0
    for i, n in enumerate(size):
        for k in range(at, at + n, 4096):
            end = min(at + n, k + 4096)
            sums[i] += np.einsum("ij,ij->j", one[seg[k:end]], signs[pat[k:end]], dtype=np.int64)
        at += n
    bits = sums > 0
    for row in np.flatnonzero((sums == 0).any(1)).tolist():  # sums that nothing reached: bits of the text's own hash
        own = np.unpackbits(np.frombuffer(hashlib.shake_128(texts[row].encode("utf-8", "replace")).digest(BITS // 8), np.uint8)).astype(bool)
        bits[row] = np.where(sums[row] == 0, own, bits[row])
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal steps that the equal bits of two fingerprints (rows of bytes) tell: 0 for half of them, 1 for all."""
    same = 1 - np.bitwise_count(a ^ b).sum(1) / BITS
    return np.clip(np.cos(np.pi * (1 - same)), 0, 1)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many, or all, of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame) -> DataFrame:
    """(pid, ghost, doc_id, text): ranges of doc_id, null first, each followed by ghosts: copies of the next range's first document.

    The last range's ghost is the first document of all.
    """
    d = table(docs, {"doc_id": "bigint", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    n = d.count()
    parts = max(1, min(100_000, -(-n // RANGE_ROWS)))
    edges = sorted(set(d.approxQuantile("doc_id", [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts)))) if parts > 1 else []
    edge = np.array(edges, float)

    def place(ids) -> np.ndarray:
        return np.searchsorted(edge, np.array([-np.inf if x is None else x for x in ids], float), side="right")

    low = pa.schema([("pid", pa.int32()), ("doc_id", pa.int64())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            yield as_batch(low, pid=place(ids.to_pylist()).astype(np.int32), doc_id=ids)

    firsts = sorted(d.select("doc_id").mapInArrow(least, "pid int, doc_id bigint").groupBy("pid").agg(F.min("doc_id").alias("m"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    # a range's first document goes after the range before it, the first range's after the last
    before = {(None if r.nulls else r.m): firsts[i - 1].pid for i, r in enumerate(firsts)}
    schema = pa.schema([("pid", pa.int32()), ("ghost", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(place(ids).astype(np.int32)), pa.array(np.zeros(len(ids), bool)), b.column(0), b.column(1)], schema=schema)
            if (at := [i for i, x in enumerate(ids) if x in before]):
                yield as_batch(schema, pid=[before[ids[i]] for i in at], ghost=[True] * len(at), doc_id=[ids[i] for i in at], text=b.column(1).take(pa.array(at)))

    return d.mapInArrow(spread, "pid int, ghost boolean, doc_id bigint, text string").repartition(parts, "pid").sortWithinPartitions("pid", "ghost", F.asc_nulls_first("doc_id"), "text")


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A null text counts as empty. Equal doc_ids go by text; a lone document is its own next. Texts of any length are embedded whole; other
    columns, also clashing ones, fall away. Empty docs: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def done(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        ids, own, nxt = zip(*rows, strict=True)
        ed = [edited(a, b) for a, b in zip(own, nxt, strict=True)]
        all_texts = list(dict.fromkeys([*own, *ed, *nxt]))  # most next texts are a neighbour's own
        at = {t: i for i, t in enumerate(all_texts)}
        fp = embed(all_texts)
        a, e, x = (fp[[at[t] for t in ts]] for ts in (own, ed, nxt))
        return as_batch(
            schema, doc_id=list(ids), n_chars=[len(t) for t in own], edited_sha256=[hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in ed],
            fingerprint=[r.tobytes().hex() for r in a], edited_fingerprint=[r.tobytes().hex() for r in e], near_edited=likeness(a, e), near_next=likeness(a, x),
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str, str]] = []
        chars, last = 0, None
        for b in batches:
            for pid, ghost, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last and last[0] == pid:
                    rows.append((last[1], last[2], t))
                    chars += 2 * len(last[2])
                    if chars >= BATCH_CHARS or len(rows) >= BATCH_TEXTS:
                        yield done(rows)
                        rows, chars = [], 0
                last = None if ghost else (pid, i, t)
        if rows:
            yield done(rows)

    kinds = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(work, kinds)


def band_plan(n: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band, and how many bands find two of n fingerprints at likeness least with probability recall."""
    bits = min(48, int(np.ceil(np.log2(max(2, n)))) + 3)
    same = 1 - np.arccos(least) / np.pi
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - same**bits)))


def bands(fingerprint: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Band keys (texts x count): each of bits sampled at random from the fingerprint, and of the band's number."""
    rng, out, all_bits = np.random.default_rng(SEED + 1), np.empty((len(fingerprint), count), np.int64), np.unpackbits(fingerprint, axis=1)
    for k in range(count):
        key = all_bits[:, rng.choice(BITS, bits, replace=False)].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
        out[:, k] = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((k + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))).view(np.int64)
    return out


def _spanning(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of rows (8 words of 64 bits) at most so many bits apart that connect whatever such pairs connect: a row joins by the first row that reaches it."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[a]).sum(1) <= most
            out += [(a, b) for b in left[near].tolist()]
            queue += left[near].tolist()
            left = left[~near]
    return out


def near_links(prints: DataFrame, n: int, least: float = LEAST_LIKENESS) -> DataFrame:
    """(u, v, likeness): verified links between prints (id, fp: 64 bytes), as many as connect all that share a band and are alike enough.

    Every member of a band's bucket is compared with all others that no link has reached yet, so a bucket of near copies costs what
    one comparison each does, and gives one link each; none is left out. n: how many there are.
    """
    bits, count = band_plan(n, least)
    most = int(np.floor(BITS * np.arccos(least) / np.pi + 1e-9))
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])
    linked = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("likeness", pa.float64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                k = bands(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8), bits, count)
                yield as_batch(schema, key=k.ravel(), id=np.repeat(b.column(0).to_numpy(zero_copy_only=False), count))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; one bucket is held."""
        ids: list[int] = []
        prints: list[bytes] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                raw = b"".join(prints)
                pairs = _spanning(np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64), most)
                if pairs:
                    a, b = np.array(pairs).T
                    eight = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
                    yield as_batch(linked, u=np.array(ids)[a], v=np.array(ids)[b], likeness=likeness(eight[a], eight[b]))

        for batch in batches:
            for k, i, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    yield from done()
                    ids, prints, now = [], [], k
                ids.append(i)
                prints.append(f)
        yield from done()

    rows = prints.select("id", "fp").mapInArrow(keyed, "key bigint, id bigint")
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "id")
    held = shared.join(prints.select("id", "fp"), "id").select("key", "id", "fp").repartition("key").sortWithinPartitions("key", "id")
    return held.mapInArrow(meet, "u bigint, v bigint, likeness double")


def grouped(docs: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """compare's rows with near_group, the smallest doc_id that links between fingerprints at likeness least reach (its own if none does).

    Equal fingerprints are linked, so empty texts form a group. A group without any doc_id has a null one. Odd rows as in compare.
    """
    marked = stash(compare(docs).withColumn("_id", F.xxhash64("fingerprint")))
    own = stash(marked.groupBy("_id").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"), F.first(F.unhex("fingerprint")).alias("fp")))
    roots = components(near_links(own.select(F.col("_id").alias("id"), "fp"), own.count(), least).select("u", "v"))
    of = own.join(roots, F.col("_id") == F.col("u"), "left").select("_id", "smallest", "n", F.coalesce("v", "_id").alias("root"))
    groups = of.groupBy("root").agg(F.min("smallest").alias("near_group"), F.sum("n").alias("rows")).where("rows > 1")
    member = of.join(groups, "root").select("_id", "near_group", F.lit(True).alias("in_group"))
    return marked.join(member, "_id", "left").withColumn("near_group", F.when(F.col("in_group"), F.col("near_group")).otherwise(F.col("doc_id"))).drop("_id", "in_group")
