"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's ball of radius 2 meets another's ball of radius 1 exactly if they differ in 3 bits or fewer. Variants are
shuffled by their leading bits: a fingerprint goes once to each bucket that holds any of its variants, and the bucket's task
makes those variants itself. That sends 37 rows a fingerprint at 8 leading bits, not 2081.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import as_batch, bytes_column, pieces, row_hash, stash, table
from folio.llm.components import components

BITS, RADIUS, SEED = 64, 3, 42
#: Variants made at once in a task; a bucket with more is split by further leading bits.
VARIANTS = 1 << 22
#: Fingerprints that a bucket should hold on average; sets the number of leading bits.
BUCKET = 40_000
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the XXH64 of a text's word shingles, repeats included; 0 without words."""
    counts, n, digest, tail = np.zeros(2048, np.int64), 0, xxhash.xxh64_digest, []
    for piece in pieces(text or b""):
        tokens = tail + piece.lower().split()
        if len(tokens) >= words:
            joined = b" ".join(tokens)
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])
            counts += np.bincount((np.frombuffer(raw, np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048)
            n += len(raw) // 8
        tail = tokens[-(words - 1) :] if words > 1 else []
    if not n:
        if not tail:
            return 0
        raw = digest(b" ".join(tail), SEED)
        return int.from_bytes(raw, "big", signed=True)
    ones = np.einsum("ij,jk->ik", counts.reshape(8, 256), _BIT_TABLE).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, and h, the hash of all its columns, if asked for; a null text has no words, so fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())] + [("h", pa.int64())] * hashed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes | None, int] = {}
            out = []
            for t in bytes_column(batch):
                if t not in known:
                    known[t] = fingerprint(t)
                out.append(known[t])
            yield as_batch(schema, doc_id=batch.column(0), fp=out, **({"h": batch.column(2)} if hashed else {}))

    d = table(docs, {"doc_id": "bigint", "text": "string"}, **({"h": row_hash(docs)} if hashed else {}))
    return d.mapInArrow(work, "doc_id bigint, fp bigint" + ", h bigint" * hashed)


def masks(bits: int, weight: int) -> np.ndarray:
    """All words of that many bits with at most weight ones, lightest first."""
    return np.array([sum(1 << b for b in c) for w in range(weight + 1) for c in combinations(range(bits), w)], np.uint64)


def _stars(balls: list[tuple[np.ndarray, np.ndarray]], bits: int, out: list[np.ndarray], cap: int) -> None:
    """balls[a]: (low bits, fingerprints) that have a flips so far. Adds links (fingerprint, fingerprint) to out."""
    made = [masks_cached(bits, 2 - a) for a in range(3)]
    if sum(len(low) * len(m) for (low, _), m in zip(balls, made, strict=True)) > cap and bits > 6 and sum(len(low) for low, _ in balls) > 1:
        step = 4
        rest = bits - step
        for p in range(1 << step):
            nxt: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]
            for a, (low, fp) in enumerate(balls):
                flips = np.bitwise_count((low >> np.uint64(rest)) ^ np.uint64(p)) + a
                for b in range(a, 3):
                    pick = flips == b
                    nxt[b].append((low[pick] & np.uint64((1 << rest) - 1), fp[pick]))
            _stars([(np.concatenate([x for x, _ in n]), np.concatenate([y for _, y in n])) for n in nxt], rest, out, cap)
        return
    variants = np.concatenate([(low[:, None] ^ m[None, :]).ravel() for (low, _), m in zip(balls, made, strict=True)])
    variants.sort()
    again = variants[1:][variants[1:] == variants[:-1]]
    if not len(again):
        return
    again = again[np.concatenate([[True], again[1:] != again[:-1]])]
    at, who, far = [], [], []
    for a, ((low, fp), m) in enumerate(zip(balls, made, strict=True)):
        if len(low):
            v = (low[:, None] ^ m[None, :]).ravel()
            i = np.minimum(np.searchsorted(again, v), len(again) - 1)
            hit = np.flatnonzero(again[i] == v)
            at.append(i[hit])
            who.append(fp[hit // len(m)])
            far.append(a + np.bitwise_count(m[hit % len(m)]).astype(np.int64))
    at, who, far = np.concatenate(at), np.concatenate(who), np.concatenate(far)
    order = np.lexsort((who, far >= 2, at))
    at, who, far = at[order], who[order], far[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = (far[lead] <= 1) & (who[lead] != who)  # the leader is within 1 of the variant, so within 3 of each owner
    if keep.any():
        out.append(np.unique(np.stack([who[lead][keep], who[keep]], 1), axis=0))


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def masks_cached(bits: int, weight: int) -> np.ndarray:
    if (bits, weight) not in _MASKS:
        _MASKS[bits, weight] = masks(bits, weight)
    return _MASKS[bits, weight]


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of these links: (node, smallest), so no task gives more rows than it has nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for a, b in links.tolist():
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, r) for x in list(up) if (r := root(x)) != x]


def near_links(fps: DataFrame, n: int) -> DataFrame:
    """Links (u, v) that connect the fingerprints exactly as all pairs at 3 bits or fewer would. fps: distinct fp; n: how many."""
    lead = max(8, int(np.ceil(np.log2(max(1, n) / BUCKET))) + 5)
    rest = BITS - lead
    flips = masks(lead, 2)
    sent = pa.schema([("bucket", pa.int64()), ("fp", pa.int64())])
    linked = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                top = (part.view(np.uint64) >> np.uint64(rest))[:, None] ^ flips[None, :]
                yield as_batch(sent, bucket=top.ravel().astype(np.int64), fp=np.repeat(part, len(flips)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by bucket; one bucket is held at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            bucket, fp = int(held[0][0][0]), np.concatenate([x[1] for x in held]).view(np.uint64)
            held.clear()
            away = np.bitwise_count((fp >> np.uint64(rest)) ^ np.uint64(bucket))
            low = fp & np.uint64((1 << rest) - 1)
            out: list[np.ndarray] = []
            _stars([(low[away == a], fp[away == a]) for a in range(3)], rest, out, VARIANTS)
            if out:
                pairs = forest(np.unique(np.concatenate(out), axis=0).view(np.int64))
                yield as_batch(linked, u=[x for x, _ in pairs], v=[x for _, x in pairs])

        for batch in batches:
            b, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    if held and held[0][0][0] != b[x]:
                        yield from done()
                    held.append((b[x:y], fp[x:y]))
        yield from done()

    spread = fps.select("fp").mapInArrow(send, "bucket bigint, fp bigint")
    return spread.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(meet, "u bigint, v bigint")


def by_root(marked: DataFrame) -> DataFrame:
    """marked (doc_id, fp) -> (fp, least, root) of each distinct fingerprint: its smallest doc_id, its component."""
    own = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = stash(components(near_links(own, own.count())))
    return own.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs, component_id the smallest doc_id reachable over links.

    Rows without doc_id stay, grouped by their text; a component of such rows only has a null id. Repeated rows each have their row. Texts
    of any length are read whole; other columns, also clashing ones, fall away. Empty input: no rows.
    """
    marked = stash(fingerprints(docs))
    root = by_root(marked)
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = root.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group stays, all its columns kept: that of the smallest doc_id, of equal doc_ids that of the smallest hash.

    Rows are told apart by doc_id and a hash of all columns, so rows without doc_id, or unlike texts under one doc_id, are judged by
    their own groups; of rows equal in all columns one stays. Null, empty and wordless texts form one group. Empty docs: no rows.
    """
    own_id = F.col("doc_id").cast("bigint") if "doc_id" in docs.columns else F.lit(None).cast("bigint")
    marked = stash(fingerprints(docs, hashed=True))
    root = by_root(marked).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = stash(marked.join(root, "fp").groupBy("root").agg(F.min(rank).alias("m")).select("m.doc_id", "m.h"))
    leads = first.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    kept = docs.withColumns({"_own": own_id, "_row": row_hash(docs)}).join(leads, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_h")), "left_semi")
    repeated = marked.join(leads, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["_own", "_row"]) if repeated else kept).drop("_own", "_row")
