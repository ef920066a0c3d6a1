"""Mixing sources to target weights: fixed blocks, multinomial counts per shard, pseudorandom index permutations.

Each source's documents, one after another, are cut into blocks of BLOCK words. The sources' slots are dealt to output shards by
multinomial draws that sum to each source's quota, and a source's slot s takes the block at the s-th place of a keyed permutation
of its block numbers (a new permutation for each pass over them). Slots and blocks meet by (source, block number).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from folio.llm.common import as_batch, bytes_column, chunks, row_hash, stash, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SEED = 128, 20240607
#: Slots of one output shard, of the shards drawn together, and documents of one run of a source's stream.
SHARD_SLOTS, STRATUM, RUN_DOCS = 4096, 1 << 17, 2000
#: What the mix adds to a document's columns.
MIX_COLUMNS = ("size", "source_size", "target", "taken", "shard", "slot", "first", "start")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each text, 0 for a null one; h, a hash of all columns, tells rows of one doc_id apart."""
    d = table(docs, {"doc_id": "bigint", "source": "string", "text": "string"}, h=row_hash(docs))
    return d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint").alias("size"), "h")


def targets(source_sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words asked of each source, in the order given: shares by weight, capped at most times the size, the excess reshared."""
    n = len(source_sizes)
    size = np.array(source_sizes, float)
    w = np.array([weights[i % len(weights)] for i in range(n)], float)
    out, free, left = np.zeros(n), np.ones(n, bool), share * size.sum()
    while free.any():
        want = left * w / w[free].sum()
        over = free & (want > most * size)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): a Feistel network over the next power of four, walked until it falls inside."""
    if n <= 1:
        return np.zeros_like(x)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            k = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (f >> np.uint64(32))) & mask
        v = (left << np.uint64(half)) | right
        out[todo] = v
        todo = todo[v >= n]
    return out.astype(np.int64)


def shard_counts(quotas: list[int], shard: int = SHARD_SLOTS, seed: int | tuple[int, ...] = SEED) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws, conditioned on the quotas as their sums. For the quotas of one stratum."""
    left = np.array(quotas, np.int64)
    rng, rows = np.random.default_rng(seed), []
    while left.sum() > 0:
        rows.append(rng.multivariate_hypergeometric(left, int(min(shard, left.sum())), method="marginals"))
        left -= rows[-1]
    return np.array(rows, np.int64).reshape(len(rows), len(quotas))


def plan(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, quota, blocks, runs, sid) per source: a local table, so joins with it broadcast only below Spark's own limit."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    want = targets([r.n for r in totals])
    rows = []
    for i, (r, t) in enumerate(zip(totals, want, strict=True)):
        blocks = -(-r.n // BLOCK)
        rows.append((r.source, r.n, t, min(MOST * blocks, round(t / r.n * blocks)) if r.n else 0, blocks, max(1, -(-r.docs // RUN_DOCS)), i))
    kinds = "source string, source_size bigint, target double, quota bigint, blocks bigint, runs int, sid int"
    return sized.sparkSession.createDataFrame(rows, kinds)


def slots(sources: DataFrame) -> DataFrame:
    """(shard, slot, sid, block): what each output slot holds.

    Each source's slots are dealt evenly to strata of about STRATUM slots, at every size alike; a stratum's task draws its shards'
    counts and lays its slots, so the driver holds a number for each source only.
    """
    rows = sources.orderBy("sid").collect()
    spark = sources.sparkSession
    quotas, blocks = [int(r.quota) for r in rows], [int(r.blocks) for r in rows]
    n_strata = -(-sum(quotas) // STRATUM)
    shards_each = -(-(STRATUM + len(rows)) // SHARD_SLOTS)
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("sid", pa.int32()), ("block", pa.int64())])

    def fill(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                begin = [q * k // n_strata for q in quotas]
                counts = shard_counts([q * (k + 1) // n_strata - s for q, s in zip(quotas, begin, strict=True)], SHARD_SLOTS, (SEED, k))
                for sid in np.flatnonzero(counts.sum(0)).tolist():
                    nb, own = blocks[sid], np.repeat(np.arange(len(counts)), counts[:, sid]) + k * shards_each
                    for part in chunks(len(own), 50_000):
                        s = np.arange(begin[sid] + part.start, begin[sid] + part.stop)
                        block = np.zeros(len(s), np.int64)
                        for p in np.unique(s // nb).tolist():
                            at = s // nb == p
                            block[at] = permuted(s[at] % nb, nb, SEED + 7919 * sid + 104729 * p)
                        yield as_batch(schema, shard=own[part], slot=s, sid=np.full(len(s), sid, np.int32), block=block)

    return spark.range(0, n_strata, 1, max(1, min(n_strata, 100_000))).mapInArrow(fill, "shard bigint, slot bigint, sid int, block bigint")


def layout(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its place in its source's stream of words: (doc_id, source, size, sid, h, first), h as in sizes.

    A source's stream goes by run (a hash of the document), doc_id, h; so a hot source is ordered by many tasks, and
    what one task learns of the others is the sums of their runs.
    """
    meta = sources.select(F.col("source").alias("_s"), "sid", "runs")
    d = sized.join(meta, sized["source"].eqNullSafe(F.col("_s"))).withColumn("run", F.pmod(F.xxhash64("doc_id", "h"), F.col("runs")).cast("int"))
    within = Window.partitionBy("sid", "run").orderBy(F.asc_nulls_last("doc_id"), "h").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = d.groupBy("sid", "run").agg(F.sum("size").alias("n"))
    at = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("sid", "run", "base")
    return d.join(at, ["sid", "run"]).select("doc_id", "source", "size", "sid", "h", (F.col("base") + F.col("before")).alias("first"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents laid out, sources, output): output has each slot's pieces (shard, slot, sid, block, doc_id, first, start, words).

    start counts from the document's first word. Documents without words have no piece. Reruns agree: all choices are keyed.
    """
    sized = stash(sizes(docs))
    sources = plan(sized)
    laid = stash(layout(sized, sources))
    last = F.floor((F.col("first") + F.col("size") - 1) / BLOCK)
    piece = laid.where("size > 0").select("doc_id", "sid", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), last)).alias("block"))
    begin = F.greatest(F.col("first"), F.col("block") * BLOCK)
    piece = piece.select("sid", "block", "doc_id", "first", (begin - F.col("first")).alias("start"), (F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * BLOCK) - begin).alias("words"))
    # slots grow with the input, but come out of a short range, from which Spark would take them to be small and broadcast them
    return laid, sources, slots(sources).hint("merge").join(piece, ["sid", "block"])


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document; taken counts a word as often as the mix takes it.

    Null and empty texts have size 0 and nothing taken; a null source is the last one. Rows are told apart by all their columns, so repeated
    and null doc_ids each keep their row; rows equal in all columns share what is taken of them. Texts of any length are cut into blocks.
    Other columns, also clashing ones, fall away. Empty docs: no rows.
    """
    laid, sources, out = mix(docs)
    got = out.groupBy("sid", "first").agg(F.sum("words").alias("taken")).withColumn("some", F.lit(True))
    all_docs = laid.withColumn("some", F.col("size") > 0)
    s = sources.select("sid", "source_size", "target")
    return (
        all_docs.join(got, ["sid", "first", "some"], "left").join(s, "sid")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: docs' columns with text replaced by a piece that a slot takes, one row for each piece and slot, repeats included.

    Further columns: size, source_size, target and taken of the row's document, and shard, slot, first (its place in its source), start
    (the piece's first word in it); where docs has a column of such a name, that one stays and the mix's has mix_ before its name. A
    piece's words are joined by one space. A row of which the mix takes nothing (a null or wordless text among them) stays as one row
    with null text, shard, slot and start: the decision stays on record, its words are gone. Rows that share a doc_id, or have none, are
    told apart by all their columns; equal rows are as many plans over the same text. Empty docs: no rows.
    """
    laid, sources, out = mix(docs)
    got = out.groupBy("sid", "first").agg(F.sum("words").alias("taken"), F.collect_list(F.struct("shard", "slot", "start", "words")).alias("_pieces")).withColumn("some", F.lit(True))
    plans = (
        laid.withColumn("some", F.col("size") > 0).join(got, ["sid", "first", "some"], "left").join(sources.select("sid", "source_size", "target"), "sid")
        .select(F.col("doc_id").alias("_id2"), F.col("source").alias("_src2"), F.col("h").alias("_h2"), *[F.col(c).alias(f"_{c}") for c in ("size", "source_size", "target")], F.coalesce("taken", F.lit(0)).cast("bigint").alias("_taken"), F.col("first").alias("_first"), "_pieces")
    )
    own = docs if "text" in docs.columns else docs.withColumn("text", F.lit(None).cast("string"))
    named = {}
    for c in MIX_COLUMNS:
        name = c
        while name in own.columns:
            name = f"mix_{name}"
        named[c] = name
    of = {c: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t) for c, t in (("doc_id", "bigint"), ("source", "string"))}
    keyed = own.withColumns({"_id": of["doc_id"], "_src": of["source"], "_h": row_hash(docs)})
    if laid.groupBy("doc_id", "source", "h").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["_id", "_src", "_h"])  # rows equal in all columns: each one's plan cuts the same text
    same = F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_src").eqNullSafe(F.col("_src2")) & (F.col("_h") == F.col("_h2"))
    rows = keyed.join(plans, same).select(*[F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`") for c in own.columns], *[f"_{c}" for c in MIX_COLUMNS[:5] if c != "shard"], "_first", "_pieces")
    names = [c for c in own.columns if c != "text"]
    kinds = StructType([*[StructField(f.name, StringType()) if f.name == "text" else f for f in own.schema.fields], *[StructField(named[c], DoubleType() if c == "target" else LongType()) for c in MIX_COLUMNS]])

    def lay(batches):
        for whole in batches:
            for at in chunks(whole.num_rows, 500):
                b = whole.slice(at.start, at.stop - at.start)
                texts, cuts = bytes_column(b), b.column(b.schema.get_field_index("_pieces"))
                n = np.array([len(x) if x.is_valid else 0 for x in cuts])
                flat = cuts.flatten()
                shard, slot, start, words = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("shard", "slot", "start", "words"))
                order = np.lexsort((start, slot, shard, np.repeat(np.arange(len(n)), n)))
                shard, slot, start, words = shard[order], slot[order], start[order], words[order]
                row, text, piece, done = [], [], [], 0
                for i, (t, k) in enumerate(zip(texts, n.tolist(), strict=True)):
                    if not k:
                        row.append(i), text.append(None), piece.append(-1)
                        continue
                    begins, ends = word_bounds(t)
                    for j in range(done, done + k):
                        first, last = start[j], start[j] + words[j] - 1
                        row.append(i), text.append(b" ".join(t[begins[first] : ends[last]].split())), piece.append(j)
                    done += k
                for part in chunks(len(row), 20_000):
                    pick, j = pa.array(row[part]), np.array(piece[part])
                    of = lambda v: pa.array(v[j] if len(v) else np.zeros(len(j), np.int64), pa.int64(), mask=j < 0)  # noqa: B023, E731
                    made = {named["shard"]: of(shard), named["slot"]: of(slot), named["start"]: of(start), "text": pa.array(text[part], pa.binary()).cast(pa.string())}
                    cols = {c: b.column(b.schema.get_field_index(c)).take(pick) for c in names} | {named[c]: b.column(b.schema.get_field_index(f"_{c}")).take(pick) for c in ("size", "source_size", "target", "taken", "first")} | made
                    yield pa.RecordBatch.from_arrays([cols[c] for c in kinds.names], names=kinds.names)

    return rows.mapInArrow(lay, kinds)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def materialise(docs: DataFrame) -> DataFrame:
    """(shard, slot, first, doc_id, text): the mix alone; a slot's pieces go by first and start in the source's stream."""
    bare = docs.select(*[c for c in docs.columns if c in ("doc_id", "source", "text")])
    return mixed(bare).where("slot is not null").select("shard", "slot", "first", "doc_id", "text")
