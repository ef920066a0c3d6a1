"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put in another order behind sentinels.

A Split pre-tokenizer with isolated matches gives the lines' code-point offsets; it is not trained. The offsets' number is n, and the
offsets at two ranks drawn from a hash of doc_id are the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import PreTokenizer, Split

from folio.llm.common import as_batch, sliced, table

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Code points that the pre-tokenizer sees at once; it keeps some 100 bytes for each.
BLOCK = 1 << 16
#: Code points of texts in a batch that a task gives back.
BATCH = 1 << 22
COLUMNS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def lines() -> PreTokenizer:
    return Split(Regex(LINE), behavior="isolated")


def ends(split: PreTokenizer, text: str, size: int = BLOCK) -> list[int]:
    """Where each line of text ends, in code points. A line that a block's end cuts goes on with the next block's first."""
    out: list[int] = []
    for at in range(0, len(text), size):
        block = text[at : at + size]
        if out and text[at - 1] != "\n":
            out.pop()
        out += [at + stop for _, (_, stop) in split.pre_tokenize_str(block)]
    return out


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and doc_id; a null doc_id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rewrite(split: PreTokenizer, doc_id: int | None, text: str, seed: int, rate: int, spm: int, size: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix's and middle's code points, output) of a text."""
    cuts = [0, *ends(split, text, size)]
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return len(cuts) - 1, "plain", None, None, text
    low, high = sorted((cuts[h1 % len(cuts)], cuts[h2 % len(cuts)]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    form = "spm" if h4 % 100 < spm else "psm"
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return len(cuts) - 1, form, low, high - low, output


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, size: int = BLOCK) -> DataFrame:
    """(doc_id, n lines, form, prefix_chars, middle_chars, output) of every row of docs, in one pass without a shuffle.

    rate of 100 texts are rewritten, spm of 100 of those suffix first. A null text counts as empty; an empty one, and one that holds a
    sentinel, stays plain, with null lengths. Repeated rows give repeated rows, rows under one doc_id are cut at the same ranks, a null
    doc_id draws as an empty one. Texts of any length go through the pre-tokenizer in blocks of size code points. Other columns, also clashing ones, fall
    away; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return as_batch(schema, **{name: list(values) for name, values in zip(schema.names, zip(*rows, strict=True), strict=True)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rows, held = lines(), [], 0
        for b in sliced(batches, 100):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((doc_id, *rewrite(split, doc_id, text or "", seed, rate, spm, size)))
                held += len(text or "")
                if held >= BATCH:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return table(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(work, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. No sentinel occurs in a rewritten text, so splitting at them gives its three parts."""
    part = F.split(output, "|".join(SENTINELS))
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """transform with the output's digest, and that of the text rebuilt from output and form, in the output's place."""
    t = transform(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
