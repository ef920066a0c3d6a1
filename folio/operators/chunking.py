"""Cutting pages into chunks: units packed up to a target, with overlap; numbering over the document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as T

_END = regex.compile(T.SENTENCE_END)


#: Characters of overlap below which there is none.
LEAST_OVERLAP = 20
#: Characters of pages whose chunks are handed on together.
TOGETHER = 4 << 20


@dataclass(frozen=True)
class Sizes:
    """Target and greatest characters of a chunk, overlap between neighbours."""

    target: int = 1200
    most: int = 1600
    overlap: int = 200

    def __post_init__(self) -> None:
        if not 0 < self.target <= self.most or not 0 <= self.overlap < self.target:
            raise ValueError("0 < target <= most and 0 <= overlap < target")


def each_sentence(s: str) -> Iterator[str]:
    at = 0
    for m in _END.finditer(s):
        if x := s[at : m.end(1)].strip():
            yield x
        at = m.end()
    if x := s[at:].strip():
        yield x


def sentences(s: str) -> list[str]:
    """As the Column expression of that name: the pattern is the same."""
    return list(each_sentence(s))


def segments(s: str, most: int) -> list[str]:
    """A long sentence as runs of words of at most most characters; a longer word is cut into pieces of its own."""
    out, cur = [], ""
    for w in s.split(" "):
        if len(w) > most:
            out += [cur] * bool(cur) + [w[i : i + most] for i in range(0, len(w), most)]
            cur = ""
        elif cur and len(cur) + 1 + len(w) > most:
            out.append(cur)
            cur = w
        else:
            cur = f"{cur} {w}" if cur else w
    return [x for x in [*out, cur] if x.strip()]


def prefix(s: str, n: int) -> str:
    """The last n characters of a chunk, from the first word that begins among them; all of a shorter one."""
    s = s.strip()
    if len(s) <= n:
        return s
    tail = s[-n:].lstrip()
    cut = tail.find(" ")
    return tail[cut + 1 :].strip() if 0 <= cut < len(tail) - 1 else tail


def units(text: str, sizes: Sizes) -> Iterator[tuple[str, str]]:
    """(what stands before it, unit): paragraphs, else their sentences, else segments, one at a time: a long page's are never all held."""
    at = 0
    while at < len(text):
        end = text.find("\n\n", at)
        end = len(text) if end < 0 else end
        if p := text[at:end].strip():
            parts = [p] if len(p) <= sizes.most else (y for x in each_sentence(p) for y in ([x] if len(x) <= sizes.most else segments(x, sizes.most)))
            for i, u in enumerate(parts):
                yield "\n\n" if i == 0 else " ", u
        at = end + 2


def chunk(text: str, sizes: Sizes = Sizes()) -> list[str]:
    """A cleaned page as chunks: paragraphs, else their sentences, else segments, packed while below the target."""
    out, cur = [], ""
    for sep, u in units(text, sizes):
        projected = len(cur) + len(sep) + len(u)
        if not cur:
            cur = u
        elif projected <= sizes.most and (len(cur) < sizes.target or projected <= sizes.target):
            cur += sep + u
        else:
            out.append(cur)
            room = min(sizes.overlap, sizes.most - len(sep) - len(u))
            lead = prefix(cur, room) if room >= LEAST_OVERLAP else ""
            cur = f"{lead}{sep}{u}" if lead and not u.startswith(lead) and len(lead) + len(sep) + len(u) <= sizes.most else u
    return [x for x in (c.strip() for c in [*out, cur]) if x]


def chunk_pages(pages: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """pages (document_id, page_number, text) -> chunks numbered from 0 over each document.

    Pages are cut in parallel, whatever their document, once: a page's chunks stay one row until the counts of the pages before it are
    summed, so a long document needs no task of its own.
    """
    cleaned = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), T.clean(F.col("text")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, cut, held = 0, [], 0
            # one page's text at a time; chunks are handed on as soon as they are many
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                cut.append(chunk(text, sizes) if text else [])
                held += len(text or "")
                if held > TOGETHER or len(cut) >= 500 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(cut)), b.column(1).slice(begin, len(cut)), pa.array(cut, pa.list_(pa.string())), pa.array([len(c) for c in cut], pa.int64())], names=["document_id", "page_number", "chunks", "n"])
                    begin, cut, held = i + 1, [], 0

    cut = cleaned.mapInArrow(work, "document_id string, page_number int, chunks array<string>, n bigint").where("n > 0")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = cut.withColumn("base", before).select("document_id", "page_number", "base", F.posexplode("chunks").alias("at", "text")).withColumn("chunk_index", (F.col("base") + F.col("at")).cast("int"))
    return n.select("document_id", "page_number", "chunk_index", F.format_string("%s_p%03d_c%04d", "document_id", "page_number", "chunk_index").alias("chunk_id"), "text", F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"))
