"""Section labels carried in document order: chunks that go on with front or back matter inherit its label.

The order is a chain: what a chunk inherits depends on the chunk before. A chunk changes the state that it is given in one of a few ways
only, and such changes compose. So a document is cut into ranges, each range's changes are composed to one, the ranges' changes are run
through in a row per range, and each range then starts from the state that it is given. A document of one range starts from none. Tasks go
through many documents' rows one after another and hold a state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.operators import questions
from folio.operators.store import materialise

# Sections that go on for so many pages; sections that go on while the text looks like theirs; how much it must.
CARRIED = ("PREFACE", "FOREWORD", "ACKNOWLEDGEMENTS", "AUTHOR_BIO", "ABSTRACT", "TABLE_OF_CONTENTS", "COPYRIGHT")
CARRY_PAGES = 2
CITED, INDEXED = ("REFERENCES", "BIBLIOGRAPHY"), "INDEX"
LEAST_CITATIONS, LEAST_REFERENCES = 3, 5
# Where a chapter or a numbered section begins.
SECTION_START = r"(?U)^[\s\W]*(?:\d{1,4}\s+)?(?:CHAPTER|Chapter)\s+[\dIVXL]+\b|^[\s\W]*\d+(?:\.\d+)+\s+[A-Z]"
#: Chunks of a range.
RANGE = 4096
#: The states that a chunk can be given: none, or a section and the page on which it began.
_SECTIONS = (*CARRIED, *CITED, INDEXED)
State = tuple[str, int] | None


def step(state: State, eligible: bool, category: str, page: int, opens: bool, citations: int, references: int) -> tuple[str | None, State]:
    """(the section that a chunk inherits, or None; the state after it). opens: the chunk has a heading or section start of its own."""
    carried = None
    if eligible and state is not None and not opens:
        active, since = state
        if (active in CARRIED and page - since <= CARRY_PAGES) or (active in CITED and citations >= LEAST_CITATIONS) or (active == INDEXED and references >= LEAST_REFERENCES):
            carried = active
    if carried is None and eligible:
        return None, None
    now = carried or category
    if now not in _SECTIONS:
        return carried, state
    return carried, state if state is not None and state[0] == now else (now, page)


def classified(chunks: DataFrame, heading: str | None = None, size: int = RANGE) -> DataFrame:
    """chunks (document_id, chunk_id, page_number, chunk_index, text) with category, reason and eligible: questions.eligible, and what is carried."""
    c = questions.measured(questions.eligible(chunks, "text", heading).drop("density"), "text")
    own = questions.lead_heading(F.col("_text")).isNotNull() | F.substring("_text", 1, questions.LEAD_CHARS).rlike(SECTION_START)
    if heading:
        own |= F.coalesce(F.trim(F.col(heading)) != "", F.lit(False))
    slim = materialise(c.select("document_id", "page_number", "chunk_index", "chunk_id", "category", "reason", "eligible", own.alias("opens"), "citations", "index_refs"))
    # ranges of a document by its order: from counts of blocks of a page's chunks, so that no window holds all of its chunks
    slim = slim.withColumn("block", F.floor(F.col("chunk_index") / size))
    blocks = slim.groupBy("document_id", "page_number", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("document_id").orderBy("page_number", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = blocks.select("document_id", "page_number", "block", F.floor(before / size).alias("range"))
    part = part.withColumn("several", F.max("range").over(Window.partitionBy("document_id")) > 0)
    placed = slim.join(part, ["document_id", "page_number", "block"])
    placed = placed.select("document_id", "range", "page_number", "chunk_index", "chunk_id", "category", "reason", "eligible", "opens", "citations", "index_refs", "several")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    together = lambda df, *order: df.repartition("document_id", *order[:1]).sortWithinPartitions("document_id", *order)
    facts = ["eligible", "category", "page_number", "opens", "citations", "index_refs"]

    # rows come in order, whole ranges one after another: a task holds a state and a batch, whatever the number of documents
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each range makes of each state. Of a section that was given, only the page on which it began matters: as long as no chunk
        has looked at it, it is passed on as it is."""
        key, kind, first, given, now = None, None, 0, {}, {}

        def done() -> pa.RecordBatch:
            n = len(given)
            state = [now[k] for k in given]
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]] * n, kind), pa.array([key[1]] * n, pa.int64()), pa.array([first] * n, pa.int32()), pa.array(list(given)), pa.array([x and x[0] for x in state], pa.string()), pa.array([x and x[1] for x in state], pa.int32()),
                pa.array([x is not None and x == given[k] for k, x in now.items()]),
            ], names=["document_id", "range", "first_page", "given", "section", "since", "same"])

        for b in batches:
            kind = b.schema.field(0).type
            for doc, at, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (doc, at) != key:
                    if key is not None:
                        yield done()
                    key, first = (doc, at), row[2]
                    given = {"": None} | {f"{s}|{p}": (s, p) for s in _SECTIONS for p in ([first - k for k in range(CARRY_PAGES + 2)] if s in CARRIED else [0])}
                    now = dict(given)
                now = {k: step(x, *row)[1] for k, x in now.items()}
        if key is not None:
            yield done()

    changes = together(placed.where("several").select("document_id", "range", *facts, "chunk_index", "chunk_id"), "range", "page_number", "chunk_index", "chunk_id").select("document_id", "range", *facts)
    changes = changes.mapInArrow(change, f"document_id {kinds['document_id']}, range bigint, first_page int, given string, section string, since int, same boolean")

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state that each range of a document is given: a walk over its ranges."""
        doc_now, at_now, state, key = None, None, None, ""
        for b in batches:
            out = []
            for doc, at, first, given, section, since, same in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (doc, at) != (doc_now, at_now):
                    state = after if doc == doc_now else None
                    doc_now, at_now, after = doc, at, state
                    key = "" if state is None else f"{state[0]}|{max(state[1], first - CARRY_PAGES - 1) if state[0] in CARRIED else 0}"
                    out.append((doc, at, state and state[0], state and state[1]))
                if given == key and not same:
                    after = None if section is None or since is None else (section, since)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (b.schema.field(0).type, pa.int64(), pa.string(), pa.int32()), strict=True)], names=["document_id", "range", "section", "since"])

    starts = changes.repartition("document_id").sortWithinPartitions("document_id", "range").mapInArrow(through, f"document_id {kinds['document_id']}, range bigint, section string, since int")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            carried = []
            for doc, at, section, since, *row in zip(*(b.column(c).to_pylist() for c in ("document_id", "range", "section", "since", *facts)), strict=True):
                if (doc, at) != key:
                    key, state = (doc, at), None if section is None else (section, since)
                got, state = step(state, *row)
                carried.append(got)
            kept = ["document_id", "chunk_id", "category", "reason", "eligible"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(carried, pa.string())], names=[*kept, "carried"])

    marked = together(placed.join(starts, ["document_id", "range"], "left"), "range", "page_number", "chunk_index", "chunk_id")
    marked = marked.mapInArrow(label, f"document_id {kinds['document_id']}, chunk_id {kinds['chunk_id']}, category string, reason string, eligible boolean, carried string")
    named = F.when(F.col("carried") == "TABLE_OF_CONTENTS", "toc_content_continuation").otherwise(F.concat(F.lower("carried"), F.lit("_content_continuation")))
    kept = F.col("carried").isNull()
    return marked.select("document_id", "chunk_id", F.coalesce("carried", "category").alias("category"), F.when(kept, F.col("reason")).otherwise(named).alias("reason"), (F.col("eligible") & kept).alias("eligible"))
