"""Extractive answers: the best span of start and end scores over windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.operators.scoring import Scorer, scored


#: A window's best span: its first and last token, their places, its score; the window's null score.
_SPAN = {"window": pa.int64(), "s": pa.int64(), "e": pa.int64(), "score": pa.float64(), "null_score": pa.float64(), "begins": pa.int32(), "stops": pa.int32()}


def _first(values: np.ndarray, tokens: np.ndarray, top: int) -> np.ndarray:
    """Where the top greatest values are, first tokens of equals, in order of tokens."""
    at = np.lexsort((tokens, -values))
    at = at[~np.isnan(values[at])][:top]
    return at[np.argsort(tokens[at], kind="stable")]


def window_spans(rows: DataFrame, keys: list[str], logits: str, top: int, longest: int) -> DataFrame:
    """rows (keys, logits: array of window, token, start, end, begins, stops) -> keys and _SPAN of each window that has a null answer.

    Of equal scores the span of the first start, then of the first end; a window without any span has null offsets. A row's windows are
    gone through where they are: no score is shuffled, and no pair of a start and an end becomes a row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            cuts = lists.offsets.to_numpy()
            flat = lists.values
            of = lambda n, kind: flat.field(n).cast(kind).to_numpy(zero_copy_only=False)
            window, token, start, end = of("window", pa.int64()), of("token", pa.int64()), of("start", pa.float64()), of("end", pa.float64())
            begins, stops = flat.field("begins"), flat.field("stops")
            at, out, places = [], [], ([], [])
            for r, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                order = lo + np.argsort(window[lo:hi], kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(window[order])) + 1):
                    null, body = part[token[part] == 0], part[token[part] > 0]
                    if not len(null):
                        continue
                    s, e = (body[_first(v[body], token[body], top)] for v in (start, end))
                    score = np.where((token[s][:, None] <= token[e]) & (token[e] < token[s][:, None] + longest), start[s][:, None] + end[e], -np.inf)
                    best = int(score.argmax()) if score.size else 0
                    i, j = divmod(best, max(1, len(e)))
                    found = score.size > 0 and score[i, j] > -np.inf
                    at.append(r)
                    out.append((int(window[null[0]]), *((int(token[s[i]]), int(token[e[j]]), float(score[i, j])) if found else (None, None, None)), float((start[null] + end[null]).min())))
                    for place, x in zip(places, (s[i], e[j]) if found else (None, None), strict=True):
                        place.append(None if x is None else int(x))
            columns = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            columns += [pa.array([o[k] for o in out], t) for k, t in enumerate(list(_SPAN.values())[:5])]
            columns += [v.cast(pa.int32()).take(pa.array(p, pa.int64())) for v, p in zip((begins, stops), places, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *_SPAN])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, logits).mapInArrow(work, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["window bigint, s bigint, e bigint, score double, null_score double, begins int, stops int"]))


def best_of(spans: DataFrame, threshold: float) -> DataFrame:
    """A row per query of window_spans by query_id: the span of the greatest score over its window's null score, with begins and stops."""
    diff = F.col("score") - F.col("null_score")
    key = F.struct(diff.alias("diff"), "score", (-F.col("window")).alias("w"), (-F.col("s")).alias("ns"), (-F.col("e")).alias("ne"), "begins", "stops")
    best = spans.groupBy("query_id").agg(F.max(F.when(F.col("s").isNotNull(), key)).alias("b"))
    ok = F.coalesce(F.col("b.diff") > threshold, F.lit(False))
    span = lambda c: F.when(ok, -F.col(f"b.{c}"))
    return best.select("query_id", ok.alias("answerable"), span("w").alias("window"), span("ns").alias("start_token"), span("ne").alias("end_token"), F.round("b.score", 4).alias("score"), F.round("b.diff", 4).alias("score_diff"), "b.begins", "b.stops")


def best_span(logits: DataFrame, top: int = 20, longest: int = 64, threshold: float = 0.0) -> DataFrame:
    """logits (query_id, window, token, start, end), token 0 the null answer -> a row per query.

    Of each window's top starts and ends, the span start <= end < start + longest of the greatest score over the window's null score;
    answerable if that is over the threshold. A query without any span has null offsets.
    """
    none = F.lit(None).cast("int")
    one = F.struct("window", "token", "start", "end", none.alias("begins"), none.alias("stops"))
    rows = logits.groupBy("query_id", F.col("window").alias("_window")).agg(F.collect_list(one).alias("logits"))
    kinds = dict(logits.dtypes)
    found = best_of(window_spans(rows, ["query_id"], "logits", top, longest), threshold).drop("begins", "stops")
    return found.withColumns({"window": F.col("window").cast(kinds["window"]), **{c: F.col(c).cast(kinds["token"]) for c in ("start_token", "end_token")}})


#: What a reader says of (question, text): of each window's tokens the start and end scores and the code points that they stand for; token 0
#: of a window is the null answer, without a place in the text.
LOGITS = "array<struct<window: int, token: int, start: double, end: double, begins: int, stops: int>>"


@dataclass(frozen=True)
class Reading:
    """How a text is read: tokens of a window, tokens that neighbours share, best starts and ends of a window, the longest answer's tokens, the
    score over the null answer's from which a question counts as answered."""

    window: int = 384
    shared: int = 128
    best: int = 20
    longest: int = 64
    threshold: float = 0.0

    def __post_init__(self) -> None:
        if min(self.window, self.best, self.longest) < 1 or not 0 <= self.shared < self.window:
            raise ValueError("windows, best and longest must be 1 or more, and a window must go beyond what it shares")


def windows(n: int, reading: Reading) -> list[tuple[int, int]]:
    """Half-open ranges of n tokens: each begins window - shared after the one before; the last ends with the text."""
    step, out = reading.window - reading.shared, []
    for at in range(0, max(n, 1), step):
        out.append((at, min(n, at + reading.window)))
        if at + reading.window >= n:
            break
    return out


def reader(name: str, tokens: Callable[[str], list[tuple[int, int]]], logits: Callable[[str, str, list[tuple[int, int]]], tuple[list[float], list[float]]], reading: Reading, batch: int = 8) -> Scorer:
    """A scorer of LOGITS. tokens: code-point ranges of a text's tokens; logits: start and end scores of (question, text, a window's ranges),
    the null answer's first."""

    def load(_: str):
        def one(question: str, text: str) -> list[dict]:
            ranges, out = tokens(text), []
            for w, (a, b) in enumerate(windows(len(ranges), reading)):
                start, end = logits(question, text, ranges[a:b])
                places = [(None, None), *ranges[a:b]]
                out += [{"window": w, "token": t, "start": float(s), "end": float(e), "begins": p[0], "stops": p[1]} for t, (s, e, p) in enumerate(zip(start, end, places, strict=True))]
            return out

        return lambda rows: [one(*r) for r in rows]

    return Scorer(name, load, LOGITS, batch)


def answer(questions: DataFrame, evidence: DataFrame, read: Scorer, reading: Reading = Reading()) -> DataFrame:
    """questions (query_id, query), evidence (query_id, rank, chunk_id, document_id, page_number, text) -> a row per question.

    The best span of all windows of all evidence by its score over the window's null answer; blank evidence isn't read, but counts in
    n_evidence. Without a span over the threshold there is no answer and no place; scores and ids of the best stay. A blank question fails.
    """
    blank = F.coalesce(F.trim("query"), F.lit("")) == ""
    asked = questions.withColumn("query", F.when(blank, F.raise_error(F.lit("questions must not be blank")).cast("string")).otherwise(F.trim("query")))
    n = evidence.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    e = evidence.withColumn("evidence_rank", order).where(F.trim(F.coalesce("text", F.lit(""))) != "").join(asked, "query_id")
    said = scored(e, read, "_logits", "query", "text").where("_logits is not null")
    # a window of a piece of evidence as one number, in order of both
    wide = window_spans(said, ["query_id", "evidence_rank"], "_logits", reading.best, reading.longest).withColumn("window", F.col("evidence_rank").cast("bigint") * (1 << 20) + F.col("window"))
    b = best_of(wide, float("-inf"))
    b = b.withColumn("evidence_rank", F.floor(F.col("window") / (1 << 20)).cast("int")).join(e.select("query_id", "evidence_rank", "chunk_id", "document_id", "page_number", "text"), ["query_id", "evidence_rank"], "left")
    raw = F.substring("text", F.col("begins") + 1, F.col("stops") - F.col("begins"))
    left = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    bare = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    ok = F.coalesce((F.col("score_diff") > reading.threshold) & (bare != ""), F.lit(False))
    of = lambda c: F.when(ok, c)
    out = b.select(
        "query_id", ok.alias("answerable"), of(bare).alias("answer"), of(F.col("begins") + left).alias("answer_start"), of(F.col("begins") + left + F.length(bare)).alias("answer_end"), F.col("score").alias("qa_score"), F.round(F.col("score") - F.col("score_diff"), 4).alias("no_answer_score"), "evidence_rank", "chunk_id",
        "document_id", "page_number",
    )
    return questions.select("query_id").join(out, "query_id", "left").join(n, "query_id", "left").withColumns({"answerable": F.coalesce("answerable", F.lit(False)), "n_evidence": F.coalesce("n_evidence", F.lit(0))})
