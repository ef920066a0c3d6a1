"""Models behind one interface: inputs are made distinct, scored in batches inside tasks, and joined back one to one.

A Scorer names its model; a worker loads it once and keeps it for its later tasks. The model gets whole batches of input tuples. Its
scores are written before they are joined, so that no plan, retry or second reader scores an input twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.store import materialise

Model = Callable[[list[tuple]], Sequence]


class ScoringError(ValueError):
    """A model gave something else than one finite score for each input."""


@dataclass(frozen=True)
class Scorer:
    """load(device) gives the model; returns is the type of a score; a forward pass gets up to batch inputs."""

    name: str
    load: Callable[[str], Model]
    returns: str = "double"
    batch: int = 32

    def __post_init__(self) -> None:
        if self.batch < 1:
            raise ValueError("batch must be 1 or more")


_LOADED: dict[str, Model] = {}


def device() -> str:
    """The accelerator that Spark gave this task (spark.task.resource.gpu.amount), else cpu."""
    context = TaskContext.get()
    gpu = context.resources().get("gpu") if context else None
    return f"cuda:{gpu.addresses[0]}" if gpu else "cpu"


def loaded(scorer: Scorer) -> Model:
    """The scorer's model in this worker, for its device."""
    key = f"{scorer.name}::{device()}"
    if key not in _LOADED:
        _LOADED[key] = scorer.load(device())
    return _LOADED[key]


def finite(score: object) -> bool:
    for x in score.values() if isinstance(score, dict) else score if isinstance(score, (list, tuple)) else (score,):
        if not (math.isfinite(x) if isinstance(x, float) else finite(x) if isinstance(x, (dict, list, tuple)) else True):
            return False
    return True


def batches(model: Model, inputs: list[tuple], size: int) -> list:
    """The model's scores of inputs, in their order."""
    out: list = []
    for at in range(0, len(inputs), size):
        part = inputs[at : at + size]
        got = list(model(part))
        if len(got) != len(part):
            raise ScoringError(f"{len(got)} scores for {len(part)} inputs")
        if not all(map(finite, got)):
            raise ScoringError("scores must be finite")
        out += got
    return out


def scored(rows: DataFrame, scorer: Scorer, out: str, *inputs: str | Column) -> DataFrame:
    """rows with out, the score of each row's inputs. Equal inputs are scored once; a row with a null input has a null score."""
    named = {f"_in{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(inputs)}
    known = F.lit(True)
    for c in named.values():
        known &= c.isNotNull()
    pair = F.when(known, F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in named.items()])), 256))
    asked = rows.select(pair.alias("_pair"), *[c.alias(n) for n, c in named.items()]).where("_pair is not null").dropDuplicates(["_pair"])
    columns = list(named)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(scorer)
        for f in frames:
            scores = batches(model, list(zip(*(f[c].tolist() for c in columns), strict=True)), scorer.batch)
            yield pd.DataFrame({"_pair": f["_pair"], out: pd.Series(scores, dtype=object, index=f.index)})

    answers = materialise(asked.mapInPandas(work, f"_pair string, `{out}` {scorer.returns}"))
    return rows.withColumn("_pair", pair).join(answers, "_pair", "left").drop("_pair")


def labels_of(names: dict[int, str]) -> dict[str, int]:
    """Which output of a classifier is entailment, contradiction and neutral, by its own names for them."""
    out: dict[str, int] = {}
    for label, sign in (("entailment", "entail"), ("contradiction", "contra"), ("neutral", "neut")):
        at = [int(i) for i, n in names.items() if sign in str(n).lower()]
        if len(at) != 1:
            raise ScoringError(f"no single output for {label} among {names}")
        out[label] = at[0]
    return out


def probabilities(row: Sequence[float]) -> list[float]:
    """A row of outputs as probabilities: one that is none (a value outside 0 to 1, or another sum than 1) goes through softmax."""
    if min(row) < 0 or max(row) > 1 or abs(sum(row) - 1) > 1e-3:
        e = [math.exp(x - max(row)) for x in row]
        row = [x / sum(e) for x in e]
    return [min(1.0, max(0.0, x)) for x in row]


def nli(name: str, outputs: Callable[[str], Callable[[list[tuple]], Sequence[Sequence[float]]]], names: dict[int, str], batch: int = 8) -> Scorer:
    """A scorer of (premise, hypothesis): struct of entailment, contradiction and neutral, from a model's three outputs."""
    at = labels_of(names)

    def load(where: str) -> Model:
        model = outputs(where)
        return lambda pairs: [{label: probabilities(list(map(float, row)))[i] for label, i in at.items()} for row in model(pairs)]

    return Scorer(name, load, "struct<entailment: double, contradiction: double, neutral: double>", batch)
