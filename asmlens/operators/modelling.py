"""A scorer of chunk matrices that Spark tasks fit together (the model behind SCR1 and SCR2).

A chunk's matrix of positions is pooled to a vector of fixed length: mean,
deviation, least and greatest value of each column, and how far the mean of its
most unusual part lies from the whole, which is how a misassembly looks. One
hidden layer and a logistic make a score; the layer's values are the chunk's
embedding.

A pass of training runs in a stated number of tasks. Each steps through its rows
in small batches from the weights it is given; the weights of all tasks are then
averaged by their numbers of rows. Rows are dealt and ordered by digests, so a
pass that is run again, or on another cluster, gives the same weights.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.functions.columns import random_int

PARTS = 8  # parts of a chunk that are compared with the whole
STATS = ("mean", "sd", "min", "max", "part")


def pool(values: np.ndarray) -> list[float]:
    """The ``STATS`` of one column of a chunk; missing values are left out, zeros if all are missing."""
    x = np.asarray(values, float)
    x = x[~np.isnan(x)]
    if not len(x):
        return [0.0] * len(STATS)
    edges = np.linspace(0, len(x), min(PARTS, len(x)) + 1).astype(int)
    parts = np.add.reduceat(x, edges[:-1]) / np.diff(edges)
    return [x.mean(), x.std(), x.min(), x.max(), float(np.abs(parts - x.mean()).max())]


def pooled(matrices: DataFrame, columns: list[str], into: str = "vector") -> DataFrame:
    """``matrices`` (of ``chunk_matrices``) with one vector in place of the arrays of ``columns``."""
    rest = [c for c in matrices.columns if c not in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = [[v for column in row for v in pool(column)] for row in zip(*(pdf[c] for c in columns))]
            yield pdf[rest].assign(**{into: vectors})

    return matrices.mapInPandas(run, matrices.select(*rest, F.array(F.lit(0.0)).alias(into)).schema)


@dataclass(frozen=True)
class Scorer:
    """Weights of a fitted model; as a callable, a model for ``score_chunks`` that also gives embeddings."""

    columns: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray  # a row an input, the last one the offsets
    out: np.ndarray  # a weight a hidden value, the last one the offset

    @classmethod
    def start(cls, columns: list[str], mean: np.ndarray, scale: np.ndarray, size: int, seed: int) -> Scorer:
        dice, n = np.random.default_rng(seed), len(mean)
        hidden = np.vstack([dice.normal(0, 1 / np.sqrt(n), (n, size)), np.zeros(size)])
        return cls(tuple(columns), mean, scale, hidden, np.append(dice.normal(0, 1 / np.sqrt(size), size), 0.0))

    def _inputs(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([(vectors - self.mean) / self.scale, np.ones((len(vectors), 1))])

    def forward(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and embeddings."""
        layer = np.tanh(self._inputs(vectors) @ self.hidden)
        return 1 / (1 + np.exp(-np.clip(layer @ self.out[:-1] + self.out[-1], -30, 30))), layer

    def stepped(self, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float) -> Scorer:
        """After one step down the weighted log loss of a batch."""
        inputs = self._inputs(vectors)
        scores, layer = self.forward(vectors)
        error = (scores - labels) * weights / max(weights.sum(), 1e-12)
        back = np.outer(error, self.out[:-1]) * (1 - layer**2)
        out = self.out - rate * np.append(layer.T @ error, error.sum())
        return Scorer(self.columns, self.mean, self.scale, self.hidden - rate * (inputs.T @ back), out)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches of matrices with ``score`` and ``embedding`` added."""
        for pdf in batches:
            vectors = np.array([[v for column in row for v in pool(column)] for row in zip(*(pdf[c] for c in self.columns))]).reshape(len(pdf), len(self.mean))
            scores, layer = self.forward(vectors)
            yield pdf.assign(score=scores, embedding=list(layer))

    def score_vectors(self, vectors: DataFrame, vector: str = "vector") -> DataFrame:
        """Rows of ``pooled`` with ``score``."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(score=self.forward(np.array(pdf[vector].tolist()).reshape(len(pdf), len(self.mean)))[0])

        return vectors.mapInPandas(run, vectors.withColumn("score", F.lit(0.0)).schema)

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, **{k: getattr(self, k).tolist() for k in ("mean", "scale", "hidden", "out")}})

    @classmethod
    def from_json(cls, text: str) -> Scorer:
        found = json.loads(text)
        return cls(tuple(found["columns"]), *(np.array(found[k]) for k in ("mean", "scale", "hidden", "out")))


def vector_scale(vectors: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each element over all rows, one pass; a deviation of nothing counts as 1."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    if vectors.isEmpty():
        raise ValueError("no rows to train on")
    row = vectors.select(Summarizer.metrics("mean", "std").summary(array_to_vector(F.col(vector))).alias("s")).first()
    mean, scale = row.s["mean"].toArray(), row.s["std"].toArray()
    # the last bits of a sum depend on the order of its parts; rounded, a rerun starts alike
    return np.round(mean, 9), np.round(np.where(scale > 1e-9, scale, 1.0), 9)


def fit_pass(scorer: Scorer, vectors: DataFrame, key: list[str], rate: float, batch_size: int, tasks: int, epoch: int) -> Scorer:
    """One pass over ``vectors`` (key columns, vector, label, weight)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n = scorer, 0
        for pdf in batches:
            for low in range(0, len(pdf), batch_size):
                part = pdf.iloc[low : low + batch_size]
                now = now.stepped(np.array(part["vector"].tolist()), part["label"].to_numpy(float), part["weight"].to_numpy(float), rate)
            n += len(pdf)
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "hidden": [now.hidden.ravel()], "out": [now.out]})

    turn = random_int(F.concat_ws("/", *(F.col(k).cast("string") for k in key)), epoch)
    dealt = vectors.withColumn("_turn", turn).repartition(tasks, "_turn").sortWithinPartitions("_turn", *key).select("vector", "label", "weight")
    rows = sorted(dealt.mapInPandas(run, "part int, n long, hidden array<double>, out array<double>").collect())  # the weights of ``tasks`` tasks
    if not rows:
        raise ValueError("no rows to train on")
    total = sum(r.n for r in rows)
    average = lambda name, shape: sum(np.array(r[name]) * (r.n / total) for r in rows).reshape(shape)
    return Scorer(scorer.columns, scorer.mean, scorer.scale, average("hidden", scorer.hidden.shape), average("out", scorer.out.shape))
