"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct lower-cased words and their beginnings of
four and five bytes, each a 64-bit hash, with ``log(1 + count)`` as value. Spark
counts in how many labelled texts of each kind a feature occurs; the model takes
every feature of ``LEAST_TEXTS`` texts whose log odds ratio lies ``LEAST_Z``
standard errors from zero, on the toxic or on the harmless side.

The regression has one weight vector for all grades and ordered thresholds:
``P(grade <= k) = sigmoid(threshold_k - weights . x)``. The result is each
grade's probability, the expected grade, the likeliest grade, and a flag for
``P(grade >= 1) > 0.5``.

Grades come with the labels: any small whole numbers, 0 for harmless. Where the
labels have two classes only, toxic texts are graded 1, 2 or 3 by how many of
their words the *other* half of the labelled texts shows to be toxic (up to 2,
up to 5, more), so that no text is graded by what it taught itself.

Fitting uses at most about ``MOST_ROWS`` labelled texts, chosen by a hash of the
id; scoring covers every text. What the driver gets is bounded by them: a short
list of features a row, and the features that ``LEAST_TEXTS`` of them share.

Cases: null or empty texts have no features. Labels that are null or without a
text are left out; a repeated label counts with its greatest grade, and a labelled
id with several texts with one of them, the least by a hash. Without labels of
both kinds nothing is toxic. Rows that repeat are scored alike. Texts of any
length are read whole. An empty table gives an empty table. Columns with the
name of the output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asmlens.llm import _text as X
from asmlens.llm._spark import dropped, written

MOST_ROWS = 20_000
LEAST_TEXTS, LEAST_Z = 5, 3.5
GRADE_EDGES, GRADE_RATIO = (2, 5), 8.0

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    LETTER[_a:_b] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every word feature, in the order of words: three a word (shorter words repeat themselves)."""
    low = LOWER[data]
    gap = np.ones(len(low) + 2, bool)
    gap[1:-1] = ~LETTER[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~gap[1:-1] & (gap[:-2] | edge[:-1]))
    end = np.flatnonzero(~gap[1:-1] & (gap[2:] | edge[1:])) + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    h = X.RangeHash(low)
    three = np.stack([h(start, end), h(start, np.minimum(start + 4, end)) + np.uint64(4), h(start, np.minimum(start + 5, end)) + np.uint64(5)], 1)
    return text, three


@dataclass
class OrdinalModel:
    """Sorted feature hashes, their weights, and the ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(z[:, None] - self.thresholds[None, :], -500, 500)))
        below = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], 1)
        return np.diff(below, axis=1)


def counts(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and count of each of the model's features that occurs in a text."""
    text, three = features(data, offsets)
    if not len(keys) or not len(text):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(keys, three), len(keys) - 1)
    hit = keys[at] == three
    word, four, five = three[:, 0], three[:, 1] - np.uint64(4), three[:, 2] - np.uint64(5)
    hit[:, 1] &= four != word  # a short word is its own beginning
    hit[:, 2] &= (five != four) & (five != word)
    pair, count = np.unique(np.repeat(text[:, None], 3, 1)[hit] * len(keys) + at[hit], return_counts=True)
    return pair // len(keys), pair % len(keys), count


def fit_ordinal(rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log loss; gaps of thresholds are exponentials, so they stay ordered."""
    levels = int(grade.max())
    w, free = np.zeros(n_features), np.concatenate([[1.0], np.zeros(levels - 1)])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, free)]
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        cut = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(row, weights=w[feature] * value, minlength=rows)
        wide = np.concatenate([[-np.inf], cut, [np.inf]])
        up, down = sigmoid(wide[grade + 1] - z), sigmoid(wide[grade] - z)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        gz = (d_up - d_down) / rows
        gw = np.bincount(feature, weights=gz[row] * value, minlength=n_features) + decay * w
        gc = np.array([-(d_up[grade == k].sum() - d_down[grade == k + 1].sum()) / rows for k in range(levels)])
        tail = np.cumsum(gc[::-1])[::-1]
        gf = np.concatenate([[tail[0]], tail[1:] * gaps])
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        for (m, v), g, param in zip(moments, (gw, gf), (w, free)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, grade: str, most_rows: int) -> DataFrame:
    """Rows (grade, half, text): one text an id, of at most about ``most_rows`` ids."""
    marked = labels.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(grade).cast("int").alias("grade"))
    share = min(1.0, most_rows / max(marked.count(), 1))
    marked = marked.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    both = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(marked, "id")
    one = both.groupBy("id").agg(F.max("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return written(one.select("grade", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2)).cast("int").alias("half"), "text"), "labelled")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grade, half, text) to rows (h, word, half, t, n): in how many toxic and in how many texts a feature occurs."""
    for batch in batches:
        toxic, half = batch.column(0).to_numpy() > 0, batch.column(1).to_numpy()
        for row, offsets, data in X.texts(batch.column(2)):
            where, three = features(data, offsets)
            of, word = np.repeat(where[:, None], 3, 1).ravel(), np.tile([True, False, False], len(where))
            order = np.lexsort((~word, three.ravel(), of))
            h, of, word = three.ravel()[order], of[order], word[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, of, word = h[new], row + of[new], word[new]
            for part in (0, 1):
                own = half[of] == part
                keys, first, at = np.unique(h[own], return_index=True, return_inverse=True)
                t = np.bincount(at, weights=toxic[of[own]], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(word[own][first]), pa.array(np.full(len(keys), part, np.int32)), pa.array(t), pa.array(np.bincount(at, minlength=len(keys)))], names=["h", "word", "half", "t", "n"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "toxic", most_rows: int = MOST_ROWS) -> OrdinalModel:
    """A model from at most about ``most_rows`` labelled texts; ``grade`` names the labels' column of grades or of two classes."""
    sample = labelled(docs, labels, doc_id, text, grade, most_rows)
    sums = {(r["half"], r.bad): r["count"] for r in sample.groupBy("half", (F.col("grade") > 0).alias("bad")).count().collect()}
    size = lambda bad: sum(n for (_, b), n in sums.items() if b == bad)
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0, 21.0, 22.0]))
    if not size(True) or not size(False):
        return none
    halves = [*(F.sum(F.when(F.col("half") == k, F.col(c))).alias(f"{c}{k}") for c in ("t", "n") for k in (0, 1)), F.max("word").alias("word")]
    found = sample.mapInArrow(_seen, "h long, word boolean, half int, t long, n long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), *halves)
    rate = lambda t, n, bad, good: ((t + 0.5) / (bad - t + 0.5)) / ((n - t + 0.5) / (good - n + t + 0.5))  # noqa: E731  odds ratio
    t, n, bad, good = F.col("t"), F.col("n"), size(True), size(False)
    error = F.sqrt(1 / (t + 0.5) + 1 / (n - t + 0.5) + 1 / (bad - t + 0.5) + 1 / (good - n + t + 0.5))
    picked = found.where((n >= LEAST_TEXTS) & (F.abs(F.log(rate(t, n, bad, good))) >= LEAST_Z * error)).toPandas().fillna(0)
    if not len(picked):
        return none
    picked["h"] = picked["h"].to_numpy().view(np.uint64)
    picked = picked.sort_values("h")
    keys = picked["h"].to_numpy()

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in X.texts(batch.column(2)):
                n = len(offsets) - 1
                of, feature, count = counts(keys, data, offsets)
                ends = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (feature, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), *lists], names=["grade", "half", "f", "c"])

    rows = sample.mapInArrow(table, "grade int, half int, f array<int>, c array<int>").toPandas()  # one short row an id
    row = np.repeat(np.arange(len(rows)), rows["f"].map(len))
    feature = np.concatenate([*rows["f"], np.zeros(0)]).astype(np.int64)
    count = np.concatenate([*rows["c"], np.zeros(0)]).astype(np.int64)
    given, half = rows["grade"].to_numpy(), rows["half"].to_numpy()
    if given.max() == 1:
        telling = np.zeros((2, len(keys)), bool)  # words that the other half shows to be toxic
        for k in (0, 1):
            o = 1 - k
            t, n = (picked[f"{c}{o}"].to_numpy(float) for c in ("t", "n"))
            telling[k] = picked["word"].to_numpy(bool) & (t >= 2) & (rate(t, n, sums.get((o, True), 0), sums.get((o, False), 0)) >= GRADE_RATIO)
        words = np.bincount(row, weights=count * telling[half[row], feature], minlength=len(rows))
        given = np.where(given > 0, 1 + np.searchsorted(GRADE_EDGES, words, side="left"), 0)
    dropped(sample)
    w, cut = fit_ordinal(len(rows), row, feature, np.log1p(count), given, len(keys))
    return OrdinalModel(keys, w, cut)


SCORE = T.StructType([T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("expected_severity", T.DoubleType()), T.StructField("severity", T.IntegerType()), T.StructField("toxic", T.BooleanType())])


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column of grade probabilities, expected grade, likeliest grade and flag."""
    docs = docs.drop(into) if into.lower() in [c.lower() for c in docs.columns] else docs
    at, names = docs.columns.index(text), [*docs.columns, into]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each feature that LEAST_TEXTS labelled texts share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for row, offsets, data in X.texts(batch.column(at)):
                of, feature, count = counts(m.keys, data, offsets)
                z[row : row + len(offsets) - 1] = np.bincount(of, weights=m.weights[feature] * np.log1p(count), minlength=len(offsets) - 1)
            p = m.probabilities(z)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            made = [lists, pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)), pa.array(p[:, 0] < 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(made, names=SCORE.names)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, SCORE)]))


def op3_toxicity_ordinal(spark, sf_dir: str) -> DataFrame:
    """Every document with its severity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("toxicity")
    return score(docs, model).select("doc_id", s["expected_severity"].alias("expected_severity"), s["severity"].alias("severity"), s["toxic"].alias("toxic"), (1 - s["probabilities"][0]).alias("p_toxic"))
