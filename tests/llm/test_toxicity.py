import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from asmlens.llm import toxicity as X


def test_held_out_accuracy_grades_and_cases(spark, documents):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    bad = ["zzidiot", "zzscum", "qqtrash"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        text = [word() for _ in range(80)]
        for _ in range(1 + k % 8 if toxic else 0):
            text.insert(int(rng.integers(0, 80)), str(rng.choice(bad)) + (word()[:2] if k % 3 else ""))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "zzidiot"), (1002, "zzidiot"), (1003, "ZZIDIOT, zzscum! " * 20)]
    docs = documents(rows)
    table = spark.createDataFrame(labels[:300] + [(None, 1, 1), (5000, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = X.fit(docs, table)
    assert (np.diff(model.thresholds) > 0).all()
    got = X.score(docs.withColumnRenamed("n_chars", "toxicity"), model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if 300 <= r.doc_id < 600]
    assert np.mean([r.toxicity.toxic == (r.doc_id % 4 == 0) for r in held]) > 0.97
    by = {r.doc_id: r.toxicity for r in got}
    assert not by[1000].toxic and not by[1001].toxic and by[1003].toxic
    assert by[1003].expected_severity > by[1002].expected_severity > by[1001].expected_severity
    for r in got:
        assert abs(sum(r.toxicity.probabilities) - 1) < 1e-9


def test_without_labels_nothing_is_toxic(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxicity.toxic for r in X.score(docs, X.fit(docs, none)).collect()] == [False, False]
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.toxicity.toxic for r in X.score(docs, X.fit(docs, one)).collect()] == [False, False]
    assert X.score(docs.where("doc_id < 0"), X.fit(docs, none)).count() == 0


def test_gradient_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.random(2000) * 4
    grade = np.searchsorted([1.0, 2.0, 3.0], x + rng.normal(0, 0.1, 2000))
    w, cut = X.fit_ordinal(2000, np.arange(2000), np.zeros(2000, int), x, grade, 1)
    assert w[0] > 2 and np.allclose(cut / w[0], [1, 2, 3], atol=0.2)


def brute_features(text):
    """Distinct features of one text with their counts, as strings."""
    out = collections.Counter()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()):
        out[w] += 1
        for n, mark in ((4, b"4:"), (5, b"5:")):
            if len(w) > n:
                out[mark + w[:n]] += 1
    return out


def hashed(name):
    start, salt = (2, int(name[:1])) if name[1:2] == b":" else (0, 0)
    data = np.frombuffer(name[start:], np.uint8)
    return int(X.X.RangeHash(data)(np.array([0]), np.array([len(data)]))[0] + np.uint64(salt))


def graded(n=500):
    """Texts with external grades: harmful words raise them, a kind word lowers them."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(n):
        text = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(30)]
        grade = int(rng.integers(0, 4)) if k % 2 else 0
        text += ["vilevile"] * grade + ["gentle"] * int(grade == 0 and k % 3 > 0)
        rows.append((k, " ".join(rng.permutation(text))))
        labels.append((k, grade))
    return rows, labels


def test_scores_match_brute_force_with_external_grades_and_harmless_features(spark, documents):
    rows, labels = graded()
    rows += [(600, "VILEVILE vilevile! x"), (601, "gentle " * 5), (602, None), (603, "vilevile " * 150_000), (600, "VILEVILE vilevile! x")]
    table = spark.createDataFrame(labels, "doc_id long, severity int")
    docs = documents(rows).withColumn("toxicity", F.lit("clash"))
    model = X.fit(docs, table, grade="severity")
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    weight = dict(zip(model.keys.tolist(), model.weights))
    assert weight[hashed(b"vilevile")] > 0 > weight[hashed(b"gentle")]
    # the same features are picked by counting in plain Python
    found = {k: brute_features(t) for k, t in rows if k < 500}
    bad = [k for k, g in labels if g]
    good = [k for k, g in labels if not g]
    for name in {f for c in found.values() for f in c}:
        t, n = sum(name in found[k] for k in bad), sum(name in found[k] for k in bad + good)
        odds = ((t + 0.5) / (len(bad) - t + 0.5)) / ((n - t + 0.5) / (len(good) - n + t + 0.5))
        error = math.sqrt(1 / (t + 0.5) + 1 / (n - t + 0.5) + 1 / (len(bad) - t + 0.5) + 1 / (len(good) - n + t + 0.5))
        assert (hashed(name) in weight) == (n >= X.LEAST_TEXTS and abs(math.log(odds)) >= X.LEAST_Z * error), name
    out = X.score(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        z = sum(weight.get(hashed(f), 0.0) * math.log1p(c) for f, c in brute_features(r.text).items())
        below = [1 / (1 + math.exp(z - c)) for c in model.thresholds]
        p = np.diff([0.0, *below, 1.0])
        assert np.allclose(r.toxicity.probabilities, p, atol=1e-9)
        assert abs(r.toxicity.expected_severity - p @ np.arange(4)) < 1e-9 and r.toxicity.severity == p.argmax() and r.toxicity.toxic == (p[0] < 0.5)
    right = np.mean([abs(r.toxicity.expected_severity - dict(labels)[r.doc_id]) < 0.7 for r in out if r.doc_id < 500])
    assert right > 0.9


def test_repeated_ids_stay_bounded(spark, documents):
    rows, labels = graded(200)
    docs = documents(rows + [(7, f"text number {k}") for k in range(300)])
    sample = X.labelled(docs, spark.createDataFrame(labels + [(7, 2), (7, 1)], "doc_id long, toxic int"), "doc_id", "text", "toxic", 1000)
    assert sample.count() == 200
    few = X.labelled(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", 50)
    assert 20 <= few.count() <= 90
