import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asmlens.operators import modelling as M
from asmlens.operators import scoring as C
from asmlens.plans.analysis import evaluate
from asmlens.plans.training import train, training_rows

META = "sample string, contig string, length int, misassembly_cnt int, avg_coverage double, breakpoints array<struct<lo:int,hi:int>>"
COLUMNS = ["coverage", "mapq"]


@pytest.fixture(scope="module")
def planted(spark):
    """240 contigs of 300 to 900 bases; coverage falls around the breakpoint of a misassembled one."""
    dice, meta, rows = np.random.default_rng(5), [], []
    for k in range(240):
        n, bad = int(dice.integers(300, 900)), k % 4 == 0
        at = int(dice.integers(120, n - 120))
        meta.append((f"s{k % 2}", f"contig_{k:04d}", n, int(bad), 5.0, [(at, at + 2)] if bad else []))
        x = np.arange(n)
        coverage = dice.normal(0, 1, n) - (4.0 * (np.abs(x - at) < 40) if bad else 0)
        mapq = np.where(dice.random(n) < 0.02, np.nan, dice.normal(0, 1, n))
        rows.append(pd.DataFrame({"sample": f"s{k % 2}", "contig": f"contig_{k:04d}", "position": x, "coverage": coverage, "mapq": mapq}))
    features = spark.createDataFrame(pd.concat(rows)).withColumn("mapq", F.when(~F.isnan("mapq"), F.col("mapq")))
    return spark.createDataFrame(meta, META).cache(), features.repartition(4, "contig").cache()


def run(planted, n_epochs=16, **more):
    return train(*planted, COLUMNS, n_epochs=n_epochs, max_len=400, translations=2, eval_percent=25, rate=0.1, batch_size=16, tasks=3, **more)


def test_training_finds_a_planted_signal_and_reruns_alike(planted):
    scorer, epochs = run(planted)
    rows = epochs.orderBy("epoch").collect()
    assert [r.epoch for r in rows] == list(range(2, 17, 2))
    (best,) = [r for r in rows if r.best]
    assert best.ap == max(r.ap for r in rows) > 0.8  # a quarter is misassembled
    for before, now, after in zip(rows, rows[1:], rows[2:]):
        fell = now.epoch > 10 and now.ap < before.ap
        assert after.rate == pytest.approx(now.rate * (0.8 if fell else 1))
    first, epochs_first = run(planted, 4)
    again, epochs_again = run(planted, 4)
    assert [tuple(r)[:-1] for r in epochs_again.orderBy("epoch").collect()] == [tuple(r)[:-1] for r in epochs_first.orderBy("epoch").collect()] == [tuple(r)[:-1] for r in rows[:2]]
    assert np.array_equal(again.hidden, first.hidden) and np.array_equal(again.out, first.out)
    # the fitted model is a model for the evaluation workflow, with embeddings
    meta, features = planted
    plain = {(r.sample, r.contig): r.score for r in evaluate(meta, features, scorer, COLUMNS, max_len=400, min_len=0).collect()}
    assert len(plain) == 240
    kept = M.Scorer.from_json(scorer.to_json())
    some = evaluate(meta, features, kept, COLUMNS, max_len=400, min_len=0, embeddings=30).collect()
    assert len(some) == 30
    for r in some:
        assert r.score == pytest.approx(plain[r.sample, r.contig]) == r.max and r.min <= r.mean <= r.max
        vector = [float(v) for v in r.embedding.split("|")]
        assert len(vector) == 16 and all(abs(v) <= 1 for v in vector)


def test_given_ids_are_held_out(planted):
    meta, _ = planted
    held = meta.where("contig < 'contig_0060'")
    _, epochs = run(planted, 4, eval_ids=held)
    assert max(r.ap for r in epochs.collect()) > 0.7
    meta, features = planted
    listed = evaluate(meta, features, C.mean_logistic({"coverage": 1.0}), ["coverage"], max_len=400, min_len=0, eval_ids=held)
    assert listed.count() == 60


def test_windows_and_classes_change_by_epoch(planted):
    meta = planted[0].withColumn("_id", F.concat_ws("/", "sample", "contig"))
    first, second = ({(r.contig, r.translation): (r.start_idx, r.end_idx) for r in training_rows(meta, 0.5, 400, e, 3, 10, key="_id").collect()} for e in (0, 1))
    assert first.keys() != second.keys() and sum(k in second and second[k] != v for k, v in first.items()) > 30
    one = {k: v for k, v in first.items() if k[0] == "contig_0000"}
    assert len(one) == 3
    meta = {r.contig: r for r in planted[0].collect()}
    for (contig, _), (low, high) in first.items():
        r = meta[contig]
        assert 0 <= low < high <= r.length and high - low <= 400
        for b in r.breakpoints:
            assert low <= b.lo and b.hi <= high


def test_steps_follow_the_gradient():
    dice = np.random.default_rng(1)
    s = M.Scorer.start(["a"], np.zeros(5), np.ones(5), 3, 1)
    x, y, w = dice.normal(size=(20, 5)), dice.integers(0, 2, 20).astype(float), dice.random(20)

    def loss(m):
        p, _ = m.forward(x)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    step = s.stepped(x, y, w, 1e-6)
    slope = sum(((a - b) ** 2).sum() for a, b in ((step.hidden, s.hidden), (step.out, s.out))) / 1e-6
    assert (loss(s) - loss(step)) == pytest.approx(slope, rel=1e-3)


def test_pool_values():
    assert M.pool([]) == [0.0] * 5 == M.pool([math.nan])
    assert M.pool([2.0, math.nan]) == [2.0, 0.0, 2.0, 2.0, 0.0]
    assert M.pool([0.0] * 70 + [8.0] * 10) == pytest.approx([1.0, np.std([0.0] * 70 + [8.0] * 10), 0.0, 8.0, 7.0])


def test_nothing_to_train_on(spark, planted):
    meta, features = planted
    with pytest.raises(ValueError, match="no rows"):
        train(meta.where("length < 0"), features, COLUMNS, n_epochs=2, max_len=400)
