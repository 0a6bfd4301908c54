import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asmlens.operators import metrics as E
from asmlens.operators import misassembly as M
from asmlens.operators import ordered as O
from asmlens.operators import scoring as C

RECORD = "contig string, type string, start long, end long"


def test_long_intervals_cost_a_few_rows(spark):
    whole = spark.createDataFrame([("c", "inversion", 1, 50_000_000), ("c", "relocation", 7, 7), ("c", "relocation", 999, 1001)], RECORD)
    assert M.binned(whole, "start", "end", 1000).count() <= 6


@pytest.mark.parametrize("seed", range(3))
def test_interval_join_and_labels_equal_brute_force(spark, seed):
    dice = random.Random(seed)
    kinds = ["relocation", "translocation", "inversion", "interspecies translocation"]
    records = [("hot", "inversion", 1, 400_000), ("hot", "relocation", 1, 400_000), (None, "inversion", 3, 9)]
    for _ in range(60):
        low = dice.randrange(1, 400_000)
        records.append((dice.choice(["hot", "x", "y"]), dice.choice(kinds), low, low + dice.choice([-5, 0, 10, 999, 1000, 5000, 70_000])))
    points = [(dice.choice(["hot", "x", "y", "z"]), p) for p in range(0, 420_000, 1777)] + [("hot", 399_999), ("hot", 400_000), ("hot", 0)]
    df, at = spark.createDataFrame(records, RECORD), spark.createDataFrame(points, "contig string, position long")
    for width in (10, 1000):
        got = sorted((r.contig, r.position, r.type, r.start, r.end) for r in M.interval_join(at, df, width).collect())
        assert got == sorted((c, p, t, s, e) for c, p in points for k, t, s, e in records if k == c and s <= p + 1 <= e)
        labels = sorted((r.contig, r.position, r.by_pos, r.misassembled) for r in M.label_positions(at, df, width).collect())
        types = lambda c, p: ",".join(sorted({t for k, t, s, e in records if k == c and s <= p + 1 <= e})) or "None"
        assert labels == sorted((c, p, types(c, p), int(any(k == c for k, *_ in records))) for c, p in points)


def greedy(chunks, most, batch_size):
    out, batch, contigs, total = [], 0, 0, 0
    for k, n in enumerate(chunks):
        if k and (contigs > batch_size or total + n > most):
            batch, contigs, total = batch + 1, 0, 0
        contigs, total = contigs + 1, total + n
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_by_cuts_equals_the_greedy_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(O, "ROWS", 50)
    dice = random.Random(seed)
    shards = {"long": 400, "longer": 700, None: 90, "short": 5}
    rows = [(s, k, dice.choice([1, 1, 2, 9, 40])) for s, n in shards.items() for k in range(n)]
    df = spark.createDataFrame(dice.sample(rows, len(rows)), "shard string, contig long, n_chunks int")
    size, most = dice.choice([(3, 20), (1000, 50), (0, 1000), (5, 4)])
    row_bytes = 10 * (10 + 4 * 2)
    got = {(r.shard, r.contig): r.batch for r in C.memory_batches(df, most * row_bytes + 3, size, 10, 2, "shard", ["contig"], stream=50).collect()}
    streamed = {(r.shard, r.contig): r.batch for r in C.memory_batches(df, most * row_bytes + 3, size, 10, 2, "shard", ["contig"]).collect()}
    want = {}
    for s, n in shards.items():
        mine = sorted((k, c) for t, k, c in rows if t == s)
        want |= {(s, k): b for (k, _), b in zip(mine, greedy([c for _, c in mine], most, size))}
    assert got == streamed == want


def test_exact_rank_sum_equals_enumeration():
    for n1, n2 in itertools.product(range(1, 8), range(1, 8)):
        sums = sorted(sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1))
        for w in {sums[0], sums[-1], sums[len(sums) // 2], sums[len(sums) // 3]}:
            tail = np.mean([u <= w for u in sums] if w <= n1 * n2 / 2 else [u >= w for u in sums])
            assert E.exact_rank_sum_p(w, n1, n2) == pytest.approx(min(1, 2 * tail), rel=1e-9)


def test_rank_sum_is_exact_for_small_groups_without_ties(spark):
    rows = [("small", "a", v) for v in (1.0, 2.5, 4.0)] + [("small", "b", v) for v in (3.0, 5.0, 6.0, 7.0)]
    rows += [("tied", g, 1.0) for g in "aab"] + [("large", "ab"[k % 2], float(k * 7919 % 1009)) for k in range(200)]
    got = {r.k: r for r in E.rank_sum_test(spark.createDataFrame(rows, "k string, g string, value double"), "g", "a", by=["k"]).collect()}
    assert got["small"].w == 1.0 and got["small"].p_value == pytest.approx(2 * 2 / 35)
    assert got["large"].p_value == pytest.approx(2 * E_tail(abs(got["large"].z)), abs=1e-6) and got["tied"].w == 1.0


def E_tail(z):
    from math import erfc, sqrt

    return erfc(z / sqrt(2)) / 2


def test_interpolated_pr_area_equals_a_fine_sum(spark):
    dice = random.Random(4)
    rows = [(round(dice.random(), 1), int(dice.random() < 0.3)) for _ in range(400)]
    got = E.pr_area(spark.createDataFrame(rows, "score double, label int"), interpolate=True).first().pr_area
    pos, tp, fp, area = sum(y for _, y in rows), 0.0, 0.0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        d, n = sum(y for x, y in rows if x == s), sum(1 - y for x, y in rows if x == s)
        x = (np.arange(20_000) + 0.5) / 20_000 * d
        if d:
            area += ((tp + x) / (tp + x + fp + n * x / d)).mean() * d / pos
        tp, fp = tp + d, fp + n
    assert got == pytest.approx(area, abs=1e-6)
    perfect = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0)], "score double, label int")
    assert E.pr_area(perfect, interpolate=True).first().pr_area == 1.0
