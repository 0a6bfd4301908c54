"""Random choices with text keys, samples kept apart, and workflows on text alignments."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from asmlens.functions.columns import random_int
from asmlens.operators import metrics as E
from asmlens.operators import misassembly as M
from asmlens.operators import ordered as O
from asmlens.operators import relational as R
from asmlens.operators import sampling as S
from asmlens.operators import scoring as C
from asmlens.operators import training as T
from asmlens.plans.analysis import evaluate
from asmlens.plans.features import extract_features
from asmlens.sources import readers


def number(key, seed=0):
    return int(hashlib.md5(f"{key}#{seed}".encode()).hexdigest()[:8], 16) & 0x7FFFFFFF


def test_random_int_is_a_digest_of_any_key(spark):
    rows = spark.createDataFrame([("read/1",), ("7",), ("",)], "k string").select("k", random_int("k", 3).alias("r")).collect()
    assert all(r.r == number(r.k, 3) for r in rows)
    assert spark.range(7, 8).select(random_int("id", 3).alias("r")).first().r == number("7", 3)
    low = spark.range(4000).select((random_int("id") % 2).alias("b")).agg(F.avg("b").alias("a")).first().a
    assert 0.46 < low < 0.54  # the low bits are no longer those of the key


def test_text_keys_everywhere(spark):
    meta = spark.createDataFrame([(f"c/{k}", 3000 + k, int(k % 3 == 0), f"g{k % 4}", 0.1 * (k % 10)) for k in range(200)], "contig string, length int, label int, grp string, score double")
    bps = F.when(F.col("label") == 1, F.array(F.struct(F.lit(900).alias("lo"), F.lit(950).alias("hi")))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    meta = meta.withColumn("breakpoints", bps)
    assert 30 < S.contig_frac(meta, 0.3).count() < 90
    assert S.sample_n_reads(meta, 20, key="contig").count() == 20
    assert {r.split for r in T.train_eval_split(meta, eval_percent=30).collect()} == {"train", "eval"}
    assert T.class_downsample(meta, 0.5).where("label = 0").count() == 66
    windows = T.select_training_interval(meta, 2500).collect()
    assert all(r.end_idx - r.start_idx <= 2500 and (not r.label or r.start_idx <= 900 and r.end_idx >= 950) for r in windows)
    chunks = M.select_breakpoint_chunk(meta).collect()
    assert len(chunks) == 200 and all(r.chunk_end - r.chunk_start == 500 for r in chunks)
    assert {r.label for r in T.random_labels(meta.drop("label")).collect()} == {0, 1}
    assert C.sample_for_embeddings(meta, 9).count() == 9
    assert R.random_per_group(meta, ["grp"], 5, "contig").count() == 20 and R.random_rows(meta, 7, "contig").count() == 7
    assert 4 <= R.random_cap_per_group(meta, "grp", "contig", 10).count() <= 40
    assert R.group_split(meta, "grp", {"a": 50}).count() == 200


def test_cap_coverage_matches_one_ordered_pass(spark, monkeypatch):
    monkeypatch.setattr(S, "BIN_READS", 7)
    rng = np.random.default_rng(3)
    reads = [(f"r{k}/1", f"c{int(rng.integers(0, 3))}", int(rng.integers(-400, 400)), "A" * int(rng.integers(20, 60))) for k in range(400)]
    aln = spark.createDataFrame(reads, "read_id string, contig string, tlen int, seq string")
    contigs = spark.createDataFrame([(f"c{k}", 300 + 900 * k) for k in range(3)], "contig string, length int")
    got = {(r.read_id, round(r.cov, 9)) for r in S.cap_coverage(aln, contigs, 5, 350, 2).collect()}
    want = set()
    for k in range(3):
        so_far = 0
        for name, contig, tlen, seq in sorted(reads, key=lambda r: number(r[0], 2)):
            if contig == f"c{k}" and abs(tlen) <= 350:
                so_far += len(seq)
                if so_far / (300 + 900 * k) < 5:
                    want.add((name, round(so_far / (300 + 900 * k), 9)))
    assert got == want


def test_labels_of_one_sample_do_not_reach_another(spark):
    positions = spark.createDataFrame([(s, c, p) for s in ("s1", "s2") for c in ("a", "b") for p in range(30)], "sample string, contig string, position int")
    records = spark.createDataFrame([("s1", "a", "relocation", 5, 12), ("s1", "a", "relocation", 10, 15), ("s1", "a", "inversion", 11, 11), ("s2", "b", "novel", 1, 3)], "sample string, contig string, type string, start int, end int")
    for width in (4, 1000):
        rows = M.label_positions(positions, records, width).collect()
        assert len(rows) == 120
        for r in rows:
            hits = [(t, a, b) for s, c, t, a, b in (tuple(x) for x in records.collect()) if (s, c) == (r.sample, r.contig) and a <= r.position + 1 <= b]
            kinds = sorted({t for t, _, _ in hits})
            assert r.by_pos == (",".join(kinds) or "None") and r.misassembled == int((r.sample, r.contig) in {("s1", "a"), ("s2", "b")})
            assert r["mask"] == ("relocation" in kinds) + 4 * ("inversion" in kinds)
        joined = M.interval_join(positions, records, width).collect()
        assert len(joined) == sum(max(0, b - a + 1) for a, b in ((5, 12), (10, 15), (11, 11), (1, 3)))
    assert {(r.sample, r.contig, r.label) for r in M.contig_label(positions.select("sample", "contig").distinct(), records).collect()} == {("s1", "a", 1), ("s1", "b", 0), ("s2", "a", 0), ("s2", "b", 1)}


def test_features_of_text_alignments(spark, tmp_path):
    lines = ["@HD\tVN:1.6"] + [f"read/{k}\t0\tc1\t{1 + k % 40}\t30\t10M\t=\t0\t{100 + k}\t{'ACGTACGTAC'}\t{'I' * 10}\tAS:i:-3" for k in range(60)]
    (tmp_path / "s.sam").write_text("\n".join(lines) + "\n")
    aln = readers.read_alignments_text(spark, str(tmp_path / "s.sam")).drop("tags", "sample")
    contigs = spark.createDataFrame([("c1", "ACGT" * 15, 60)], "contig string, seq string, length int")
    got = extract_features(aln, contigs, spark.createDataFrame([("c1", "relocation", 3, 9)], "contig string, type string, start int, end int"), max_coverage=5).collect()
    assert len(got) == 60 and 0 < max(r.coverage for r in got) and sum(r.coverage for r in got) <= 5 * 60
    assert [r.Extensive_misassembly_by_pos for r in sorted(got, key=lambda r: r.position)][1:10] == ["None"] + ["relocation"] * 7 + ["None"]


def test_evaluate_keeps_samples_apart_and_checks_insert_sizes(spark):
    meta = spark.createDataFrame([(s, "c", 1200, 9.0) for s in ("s1", "s2")], "sample string, contig string, length int, avg_coverage double")
    features = spark.createDataFrame([(s, "c", p, v + p % 2, 300.0) for s, v in (("s1", 1.0), ("s2", 5.0)) for p in range(1200)], "sample string, contig string, position int, coverage double, mean_insert_size_Match double")
    got = {r["sample"]: r.score for r in evaluate(meta, features, C.mean_logistic({"coverage": 1.0}), ["coverage"], max_len=500, verify_percent=100).collect()}
    assert abs(got["s1"] - 1 / (1 + np.exp(-1.5))) < 1e-9 and abs(got["s2"] - 1 / (1 + np.exp(-5.5))) < 1e-9
    far = features.withColumn("mean_insert_size_Match", F.lit(900.0))
    try:
        evaluate(meta, far, C.mean_logistic({"coverage": 1.0}), ["coverage"], verify_percent=100)
        raise AssertionError("the gate let it through")
    except ValueError as e:
        assert "insert sizes" in str(e)


def isotonic(points):
    """Pool adjacent violators: sorted scores with weights to fitted values."""
    pools = []
    for x, y, w in points:
        pools.append([x, x, y, w])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    return pools


def test_isotonic_calibration_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{k}", 5000, int(rng.random() < 0.2 + 0.06 * s), round(float(0.05 + 0.09 * s), 3)) for k in range(60) for s in rng.integers(0, 10, 5)]
    label = {c: y for c, _, y, _ in rows}
    rows = [(c, n, label[c], s) for c, n, _, s in rows]
    df = spark.createDataFrame(rows, "contig string, length int, label int, score double")
    got = {r.contig: r.score for r in C.isotonic_calibration(df).collect()}
    fit = [r for r in rows if number(r[0]) % 2 == 0]
    rest = [r for r in rows if number(r[0]) % 2]
    assert {r[2] for r in fit} == {0, 1} and set(got) == {r[0] for r in rest}
    points = sorted({r[3] for r in fit})
    pools = isotonic([(x, np.mean([r[2] for r in fit if r[3] == x]), sum(r[3] == x for r in fit)) for x in points])
    xs, ys = zip(*[(x, p[2]) for p in pools for x in sorted({p[0], p[1]})])
    want = {}
    for c, _, _, s in rest:
        want[c] = want.get(c, 1.0) * (1 - np.interp(s, xs, ys))
    for c in got:
        assert abs(got[c] - (1 - want[c])) < 1e-6


def test_scorer_beats_chance_on_held_out_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(k % 4 == 0), float(rng.normal(k % 4 == 0)), float(rng.normal())) for k in range(800)]
    split = T.train_eval_split(spark.createDataFrame(rows, "contig long, label int, a double, b double"), eval_percent=30)
    model, found = C.fit_scorer(split.where("split = 'train'"), split.where("split = 'eval'"), ["a", "b"])
    assert len(found) == 2 and max(found) > 0.4  # a quarter of the rows are positive
    assert {r.prediction for r in model.transform(split.where("split = 'eval'")).select("prediction").distinct().collect()} <= {0.0, 1.0}


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(0, 40)), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, x double, v long").groupBy("g", "x").agg(F.sum("v").alias("v"))
    for down in (False, True):
        for r in O.running_sums(df, ["g"], ["-x" if down else "x"], {"s": "v"}).collect():
            assert r.s == sum(v for g, x, v in rows if g == r.g and (x >= r.x if down else x <= r.x))
    names = spark.createDataFrame([(f"n{k % 5}", f"name {k * 7919 % 1000:04d}x") for k in range(400)], "g string, name string")
    got = O.numbered(names, ["g"], ["name"], "k").collect()
    for g in {r.g for r in got}:
        own = sorted(r.name for r in got if r.g == g)
        assert all(own[r.k - 1] == r.name for r in got if r.g == g)
    empty = spark.createDataFrame([], "score double, label int")
    assert E.average_precision(empty).collect()[0].average_precision is None
