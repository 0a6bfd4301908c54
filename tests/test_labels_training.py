import pytest
from pyspark.sql import functions as F

from asmlens.operators import metrics as E
from asmlens.operators import misassembly as M
from asmlens.operators import sampling as S
from asmlens.operators import scoring as C
from asmlens.operators import stats as N
from asmlens.operators import training as R

CASES = [
    ("inversion", "1 467 and 551 458", [(458, 551, 458, 467)]),
    ("inversion", "12494 8289 and 12400 15339", [(8289, 12494, 12400, 12494)]),
    ("inversion", "1 467 and 551 498", [(498, 551, 467, 498)]),
    ("inversion", "12494 8289 and 12550 15339", [(8289, 12494, 12494, 12494)]),
    ("relocation", "568 808 and 787 1924", [(568, 1924, 787, 808)]),
    ("relocation", "607 6 and 4714 1516", [(6, 607, 607, 607), (1516, 4714, 1516, 1516)]),
    ("translocation", "1 35306 and 35286 35922", [(1, 35922, 35286, 35306)]),
    ("interspecies translocation", "1 30794 and 31583 30771", [(1, 31583, 30771, 30794)]),
]


@pytest.mark.parametrize("style", ["( {} )", "({})", "({}, inconsistency = -7779)"])
def test_parse_misassembly(spark, style):
    rows = [(str(k), f"Extensive misassembly {style.format(kind)} between {where}") for k, (kind, where, _) in enumerate(CASES)]
    got = M.parse_misassembly(spark.createDataFrame(rows, "contig string, line string")).orderBy("contig", "part").collect()
    assert [(int(r.contig), r.type, r.start, r.end, r.break_start, r.break_end) for r in got] == [(k, kind, *x) for k, (kind, _, want) in enumerate(CASES) for x in want]


def test_inverted_flag_goes_with_its_interval(spark):
    rows = [("c", "Extensive misassembly (inversion) between 900 800 and 1 100")]
    r = M.parse_misassembly(spark.createDataFrame(rows, "contig string, line string")).first()
    assert (r.start, r.end, r.break_start) == (800, 900, 800)


def test_mirror_strand(spark):
    rows = [("c", 1000, "Extensive misassembly (relocation) between 100 1 and 500 600")]
    got = M.parse_misassembly(spark.createDataFrame(rows, "contig string, length int, line string"), strand="mirror", length="length").orderBy("part").collect()
    assert [(r.start, r.end) for r in got] == [(500, 600), (901, 1000)]


def test_label_bits_and_bounds(spark):
    rec = spark.createDataFrame([("c", "inversion", 3, 5), ("c", "relocation", 5, 5), ("c", "interspecies translocation", 1, 1)], "contig string, type string, start int, end int")
    pos = spark.createDataFrame([("c", p) for p in range(7)] + [("d", 0)], "contig string, position int")
    got = {(r.contig, r.position): r for r in M.label_positions(pos, rec, bin_width=2).collect()}
    assert [got["c", p].mask for p in range(7)] == [8, 0, 4, 4, 5, 0, 0]
    assert got["c", 4].by_pos == "inversion,relocation" and got["c", 5].by_pos == "None"
    assert got["d", 0].misassembled == 0 and got["c", 6].misassembled == 1 and len(got) == 8


def test_breakpoint_histogram_keeps_the_last_bin(spark):
    df = spark.createDataFrame([(1000, 1000, 1000)], "lo int, hi int, length int")
    got = {(r.kind, r.bin): r.n for r in M.breakpoint_histograms(df).collect() if r.n}
    assert got == {("end", 0): 2, ("relative", 19): 1, ("relative", 0): 1}


def test_breakpoint_chunks_hold_their_break(spark):
    rows = [(k, 300 + 40 * k, [(100 + 3 * k, 110 + 3 * k)]) for k in range(60)] + [(99, 5000, [])]
    df = spark.createDataFrame(rows, "contig long, length int, breakpoints array<struct<lo:int,hi:int>>")
    for seed in range(3):
        for r in M.select_breakpoint_chunk(df, seed=seed).collect():
            n = 300 + 40 * r.contig if r.contig != 99 else 5000
            assert 0 <= r.chunk_start < r.chunk_end <= n and r.chunk_end - r.chunk_start == min(500, n)
            assert r.contig == 99 or 0 <= r.lo < 500


def test_training_intervals(spark):
    df = spark.createDataFrame([(k, 1000, b) for k in range(50) for b in ([], [(100, 100)], [(800, 900)])], "contig long, length int, breakpoints array<struct<lo:int,hi:int>>")
    bounds = {None: (0, 500), 100: (0, 50), 800: (450, 500)}
    for r in R.select_training_interval(df, 500, seed=3).collect():
        lo, hi = bounds[r.breakpoints[0].lo if r.breakpoints else None]
        assert lo <= r.start_idx <= hi and r.end_idx == r.start_idx + 500


def test_conv_lengths(spark):
    # a padded first layer shrinks by kernel - 1; kernels of one change nothing
    df = spark.createDataFrame([(100,)], "n int")
    layers = [{"kernel": 10}, {"kernel": 1, "stride": 2}, {"kernel": 5, "stride": 2, "padding": "same"}]
    r = df.select(R.conv_output_length("n", layers, True).alias("a"), R.conv_output_length("n", layers, False).alias("b")).first()
    assert (r.a, r.b) == (46, 44)


def test_weights_chunks_and_groups(spark):
    assert spark.range(1).select(R.length_weight(F.lit(500), 1000).alias("w")).first().w == 0.25
    count = lambda n, w, s: spark.range(1).select(C.chunk_count(F.lit(n), w, s).alias("c")).first().c
    assert (count(500, 50, 30), count(1000, 500, 250), count(10, 50, 30)) == (16, 3, 1)
    df = spark.createDataFrame([("c", 12000)], "contig string, length int")
    assert [(r.chunk_start, r.chunk_end) for r in C.evaluation_chunks(df, 6000).orderBy("chunk").collect()] == [(0, 6000), (5500, 11500), (7000, 12000)]
    scores = spark.createDataFrame([("c", 0, 0.2), ("c", 1, 0.6), ("c", 2, 0.8), ("d", 0, 0.5)], "contig string, chunk int, score double")
    take = lambda m: {r.contig: round(r.score, 6) for r in C.group_scores(scores, ["contig"], m, ["chunk"]).collect()}
    assert take("max") == {"c": 0.8, "d": 0.5} and take("sma") == {"c": 0.7, "d": 0.5} and take("noisy_or") == {"c": 0.936, "d": 0.5}


def test_memory_batches(spark):
    df = spark.createDataFrame([("s", k, n) for k, n in enumerate([1, 1, 5, 1, 1])], "shard string, contig int, n_chunks int")
    got = C.memory_batches(df, 6 * 100 * 14, 10, 100, 1, "shard", ["contig"]).orderBy("contig").collect()
    assert [r.batch for r in got] == [0, 0, 1, 1, 2]


def test_downsample_counts(spark):
    df = spark.range(1000).select(F.col("id").alias("contig"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = R.class_downsample(df, 0.3, translations=2, epoch=1)
    assert got.where("label = 1").count() == 200 and got.where("label = 0").count() == 2 * 270
    assert R.class_downsample(df, 0.3, epoch=1).exceptAll(R.class_downsample(df, 0.3, epoch=1)).isEmpty()


def test_normalizer_and_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "a double, b double")
    norm = N.merge_stats(N.sufficient_stats(df, [], ("a", "b")), ("a", "b"))
    r = norm.first()
    assert (r.a_mean, r.a_stdev, r.b_stdev) == (2.0, 1.0, 0.0)
    assert [tuple(x) for x in N.zscore(df, norm, ("a", "b", "c")).collect()] == [(-1.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    assert [x.b for x in N.zscore(df, norm, ("b",), fill_low_stdev=False).collect()] == [0.0, 0.0, None]


def test_average_precision_against_brute_force(spark):
    rows = [((k * 7919) % 13 / 13, int(k % 3 == 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "score double, label int")
    cuts, pos, ap, last = sorted({s for s, _ in rows}, reverse=True), sum(y for _, y in rows), 0.0, 0.0
    for c in cuts:
        tp, n = sum(y for s, y in rows if s >= c), sum(s >= c for s, _ in rows)
        ap, last = ap + (tp / pos - last) * tp / n, tp / pos
    assert E.average_precision(df).first().average_precision == pytest.approx(ap)
    pairs = [(a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z]
    assert E.roc_auc(df).first().roc_auc == pytest.approx(sum(pairs) / len(pairs))


def test_filter_bounds_and_missing(spark):
    contigs = spark.createDataFrame([("a", 100), ("b", 2000), ("c", 2000), ("d", 9000)], "contig string, length int")
    preds = spark.createDataFrame([("a", 0.9, 100), ("b", 0.9, 2000), ("d", 0.9, 9000)], "contig string, score double, length int")
    got = {r.contig: r.kept for r in S.filter_contigs_by_score(contigs, preds, 0.8, 1000, 5000).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True}
    with pytest.raises(Exception, match="no score for contig c"):
        S.filter_contigs_by_score(contigs, preds, error_on_missing=True).collect()


def test_cap_coverage_is_a_prefix(spark):
    aln = spark.createDataFrame([("c", k, 10, 50 if k else 40000, "A" * 10) for k in range(50)], "contig string, read_id long, n int, tlen int, seq string")
    refs = spark.createDataFrame([("c", 100)], "contig string, length int")
    got = S.cap_coverage(aln, refs, 2)
    assert got.count() == 19 and got.where("read_id = 0").isEmpty()


def test_best_epoch(spark):
    df = spark.createDataFrame([("m", k, ap) for k, ap in enumerate([0.1, 0.5, 0.4] + [0.3] * 9 + [0.2, 0.6])], "m string, epoch int, ap double")
    r = E.best_epoch(df, ["m"]).first()
    assert (r.best_epoch, r.final_rate) == (13, pytest.approx(8e-4))
