import random

import pytest
from pyspark.sql import functions as F

from asmlens.operators import misassembly as M
from asmlens.operators import pileup as P
from asmlens.operators import sampling as S
from asmlens.operators import sequence as Q
from asmlens.plans.catalogue import ENTRIES
from asmlens.plans.features import extract_features

ALN = "read_id string, flag int, contig string, pos int, mapq int, cigar string, tlen int, seq string, qual string, as_score int"
# Two read pairs whose features are known.
PAIR = [
    ("r001", 163, "Contig2", 0, 6, "5M", 425, "AAAAA", "JGCG8", 0),
    ("r002", 163, "Contig2", 0, 7, "5M", 425, "AGGGG", "JGCG8", -28),
    ("r001", 83, "Contig2", 420, 8, "5M", -425, "CCCCC", "JGCG8", -6),
    ("r002", 83, "Contig2", 420, 9, "5M", -425, "TTTTT", "JGCG8", -3),
]


def contigs(spark, *rows):
    return spark.createDataFrame([(n, s, len(s)) for n, s in rows], "contig string, seq string, length int")


def table(spark, rows, refs, **options):
    df = spark.createDataFrame(rows, ALN)
    return {r.position: r for r in P.dense_positions(P.pileup(P.expand_alignments(df, refs), **options), refs).collect()}


def test_two_reads(spark):
    got = table(spark, PAIR, contigs(spark, ("Contig2", "A" * 500)))
    assert len(got) == 500
    zero = got[0]
    # both first reads match: proper pairs count as matches, no mismatch
    assert (zero.coverage, zero.num_proper_Match, zero.num_proper_SNP, zero.num_SNPs) == (2, 2, 0, 0)
    assert (zero.num_query_A, zero.num_query_C, zero.num_query_G, zero.num_query_T) == (2, 0, 0, 0)
    # statistics over matching reads; the deviation of equal values is 0
    assert (zero.min_al_score_Match, zero.mean_al_score_Match, zero.max_al_score_Match) == (-28, -14, 0)
    assert (zero.min_mapq_Match, zero.mean_mapq_Match, zero.max_mapq_Match) == (6, 6.5, 7)
    assert (zero.min_insert_size_Match, zero.max_insert_size_Match, zero.stdev_insert_size_Match) == (425, 425, 0)
    for p in range(1, 5):  # one read matches and one doesn't: a deviation of one value is missing
        r = got[p]
        assert (r.coverage, r.num_proper_Match, r.num_proper_SNP, r.num_SNPs, r.num_query_A, r.num_query_G) == (2, 1, 1, 1, 1, 1)
        assert (r.mean_mapq_Match, r.mean_al_score_Match, r.stdev_insert_size_Match) == (6, 0, None)
    for p in range(420, 425):  # no read matches: statistics are missing
        r = got[p]
        assert (r.coverage, r.num_proper_Match, r.num_proper_SNP, r.num_SNPs, r.num_query_C, r.num_query_T) == (2, 0, 2, 2, 1, 1)
        assert r.mean_mapq_Match is None
    # where nothing aligns counts are 0, statistics missing, and the base is the contig's
    assert got[200].coverage == 0 and got[200].num_SNPs == 0 and got[200].min_mapq_Match is None and got[200].ref_base == "A"


@pytest.mark.parametrize(("cigar", "bases"), [("3S5M", 8), ("5M2S", 7), ("3H5M", 5), ("5M4H", 5), ("5M2I", 7)])
def test_clips_and_trailing_insert(spark, cigar, bases):
    rows = [("r", 0, "c", 10, 1, cigar, 0, "A" * bases, "*", 0)]
    got = P.expand_alignments(spark.createDataFrame(rows, ALN)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(10, 15))


def test_deletion_skip_and_quality_index(spark):
    # the quality of a clipped read is that of the base itself
    rows = [("r", 0, "c", 0, 1, "2S2M1D1M2N1I1M", 0, "GGACTTA", "!!JJ#JJ", 0)]
    got = P.expand_alignments(spark.createDataFrame(rows, ALN)).orderBy("position").collect()
    assert [(r.position, r.base, r.base_quality) for r in got] == [(0, "A", 41), (1, "C", 41), (2, "-", None), (3, "T", 2), (4, "N", None), (5, "N", None), (6, "A", 41)]


def test_base_quality_and_clamp(spark):
    rows = [("a", 0, "c", 0, 1, "1M", 0, "A", ".", -300), ("b", 0, "c", 0, 1, "1M", 0, "A", "-", 300), ("d", 0, "c", 0, 1, "1M", 0, "C", "*", None)]
    r = table(spark, rows, contigs(spark, ("c", "A")))[0]
    assert (r.coverage, r.num_query_A, r.num_query_C, r.num_SNPs) == (3, 1, 1, 1)  # quality 12 is too low
    assert (r.min_al_score_Match, r.max_al_score_Match) == (-128, 127)


def test_n_matches_n_and_u_is_t(spark):
    rows = [("a", 0, "c", 0, 1, "3M", 0, "NUa", "*", 0)]
    got = P.expand_alignments(spark.createDataFrame(rows, ALN), contigs(spark, ("c", "NTA"))).collect()
    assert all(r.is_match for r in got)


def test_extended_profile(spark):
    rows = [("a", 1 + 16, "c", 0, 5, "1M", 9, "C", "*", 0), ("b", 1 + 2048, "c", 0, 7, "1M", 9, "A", "*", 0)]
    r = table(spark, rows, contigs(spark, ("c", "A")), profile="extended")[0]
    assert (r.mean_mapq_SNP, r.num_supplementary_Match, r.num_discordant_SNP, r.num_diff_strand_SNP, r.num_diff_strand_Match) == (5, 1, 1, 1, 0)


def test_dense_positions_cuts_long_contigs(spark):
    refs = contigs(spark, ("c", "ACGT" * 10), ("empty", ""))
    rows = [("a", 0, "c", 38, 1, "2M", 0, "GT", "*", 0)]
    got = P.dense_positions(P.pileup(P.expand_alignments(spark.createDataFrame(rows, ALN), refs)), refs, chunk=7).orderBy("position").collect()
    assert "".join(r.ref_base for r in got) == "ACGT" * 10 and [r.coverage for r in got] == [0] * 38 + [1, 1]


@pytest.mark.parametrize(("seq", "entropy", "gc"), [
    ("AAAATTTT", [0, 0.811278, 1, 0.811278, 0.811278, 1, 0.811278, 0], [0] * 8),
    ("CCCCGGGG", [0, 0.811278, 1, 0.811278, 0.811278, 1, 0.811278, 0], [1] * 8),
    ("AAAACCCC", [0, 0.811278, 1, 0.811278, 0.811278, 1, 0.811278, 0], [0, 0.25, 0.5, 0.75, 0.25, 0.5, 0.75, 1]),
    ("A" * 11, [0] * 11, [0] * 11),
    ("A", [0], [0]),
    ("NNNN", [0] * 4, [0] * 4),
    ("", [], []),
])
@pytest.mark.parametrize("chunk", [3, 10_000])
def test_sequence_window(spark, seq, entropy, gc, chunk):
    df = spark.createDataFrame([("c", seq)], "contig string, seq string")
    got = Q.sequence_window(df, 4, chunk=chunk).orderBy("position").collect()
    assert [round(r.seq_window_entropy, 6) for r in got] == entropy
    assert [r.seq_window_perc_gc for r in got] == gc


def test_seq_stats_quality(spark):
    df = spark.createDataFrame([("f", "ACGT", "II+!"), ("f", "GG", "55")], "file string, seq string, qual string")
    r = Q.seq_stats(df, ["file"], qual="qual").first()
    assert (r.num_seqs, r.sum_len, r.n50) == (2, 6, 4)
    assert round(r.gc_percent, 3) == round(100 * 4 / 6, 3) and round(r.q20_percent, 3) == round(100 * 4 / 6, 3) and round(r.q30_percent, 3) == round(100 * 2 / 6, 3)


def test_contig_len_check(spark):
    heads = spark.createDataFrame([("a", 3), ("b", 9), ("z", 1)], "contig string, length int")
    got = {r.contig: r.problem for r in P.contig_len_check(heads, contigs(spark, ("a", "AAA"), ("b", "A"))).collect()}
    assert got == {"b": "length differs", "z": "unknown contig"}


def test_ratio_fixed_point(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "num_query_A int, coverage int")
    assert [r.num_query_A for r in P.ratio_normalize(df, ("num_query_A",), as_fixed=True).orderBy(F.desc("coverage")).collect()] == [3333, 0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_dealt_and_never_broadcast(spark):
    """A sequence is far larger than Spark supposes: a few rows of contigs may be gigabytes, which the driver cannot hold."""
    aln, refs = spark.createDataFrame(PAIR, ALN), contigs(spark, ("Contig2", "A" * 500))
    plan = plan_of(P.pileup(P.expand_alignments(aln, refs)))
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2  # reads and sequences; the positions stay
    records = spark.createDataFrame([("Contig2", "inversion", 3, 9)], "contig string, type string, start int, end int")
    plan = plan_of(extract_features(aln, refs, records, max_coverage=None))
    laid = plan[: plan.index("Generate")]
    assert "Exchange hashpartitioning" not in laid and "SortAggregate" not in laid


def test_extraction_equals_its_steps(spark):
    """Dealt once or joined position by position: equal rows, over several pieces, with odd letters, names and overhangs, capped and not."""
    dice = random.Random(3)
    refs = contigs(spark, *((n, "".join(dice.choices("ACGTacgtNU", k=k))) for n, k in (("a", 2500), ("b", 1000), ("c", 1), ("d", 37), ("empty", 0))), (None, "ACGT"))
    rows = []
    for k in range(400):
        contig = dice.choice("aaabbcdz")
        cigar, bases = dice.choice([("60M", 60), ("2S30M3D20M1I", 53), ("10M1200N20M", 30), ("*", 9), ("5M", 5)])
        rows.append((f"r{k // 2}", dice.choice([99, 147, 73, 4, 65]), contig, dice.randrange(0, 1500), dice.randrange(60), cigar, dice.choice([100, -300, 40000]), "".join(dice.choices("ACGTNacgu", k=bases)), "".join(dice.choices("#5I", k=bases)), dice.choice([None, -200, 3])))
    aln = spark.createDataFrame(rows, ALN)
    records = spark.createDataFrame([("a", "inversion", 0, 1200), ("a", "relocation", 900, 99999), ("a", "other", 5, 6), ("b", "translocation", 1000, 1000), ("z", "inversion", 1, 5)], "contig string, type string, start int, end int")
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for most in (None, 5):
        reads = aln if most is None else S.cap_coverage(aln, refs, most, ties=("pos", "flag", "mapq", "cigar", "tlen", "seq", "qual")).drop("cov", "length")
        steps = P.dense_positions(P.pileup(P.expand_alignments(reads, refs)), refs, spine=Q.sequence_window(refs.select("contig", "seq"), 6, base="own_base"))
        steps = M.label_positions(steps, records).withColumnsRenamed({"misassembled": "Extensive_misassembly", "by_pos": "Extensive_misassembly_by_pos"})
        assert key(extract_features(aln, refs, records, max_coverage=most, seed=0, ties=("pos", "flag", "mapq", "cigar", "tlen", "seq", "qual"))) == key(steps)


def test_expanded_reads_move_once(spark):
    """Only reads are dealt, by piece; their positions are counted where they are laid out."""
    plan = plan_of(ENTRIES["pil1_expand_alignments"].run(spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange") == 1 and plan.index("Generate explode(sequence(0") < plan.index("Exchange")
