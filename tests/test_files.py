import pytest
from pyspark.sql import functions as F

from asmlens.operators import study as Y
from asmlens.sources import readers as R
from asmlens.sources import writers as W


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">c1 first one\nACG\nTT\n\n>c2\nGG\n>c3\n")
    got = {r.contig: (r.comment, r.seq, r.length) for r in R.read_fasta(spark, path).collect()}
    assert got == {"c1": ("first one", "ACGTT", 5), "c2": ("", "GG", 2), "c3": ("", "", 0)}
    assert {r.contig for r in R.read_fasta(spark, path, name="line").collect()} == {"c1 first one", "c2", "c3"}


def test_sam_with_a_malformed_tag(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@SQ\tSN:c\tLN:9\nr\t163\tc\t1\t6\t5M\t=\t421\t425\tAAAAA\tJGCG8\tAS:i:-27\nr\t83\tc\t421\t8\t5M\t=\t1\t-425\tCCCCC\t*\tAS:i-90\n")
    a, b = R.read_alignments_text(spark, path).orderBy("pos").collect()
    assert (a.pos, a.flag, a.as_score, a.qual, a.mate_pos) == (0, 163, -27, "JGCG8", 420)
    assert (b.pos, b.as_score, b.qual) == (420, -90, None)


def test_report_names_carry_forward_and_the_last_contig_counts(spark, tmp_path):
    text = "scaffold_1\nExtensive misassembly ( translocation ) between 1 396778 and 396296 690424\nscaffold_3\n"
    text += "Extensive misassembly ( relocation, inconsistency = -7779 ) between 37232 107597 and 116295 165285\nExtensive misassembly ( translocation ) between 116295 165285 and 165519 319917\n"
    got = R.read_misassembly_report(spark, put(tmp_path, "r.info", text)).groupBy("contig").count().collect()
    assert {r.contig: r["count"] for r in got} == {"scaffold_1": 1, "scaffold_3": 4}


def test_toc_variants(spark, tmp_path):
    full = put(tmp_path, "toc6", "name\tlength\tmis\tsize\tbreaks\tcov\nContig2\t500\t1\t256\t100-102\t5\nContig1\t500\t0\t196\t50-55,250-255\t3\n")
    four = put(tmp_path, "toc4", "c\t7\t0\t1\n")
    empty = put(tmp_path, "toc0", "")
    got = {r.contig: r for r in R.read_toc(spark, [full, four, empty]).collect()}
    assert [(b.lo, b.hi) for b in got["Contig1"].breakpoints] == [(50, 55), (250, 255)] and got["Contig2"].avg_coverage == 5
    assert (got["c"].breakpoints, got["c"].avg_coverage) == ([], 100)


def test_last_prediction_wins(spark, tmp_path):
    path = put(tmp_path, "p.csv", "cont_name,length,score\nx/c1,10,0.1\nx/c2,10,0.2\ny/c1,10,0.9\n")
    assert {r.contig: r.score for r in R.read_predictions(spark, path).collect()} == {"c1": 0.9, "c2": 0.2}
    with pytest.raises(ValueError, match="lacks columns"):
        R.read_predictions(spark, put(tmp_path, "q.csv", "cont_name,score\nc,1\n"))


def test_paf_tag_is_checked(spark, tmp_path):
    good = "\t".join(["q", "100", "0", "50", "+", "t", "9", "0", "5", "1", "2", "60", "NM:i:3"]) + "\n"
    assert R.read_paf(spark, put(tmp_path, "a.paf", good)).first().nm == 3
    with pytest.raises(Exception, match="malformed NM tag"):
        R.read_paf(spark, put(tmp_path, "b.paf", good.replace("NM", "XX"))).collect()


def test_fastq_quality_may_begin_with_at(spark, tmp_path):
    path = put(tmp_path, "a.fq", "@r1 x\nACGT\n+\n@III\n@r2\nGG\n+\nII\n")
    assert [(r.read_id, r.seq, r.qual) for r in R.read_fastq(spark, path).collect()] == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]


def test_run_log(spark, tmp_path):
    log = "\n".join([
        "[Mon Jan  3 10:00:00 2022]", "rule map:", "    input: a/b.fa, c.bam", "    log: m.log", "    jobid: 7", "    wildcards: x=1, y=2", "Submitted job 7 with external jobid '99'.", "",
        "[Mon Jan  3 10:00:05 2022]", "Error in rule map:", "    jobid: 7", "    conda-env: e", "",
        "[Mon Jan  3 10:00:06 2022]", "\x1b[32mrule map:\x1b[0m", "    input: a/b.fa, c.bam", "    jobid: 7", "",
        "[Mon Jan  3 10:01:06 2022]", "Finished job 7.", "1 of 2 steps done", "",
        "[Mon Jan  3 10:02:00 2022]", "localrule all:", "    jobid: 0", "",
    ])
    got = {(r.rule, r.attempt): r for r in Y.summarize_run_log(R.read_run_log(spark, put(tmp_path, "run.log", log))).collect()}
    one, two, last = got["map", 1], got["map", 2], got["all", 1]
    assert (one.pass_fail, one.seconds, one.clust_job, one.conda_env, one.wildcards) == ("error", 5, "99", "e", "x=1,y=2")
    assert (two.pass_fail, two.seconds) == ("finished", 60) and last.pass_fail is None


def test_run_log_is_parsed_once(spark, tmp_path):
    """Sections were made again for each side of their joins; an end without a date of its own, or before any start, is no end."""
    log = "\n".join(["Finished job 1.", "[Mon Jan  3 10:00:00 2022]", "Finished job 1.", "[Mon Jan  3 10:00:01 2022]", "rule a:", "    input: x", "[Mon Jan  3 10:00:02 2022]", "rule a:", "    input: x", "    jobid: 1", "[Mon Jan  3 10:00:09 2022]", "Finished job 1.", "[Mon Jan  3 10:00:10 2022]", "Error in rule a:", "    jobid: 1"])
    out = Y.summarize_run_log(R.read_run_log(spark, put(tmp_path, "run.log", log)))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan text") <= 4
    got = sorted((r.attempt, r.sm_job, r.pass_fail, r.seconds) for r in out.collect())
    assert got == [(1, None, None, None), (2, "1", "error", 8)]


def test_path_list(spark, tmp_path):
    fasta = put(tmp_path, "a.fa", ">c\nA\n")
    assert R.read_path_list(spark, fasta) == [fasta]
    assert R.read_path_list(spark, put(tmp_path, "list", "a.fa\n\n/x/b.fa\n")) == [f"{tmp_path}/a.fa", "/x/b.fa"]


def test_fasta_output_is_no_input(spark, tmp_path):
    with pytest.raises(ValueError, match="same path"):
        W.write_fasta(spark.createDataFrame([("c", "A")], "contig string, seq string"), "x", inputs=("x",))


def test_wig_and_input_map(spark, tmp_path):
    wig = put(tmp_path, "a.wig", "track\nvariableStep chrom=c1\n5 1.5\n7 2\nvariableStep chrom=c2 span=1\n1 0\n")
    assert [(r.contig, r.pos, r.value) for r in R.read_wig_targets(spark, wig).orderBy("contig", "pos").collect()] == [("c1", 5, 1.5), ("c1", 7, 2.0), ("c2", 1, 0.0)]
    with pytest.raises(ValueError, match="lacks columns"):
        R.read_input_map(spark, put(tmp_path, "m.tsv", "Taxon\tFasta\n1\t2\n"))


def test_input_type(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate((["Taxon", "Fasta"], ["BAM"], ["Read1", "read2"]))], "k int, names array<string>")
    assert [r.t for r in rows.orderBy("k").select(Y.input_type(F.col("names")).alias("t")).collect()] == ["simulation", "provided", "real"]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"line {k}" + "x" * (k % 90) for k in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree")
    (tmp_path / "r.fq").write_text("".join(f"@r{k} more\nACGT\n+\n@III\n" for k in range(3000)) + "@cut\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = R._numbered(spark, str(tmp_path / "*.txt")).collect()
        got = {r.line_no: r.line for r in rows if r.file.endswith("a.txt")}
        assert [got[k] for k in range(len(got))] == lines
        assert sorted((r.line_no, r.line) for r in rows if r.file.endswith("b.txt")) == [(0, "one"), (1, ""), (2, "three")]
        reads = R.read_fastq(spark, str(tmp_path / "r.fq")).collect()
        assert sorted(r.read_id for r in reads) == sorted(f"r{k}" for k in range(3000)) and {(r.seq, r.qual) for r in reads} == {("ACGT", "@III")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
