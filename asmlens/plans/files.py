"""Registered queries of readers and sinks: domain tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asmlens.functions.storage import shared_folder
from asmlens.operators import pileup as P
from asmlens.operators import stats as N
from asmlens.operators import study as Y
from asmlens.plans.adapters import Tables, duck
from asmlens.plans.registry import query
from asmlens.sources import readers as R
from asmlens.sources import writers as W
from asmlens.streaming import incremental as I


def _text(t: Tables, lines: DataFrame, name: str, **options) -> str:
    path = f"{shared_folder(t.spark)}/{name}"
    lines.write.options(**options).text(path)
    return path


def _lines(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _c(name: str) -> Column:
    return F.col(name).cast("string")


_SEQ = duck("SELECT contig::VARCHAR AS contig, length(seq)::INT AS length, md5(seq) AS seq FROM seqs", "seqs")


@query("src1_read_fasta", _SEQ)
def _(t):
    path = f"{shared_folder(t.spark)}/contigs.fa"
    W.write_fasta(t.sequences().withColumn("contig", _c("contig")), path)
    return R.read_fasta(t.spark, path).select("contig", "length", F.md5("seq").alias("seq"))


@query("snk6_write_fasta", duck("SELECT contig::VARCHAR AS contig, 'score=' || contig % 7 AS comment, length(seq)::INT AS length FROM seqs", "seqs"))
def _(t):
    path = f"{shared_folder(t.spark)}/kept"
    W.write_fasta(t.sequences().withColumn("score", F.col("contig") % 7).withColumn("contig", _c("contig")), path, file="file", score="score", compression="gzip")
    return R.read_fasta(t.spark, f"{path}/*").select("contig", "comment", "length")


@query("src2_read_alignments_text", duck("SELECT okey::VARCHAR AS read_id, flag, contig::VARCHAR AS contig, pos, mapq, mlen || 'M' AS cigar, tlen, as_score, mlen AS bases FROM aln", "aln"))
def _(t):
    a = t.alignments()
    line = F.concat_ws("\t", _c("okey"), _c("flag"), _c("contig"), (F.col("pos") + 1).cast("string"), _c("mapq"), "cigar", F.lit("="), (F.col("pos") + 2).cast("string"), _c("tlen"), "seq", "qual", _lines("AS:i:", _c("as_score")), F.lit("XT:A:U"))
    path = _text(t, a.select(line.alias("value")).unionByName(t.spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value"))), "reads.sam")
    return R.read_alignments_text(t.spark, path).select("read_id", "flag", "contig", "pos", "mapq", "cigar", "tlen", "as_score", F.length("seq").alias("bases"))


@query("src3_read_misassembly_report", duck("""SELECT contig::VARCHAR AS contig, type, CASE WHEN type = 'inversion' THEN "end" + 10 ELSE "start" END AS "start", "end" + 300 AS "end", "end" AS break_start, "end" + 10 AS break_end FROM mis""", "mis"))
def _(t):
    m = t.view("mis")
    near, far = (F.col("end") + 10).cast("string"), (F.col("end") + 300).cast("string")
    second = F.when(F.col("type") == "inversion", F.concat_ws(" ", far, near)).otherwise(F.concat_ws(" ", near, far))  # an inversion has one interval reversed
    event = _lines("Extensive misassembly (", F.col("type"), ") between ", _c("start"), " ", _c("end"), " and ", second)
    path = _text(t, m.select(F.concat_ws("\n", _c("contig"), event).alias("value")), "report.info")
    return R.read_misassembly_report(t.spark, path).select("contig", "type", "start", "end", "break_start", "break_end")


@query("src4_read_toc", duck("SELECT contig::VARCHAR AS contig, length, misassembly_cnt, CASE WHEN misassembly_cnt > 0 THEN 1 ELSE 0 END AS n_breaks, CASE WHEN misassembly_cnt > 0 THEN lo END AS lo, CASE WHEN contig % 5 = 0 THEN 100.0 ELSE avg_coverage END AS avg_coverage FROM meta", "meta"), "avg_coverage")
def _(t):
    m = t.breakpoints()
    line = F.concat_ws("\t", _c("contig"), _c("length"), _c("misassembly_cnt"), F.lit("10"), W.breakpoints_text(), F.when(F.col("contig") % 5 != 0, _c("avg_coverage")))
    path = _text(t, m.select(line.alias("value")), "toc")
    got = R.read_toc(t.spark, path)
    return got.select("contig", "length", "misassembly_cnt", F.size("breakpoints").alias("n_breaks"), F.try_element_at("breakpoints", F.lit(1))["lo"].alias("lo"), "avg_coverage")


@query("snk3_write_toc", duck("SELECT contig::VARCHAR AS contig, length, misassembly_cnt, avg_coverage FROM meta", "meta"), "avg_coverage")
def _(t):
    path = f"{shared_folder(t.spark)}/toc"
    W.write_toc(t.breakpoints().withColumn("size_bytes", F.lit(1)), path)
    return R.read_toc(t.spark, path).select("contig", "length", "misassembly_cnt", "avg_coverage")


@query("src5_read_stats_json", duck("SELECT file % 4 AS file, count(*) AS all_count, sum(mapq)::DOUBLE AS mapq_mean_sum FROM (SELECT contig AS file, mapq FROM aln) GROUP BY 1", "aln"), "mapq_mean_sum")
def _(t):
    sums = t.view("aln").groupBy((F.col("contig") % 4).alias("f")).agg(F.count("*").alias("all_count"), F.sum("mapq").cast("double").alias("s"))
    rows = sums.select("f", "all_count", F.struct(F.struct(F.col("s").alias("mean")).alias("sum")).alias("mapq"))
    folder = f"{shared_folder(t.spark)}/stats"
    rows.repartition("f").write.partitionBy("f").json(folder)  # an object a file
    got = R.read_stats_json(t.spark, f"{folder}/*")
    return got.select(F.regexp_extract("file", "f=([0-9]+)", 1).cast("long").alias("file"), "all_count", F.col("mapq.sum.mean").alias("mapq_mean_sum"))


@query("snk4_write_stats_json", duck("SELECT count(*) AS all_count, sum(mapq)::DOUBLE AS mapq_sum FROM aln", "aln"), "mapq_sum")
def _(t):
    path = f"{shared_folder(t.spark)}/stats"
    W.write_stats_json(N.sufficient_stats(t.view("aln"), [], ("mapq",)), path)
    return t.spark.read.schema("all_count long, mapq_sum double").json(path)


@query("src6_discover_feature_files", "SELECT DISTINCT o_custkey % 50 AS part FROM orders")
def _(t):
    root = f"{shared_folder(t.spark)}/features"
    t["orders"].select((F.col("o_custkey") % 50).alias("group"), _c("o_orderkey").alias("value")).repartition("group").write.partitionBy("group").text(root)
    return R.discover_feature_files(t.spark, root, match="group=", names="part-*").select(F.regexp_extract("path", "group=([0-9]+)", 1).cast("long").alias("part")).distinct()


def _position_table(t: Tables) -> DataFrame:
    return P.pileup(P.expand_alignments(t.alignments(), t.contigs())).withColumn("assembler", F.lit("megahit"))


_POS = "SELECT contig, position, count(*) AS coverage, avg(CASE WHEN base = ref_base THEN mapq END) AS mean_mapq_Match FROM expanded GROUP BY ALL"


@query("src7_read_feature_table", duck(f"SELECT contig, count(*) AS n, sum(coverage)::BIGINT AS coverage, count(mean_mapq_Match) AS with_mapq FROM ({_POS}) GROUP BY contig", "aln", "expanded"))
def _(t):
    path = f"{shared_folder(t.spark)}/features.tsv"
    W.write_position_features(_position_table(t), path, as_text=True)
    return R.read_feature_table(t.spark, path).groupBy(F.col("contig").cast("long").alias("contig")).agg(F.count("*").alias("n"), F.sum("coverage").cast("long").alias("coverage"), F.count("mean_mapq_Match").alias("with_mapq"))


@query("snk1_write_position_features", duck(f"SELECT contig % 3 AS sample, contig, position, coverage, mean_mapq_Match FROM ({_POS})", "aln", "expanded"), "mean_mapq_Match")
def _(t):
    path = f"{shared_folder(t.spark)}/features"
    W.write_position_features(_position_table(t).withColumn("sample", F.col("contig") % 3), path)
    return t.spark.read.parquet(path).select(F.col("sample").cast("long").alias("sample"), "contig", "position", "coverage", "mean_mapq_Match")


@query("snk2_write_contig_arrays", duck(f"SELECT contig, count(*)::INT AS length, arg_max(coverage, position) AS last_coverage FROM ({_POS}) GROUP BY contig", "aln", "expanded"))
def _(t):
    path = f"{shared_folder(t.spark)}/arrays"
    W.write_contig_arrays(_position_table(t), path, ["position", "coverage"])
    return t.spark.read.parquet(path).select("contig", "length", F.element_at("coverage", -1).alias("last_coverage"))


@query("src8_read_predictions", duck("SELECT contig::VARCHAR AS contig, score, length FROM preds", "preds"), "score")
def _(t):
    path = f"{shared_folder(t.spark)}/preds"
    t.view("preds").select(_lines("x/y/", _c("contig"), ".fa").alias("cont_name"), "score", "length").write.option("header", True).csv(path)
    return R.read_predictions(t.spark, path, name_regex="\\.fa$")


@query("snk5_write_predictions", duck("SELECT contig::VARCHAR AS contig, score, length FROM preds", "preds"), "score")
def _(t):
    path = f"{shared_folder(t.spark)}/preds"
    rows = t.view("preds").withColumn("cont_name", _c("contig")).withColumns({c: F.col("score") for c in ("min", "mean", "std", "max")})
    W.write_predictions(rows, path)
    return R.read_predictions(t.spark, path)


@query("src9_read_paf", duck("SELECT query::VARCHAR AS query, hit_len, nm FROM paf", "paf"))
def _(t):
    line = F.concat_ws("\t", _c("query"), F.lit("100"), F.lit("7"), (F.col("hit_len") + 7).cast("string"), *(F.lit(x) for x in ("+", "t", "500", "1", "2", "3", "4", "60")), _lines("NM:i:", _c("nm")))
    return R.read_paf(t.spark, _text(t, t.view("paf").select(line.alias("value")), "hits.paf")).select("query", "hit_len", "nm")


@query("src10_read_input_map", "SELECT p_name AS taxon, p_partkey::VARCHAR AS \"sample\" FROM part")
def _(t):
    path = f"{shared_folder(t.spark)}/map"
    t["part"].select(F.col("p_name").alias("Taxon"), F.lit("a.fa").alias("Fasta"), F.col("p_partkey").alias("SAMPLE"), F.lit("b.bam").alias("Bam")).write.options(sep="\t", header=True).csv(path)
    return R.read_input_map(t.spark, path).where(F.col("bam_path").endswith("/b.bam")).select("taxon", "sample")


@query("src11_read_fastq", duck("SELECT okey::VARCHAR AS read_id, mlen AS n FROM aln", "aln"))
def _(t):
    a = t.alignments()
    path = _text(t, a.select(F.concat_ws("\n", _lines("@", _c("okey")), "seq", F.lit("+"), "qual").alias("value")), "reads.fq")
    return R.read_fastq(t.spark, path).select("read_id", F.length("seq").alias("n"))


@query("src12_read_genome_metadata", "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size END::INT AS p_size FROM part")
def _(t):
    folder = shared_folder(t.spark)
    t["part"].where("p_partkey % 2 = 0").select("p_partkey", "p_brand", "p_size").write.options(sep="\t", header=True).csv(f"{folder}/bac")
    t["part"].where("p_partkey % 2 = 1").select("p_brand", "p_partkey").write.options(sep="\t", header=True).csv(f"{folder}/arc")
    return R.read_genome_metadata(t.spark, [f"{folder}/bac", f"{folder}/arc"], ["p_partkey", "p_brand", "p_size"]).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("src13_read_depth_table", duck("SELECT contig::VARCHAR AS contig, pos, mlen AS depth, 's' || contig % 3 AS \"sample\" FROM aln", "aln"))
def _(t):
    path = f"{shared_folder(t.spark)}/depth"
    t.view("aln").select("contig", "pos", "mlen", _lines("s", (F.col("contig") % 3).cast("string")).alias("d")).write.partitionBy("d").option("sep", "\t").csv(path)
    return R.read_depth_table(t.spark, f"{path}/*", "d=([^/]+)/[^/]*$")


_STAMP = "'[Mon Jan ' || (1 + o_orderkey % 9) || ' 00:00:' || lpad((o_orderkey % 50)::VARCHAR, 2, '0') || ' 2022]'"


def _log_lines(t: Tables) -> DataFrame:
    """Logs of about 500 orders: each order starts a job, and ends it unless its status is P."""
    day = lambda plus: _lines("[Mon Jan ", (1 + F.col("o_orderkey") % 9).cast("string"), " 00:00:", F.lpad((F.col("o_orderkey") % 50 + plus).cast("string"), 2, "0"), " 2022]")
    start = F.concat_ws("\n", day(0), F.lit("rule map:"), _lines("    input: ", _c("o_custkey"), ".fa"), _lines("    jobid: ", _c("o_orderkey")), F.lit("    wildcards: a=1, b=2"), _lines("Submitted job 1 with external jobid '", _c("o_orderkey"), "'"))
    end = F.when(F.col("o_orderstatus") == "F", F.concat_ws("\n", day(5), _lines("Finished job ", _c("o_orderkey"), "."))).when(F.col("o_orderstatus") == "O", F.concat_ws("\n", day(5), F.lit("Error in rule map:"), _lines("    jobid: ", _c("o_orderkey"))))
    return t["orders"].select(F.floor(F.col("o_orderkey") / 2000).alias("g"), F.concat_ws("\n", start, end).alias("value"))


_DAY = "'[Mon Jan ' || (1 + o_orderkey % 9) || ' 00:00:' || lpad((o_orderkey % 50 + {plus})::VARCHAR, 2, '0') || ' 2022]'"


@query(
    "src14_read_run_log",
    f"""SELECT line, count(*) AS n FROM (SELECT unnest([{_DAY.format(plus=0)}, 'rule map:', '    input: ' || o_custkey || '.fa', '    jobid: ' || o_orderkey, '    wildcards: a=1, b=2', 'Submitted job 1 with external jobid ' || chr(39) || o_orderkey || chr(39)]
      || CASE o_orderstatus WHEN 'F' THEN [{_DAY.format(plus=5)}, 'Finished job ' || o_orderkey || '.'] WHEN 'O' THEN [{_DAY.format(plus=5)}, 'Error in rule map:', '    jobid: ' || o_orderkey] ELSE [] END) AS line FROM orders) GROUP BY line""",
)
def _(t):
    """Every line of a log with colours, as often as it occurs."""
    coloured = _log_lines(t).select(F.regexp_replace("value", "(?m)^(rule|Error)", "\x1b[31m$1\x1b[0m").alias("value"))
    return R.read_run_log(t.spark, _text(t, coloured, "run.log")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


@query("src14_read_accounting", duck("SELECT run_id::VARCHAR AS clust_job, round(s, 1) AS wall_s FROM runs", "runs"), "wall_s")
def _(t):
    fields = [_c("run_id") if k == R.ACCOUNTING["job"] else F.round("s", 1).cast("string") if k == R.ACCOUNTING["wall_s"] else F.lit("0") for k in range(40)]
    path = _text(t, t.view("runs").select(F.concat_ws(":", *fields).alias("value")), "accounting")
    return R.read_accounting(t.spark, path).select("clust_job", "wall_s")


@query("log1_summarize_run_log", "SELECT o_orderkey::VARCHAR AS sm_job, o_custkey || '.fa' AS input_files, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'error' END AS pass_fail, CASE WHEN o_orderstatus <> 'P' THEN 5 END::BIGINT AS seconds, 'a=1,b=2' AS wildcards FROM orders")
def _(t):
    """Each job of the study's logs, one log a group of orders."""
    folder = f"{shared_folder(t.spark)}/logs"
    _log_lines(t).repartition("g").write.partitionBy("g").text(folder)
    lines = R.read_run_log(t.spark, f"{folder}/*")
    return Y.summarize_run_log(lines).select("sm_job", "input_files", "pass_fail", "seconds", "wildcards")


@query("src15_read_eval_indices", duck("SELECT contig AS val_ind FROM preds", "preds"))
def _(t):
    path = f"{shared_folder(t.spark)}/eval"
    t.view("preds").select(F.lit(0).alias("_"), F.col("contig").alias("val_ind")).write.option("header", True).csv(path)
    return R.read_eval_indices(t.spark, path)


@query("src16_read_wig_targets", duck("SELECT contig::VARCHAR AS contig, pos, mlen::DOUBLE AS value FROM aln", "aln"), "value")
def _(t):
    path = _text(t, t.view("aln").select(F.concat_ws("\n", _lines("variableStep chrom=", _c("contig")), _lines(_c("pos"), " ", _c("mlen"))).alias("value")), "track.wig")
    return R.read_wig_targets(t.spark, path).select("contig", "pos", "value")


@query("src17_read_path_list", "SELECT o_custkey % 20 AS part, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    folder = shared_folder(t.spark)
    rows = t["orders"].select((F.col("o_custkey") % 20).alias("group"), _c("o_orderkey").alias("value"))
    rows.write.partitionBy("group").text(f"{folder}/names")
    rows.select(_lines("names/group=", _c("group")).alias("value")).distinct().write.text(f"{folder}/list")
    found = t.spark.read.text(R.read_path_list(t.spark, f"{folder}/list")).select(F.regexp_extract("_metadata.file_path", "group=([0-9]+)", 1).cast("long").alias("part"))
    return found.groupBy("part").agg(F.count("*").alias("n"))


@query("snk7_write_feature_registry", "SELECT s_suppkey::VARCHAR || '/megahit/features.tsv.gz' AS feature_file, 'features.tsv.gz' AS file_name FROM supplier")
def _(t):
    path = f"{shared_folder(t.spark)}/registry"
    W.write_feature_registry(Y.registry_rows(t["supplier"].select(_lines(_c("s_suppkey"), "/megahit/features.tsv.gz").alias("path"))), path)
    return t.spark.read.options(sep="\t", header=True).csv(path).select("feature_file", "file_name")


@query("stm1_incremental_stats", duck("SELECT count(*) AS all_count, sum(mapq)::DOUBLE AS mapq_sum, sum(mapq * mapq)::DOUBLE AS mapq_sum2 FROM aln", "aln"), "mapq_sum mapq_sum2")
def _(t):
    """Statistics of many files, as a stream; equal to those of all rows at once."""
    folder = shared_folder(t.spark)
    stats = N.sufficient_stats(t.view("aln"), ["contig"], ("mapq",))
    stats.repartition(4, "contig").write.parquet(f"{folder}/stats")
    stream = t.spark.readStream.schema(stats.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/stats")
    I.incremental_stats(stream, ("mapq",), f"{folder}/sums", f"{folder}/checkpoint", "contig").awaitTermination()
    sums = I.file_sums(t.spark, ("mapq",), f"{folder}/sums", "contig", "bigint")
    return I.running_sums(sums, ("mapq",)).select("all_count", "mapq_sum", "mapq_sum2")
