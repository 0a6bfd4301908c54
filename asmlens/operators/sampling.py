"""Sampling, filtering and renaming of reads and contigs (SMP1-3, FLT1-5, REN1-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.functions.columns import path_part, random_int, sanitize
from asmlens.operators.ordered import exact_quantiles, numbered


BIN_READS = 1000


def cap_coverage(aln: DataFrame, contigs: DataFrame, max_cov: float = 20, max_insert: int = 30000, seed: int = 0, key: str | Column = "read_id", ties: tuple = (), read_length: str | Column | None = None) -> DataFrame:
    """SMP1: per contig, reads in hash order while the coverage so far stays below ``max_cov``; too wide inserts go.

    Adds ``cov``, the coverage with the read. The order is by a hash of ``key`` and then ``ties``. A contig's reads
    are dealt to hash ranges of about ``BIN_READS``; sums of ranges say where the cut lies, and only ranges before
    it are ordered, each on its own.
    """
    names = [k for k in ("sample", "contig") if k in aln.columns and k in contigs.columns]
    size = F.length("seq") if read_length is None else F.col(read_length) if isinstance(read_length, str) else read_length
    rows = aln.where(F.abs("tlen") <= max_insert)
    deep = rows.groupBy(*names).agg(F.ceil(F.count("*") / BIN_READS).alias("_bins")).join(contigs.select(*names, "length"), names)
    rows = rows.withColumns({"_h": random_int(key, seed), "_n": size}).join(deep, names)
    rows = rows.withColumn("_bin", F.floor(F.col("_h") * F.col("_bins") / (1 << 31))).drop("_bins")
    sums = rows.groupBy(*names, "_bin").agg(F.sum("_n").alias("_sum"), F.max("length").alias("_length"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sums.withColumn("_before", before).where(F.col("_before") / F.col("_length") < max_cov).select(*names, "_bin", "_before")
    within = Window.partitionBy(*names, "_bin").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(open_, [*names, "_bin"]).withColumn("cov", (F.col("_before") + F.sum("_n").over(within)) / F.col("length"))
    return rows.where(F.col("cov") < max_cov).drop("_h", "_n", "_bin", "_before")


def read_order(aln: DataFrame, seed: int = 0, key: str | Column = "read_id", ties: tuple = ()) -> Column:
    """A struct that orders reads as ``cap_coverage`` does; reads that tie come by a hash of all their columns."""
    return F.struct(random_int(key, seed).alias("h"), *(F.col(c) for c in ties), F.xxhash64(*aln.columns).alias("x"))


def coverage_cut(aln: DataFrame, contigs: DataFrame, max_cov: float = 20, max_insert: int = 30000, seed: int = 0, key: str | Column = "read_id", ties: tuple = (), read_length: str | Column | None = None) -> DataFrame:
    """Rows (sample, contig, limit): the least ``read_order`` that ``cap_coverage`` leaves out, for contigs that have one.

    Only orders and lengths move, not the reads, and only the hash range with the cut is ordered. Copies of a read that are equal in
    every column stay or go together.
    """
    names = [k for k in ("sample", "contig") if k in aln.columns and k in contigs.columns]
    size = F.length("seq") if read_length is None else F.col(read_length) if isinstance(read_length, str) else read_length
    rows = aln.where(F.abs("tlen") <= max_insert).select(*names, read_order(aln, seed, key, ties).alias("_order"), size.alias("_n"))
    deep = rows.groupBy(*names).agg(F.ceil(F.count("*") / BIN_READS).alias("_bins")).join(contigs.select(*names, "length"), names)
    rows = rows.join(deep, names).withColumn("_bin", F.floor(F.col("_order.h") * F.col("_bins") / (1 << 31))).drop("_bins")
    sums = rows.groupBy(*names, "_bin").agg(F.sum("_n").alias("_sum"), F.max("length").alias("_length"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("_before", before).where((F.col("_before") / F.col("_length") < max_cov) & ((F.col("_before") + F.col("_sum")) / F.col("_length") >= max_cov))
    within = Window.partitionBy(*names, "_bin").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(cut.select(*names, "_bin", "_before"), [*names, "_bin"]).withColumn("_cov", (F.col("_before") + F.sum("_n").over(within)) / F.col("length"))
    return rows.where(F.col("_cov") >= max_cov).groupBy(*names).agg(F.min("_order").alias("limit"))


def coverage_report(capped: DataFrame) -> DataFrame:
    """SMP1's report: final coverage of each contig, greatest first."""
    names = [k for k in ("sample", "contig") if k in capped.columns]
    return capped.groupBy(*names).agg(F.max("cov").alias("coverage")).orderBy(F.desc("coverage"), *names)


def contig_frac(contigs: DataFrame, x: float, key: str = "contig", seed: int = 0) -> DataFrame:
    """SMP2: above 1 a least length, else the share of contigs to keep at random."""
    if x > 1:
        return contigs.where(F.col("length") >= x)
    return contigs.where(random_int(key, seed) < int(x * 2_147_483_648))


def sample_n_reads(reads: DataFrame, n: int, seed: int = 0, key: str = "read_id", ties: tuple = ()) -> DataFrame:
    """SMP3: exactly n reads by hash of their id, so both mates choose the same."""
    return reads.orderBy(random_int(key, seed), key, *ties).limit(n)


def min_contig_length(contigs: DataFrame, cutoff: int, length: str = "length") -> DataFrame:
    """FLT1."""
    return contigs.where(F.col(length) >= cutoff)


def contig_meta_filter(meta: DataFrame, min_len: int = 1000, min_avg_coverage: float = 1.0) -> DataFrame:
    """FLT2."""
    return meta.where((F.col("length") >= min_len) & (F.col("avg_coverage") >= min_avg_coverage))


def contig_meta_summary(meta: DataFrame, min_len: int = 1000, min_avg_coverage: float = 1.0) -> DataFrame:
    """FLT2's counts, over all contigs and over those kept."""
    kept = (F.col("length") >= min_len) & (F.col("avg_coverage") >= min_avg_coverage)
    bad = F.col("misassembly_cnt") > 0
    return meta.agg(
        F.count("*").alias("n_all"),
        F.count_if(kept).alias("n_kept"),
        (F.count("*") - F.count_if(kept)).alias("n_excluded"),
        F.count_if(bad).alias("misassembled_all"),
        F.count_if(bad & kept).alias("misassembled_kept"),
        F.sum(F.when(kept, F.col("length"))).alias("total_length"),
    ).join(F.broadcast(exact_quantiles(meta.where(kept), "length", [0.5]).select(F.col("q")[0].alias("median_length"))), F.lit(True), "left")  # one row each


def filter_contigs_by_score(contigs: DataFrame, predictions: DataFrame, score_cutoff: float = 0.8, min_length: int = 0, max_length: int | None = None, error_on_missing: bool = False) -> DataFrame:
    """FLT3: contigs with score and kept; a contig without a score has score 0 or is an error."""
    known = predictions.select(F.col("contig").alias("c"), F.col("score"), F.col("length").alias("p_length"), F.lit(True).alias("matched"))
    rows = contigs.join(known, F.col("contig") == F.col("c"), "left").drop("c")
    if error_on_missing:
        missing = F.when(F.col("matched").isNull(), F.raise_error(F.concat(F.lit("no score for contig "), F.col("contig").cast("string"))).cast("double"))
        rows = rows.withColumn("score", F.coalesce(missing, "score"))
    n = F.coalesce(F.col("p_length"), F.col("length"))
    outside = (n < min_length) | (F.lit(False) if max_length is None else n > max_length)
    rows = rows.withColumns({"score": F.coalesce("score", F.lit(0.0)), "matched": F.coalesce("matched", F.lit(False))})
    return rows.withColumn("kept", (F.col("score") < score_cutoff) | outside).drop("p_length")


def filter_counts(filtered: DataFrame) -> DataFrame:
    """FLT3's counts."""
    return filtered.agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("filtered"), F.count_if("matched").alias("matched"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """FLT4."""
    s = F.col("score")
    return predictions.agg(F.count("*").alias("n"), F.round(F.min(s), 2).alias("min"), F.round(F.avg(s), 2).alias("mean"), F.round(F.max(s), 2).alias("max"))


def score_cutoff_check(cutoffs: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """FLT5: the rows whose cutoff lies outside [0, 1], with a warning."""
    return cutoffs.where(~F.col(cutoff).between(0, 1)).withColumn("warning", F.lit("score cutoff outside [0, 1]"))


def rename_sanitized(df: DataFrame, column: str) -> DataFrame:
    """REN1."""
    return df.withColumn(column, sanitize(column))


def number_contigs(records: DataFrame, cutoff: int, file: str = "file", order: str = "rec", name: str = "header") -> DataFrame:
    """REN2: ``<name>_CONTIG<k>``, k counting the records of a file that pass the length cutoff, from 0."""
    kept = numbered(records.where(F.col("length") >= cutoff), [file], [order], "k").withColumn("k", F.col("k") - 1)
    return kept.withColumn("new_name", F.concat(sanitize(name), F.lit("_CONTIG"), F.col("k").cast("string")))


def strip_non_ascii(lines: DataFrame, column: str = "line", by: str = "_") -> DataFrame:
    """REN3."""
    return lines.withColumn(column, F.regexp_replace(column, r"[^\x00-\x7F]", by))


def non_ascii_report(lines: DataFrame, column: str = "line", number: str = "line_no") -> DataFrame:
    """REN3's report: rows (line_no, char, n) of every character outside ASCII."""
    chars = F.regexp_extract_all(F.col(column), F.lit(r"([^\x00-\x7F])"), F.lit(1))
    return lines.select(number, F.explode(chars).alias("char")).groupBy(number, "char").agg(F.count("*").alias("n"))


def extract_path_params(files: DataFrame, path: str = "path", layout: str = "simulation") -> DataFrame:
    """REN4: parameters from a feature file's path, in one of two layouts."""
    # The order of the folders.
    names = {"simulation": ("richness", "abundance_distribution", "rep", "read_length", "read_depth", "assembler", "contig_frac"), "real": ("sample", "assembler", "contig_frac")}[layout]
    kinds = {"richness": "double", "rep": "int", "read_length": "int", "read_depth": "int", "contig_frac": "double"}
    n = len(names)
    return files.withColumns({name: path_part(path, k - n - 1).try_cast(kinds.get(name, "string")) for k, name in enumerate(names)})

