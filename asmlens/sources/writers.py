"""Sinks (SNK1-SNK7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of the position table's columns.
POSITION_COLUMNS = (
    "assembler contig position ref_base num_query_A num_query_C num_query_G num_query_T num_SNPs coverage num_discordant "
    "min_insert_size_Match mean_insert_size_Match stdev_insert_size_Match max_insert_size_Match "
    "min_mapq_Match mean_mapq_Match stdev_mapq_Match max_mapq_Match "
    "min_al_score_Match mean_al_score_Match stdev_al_score_Match max_al_score_Match "
    "num_proper_Match num_orphans_Match num_discordant_Match num_proper_SNP seq_window_entropy seq_window_perc_gc "
    "Extensive_misassembly Extensive_misassembly_by_pos"
).split()


def write_position_features(features: DataFrame, path: str, as_text: bool = False, by: str = "sample") -> None:
    """SNK1: Parquet in folders by sample, sorted so that row-group statistics find a contig; or gzip TSV with ``NA`` and two decimals."""
    if not as_text:
        dealt = features.repartition(by, "contig").sortWithinPartitions(by, "contig", "position")
        dealt.write.partitionBy(by).parquet(path)
        return
    names = [c for c in POSITION_COLUMNS if c in features.columns]
    short = {c: F.round(c, 2) for c in names if c.startswith(("mean_", "stdev_"))}
    features.select(*names).withColumns(short).write.options(sep="\t", header=True, compression="gzip", nullValue="NA").csv(path)


def write_clustered(df: DataFrame, table: str, by: list[str], order: list[str], buckets: int) -> None:
    """A table of the catalogue, dealt by ``by`` into ``buckets`` files that are sorted by ``by`` and ``order``.

    Tables written alike join by those columns, and aggregate by them, without an exchange (a join by more columns too
    where ``spark.sql.requireAllClusterKeysForCoPartition`` is off); row groups carry their least and
    greatest values, so a filter on a contig or a stretch of positions skips the others. Where one contig may hold much of
    the table, put a block of positions into ``by``: a bucket is one task.
    """
    dealt = df.repartition(buckets, *by)  # one file a bucket
    dealt.write.bucketBy(buckets, *by).sortBy(*by, *order).saveAsTable(table)


def contig_arrays(features: DataFrame, columns: list[str], by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """SNK2: one row a contig, one array a feature in order of position, and its length."""
    rows = F.array_sort(F.collect_list(F.struct("position", *(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))))
    out = features.groupBy(*by).agg(rows.alias("r"))
    return out.select(*by, F.size("r").alias("length"), *(F.col("r")[f"c{k}"].alias(c) for k, c in enumerate(columns)))


def write_contig_arrays(features: DataFrame, path: str, columns: list[str], by: tuple[str, ...] = ("contig",)) -> None:
    """SNK2 as Parquet: readers take the columns they need."""
    contig_arrays(features, columns, by).write.parquet(path)


def breakpoints_text(breakpoints: str = "breakpoints") -> Column:
    """The array of (lo, hi) as ``a-b,c-d``, or ``-`` when empty."""
    text = F.array_join(F.transform(breakpoints, lambda b: F.concat_ws("-", b["lo"].cast("string"), b["hi"].cast("string"))), ",")
    return F.when(F.size(breakpoints) > 0, text).otherwise("-")


def write_toc(meta: DataFrame, path: str) -> None:
    """SNK3."""
    meta.select("contig", "length", "misassembly_cnt", "size_bytes", breakpoints_text().alias("breakpoints"), "avg_coverage").write.options(sep="\t", header=True).csv(path)


def write_stats_json(stats: DataFrame, path: str) -> None:
    """SNK4: one JSON object a row."""
    stats.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """SNK5: eight columns, and the embedding if there is one."""
    names = ["cont_name", "length", "label", "score", "min", "mean", "std", "max", *(["embedding"] if "embedding" in predictions.columns else [])]
    predictions.select(*names).write.options(header=True).csv(path)


def fasta_text(contig: str = "contig", seq: str = "seq", score: str | None = None) -> Column:
    """A record; with a score it says ``score=`` after the name."""
    head = F.concat(F.lit(">"), F.col(contig))
    if score:
        head = F.concat(head, F.lit(" score="), F.col(score).cast("string"))
    return F.concat(head, F.lit("\n"), F.col(seq))


def write_fasta(contigs: DataFrame, path: str, file: str | None = None, score: str | None = None, compression: str = "none", inputs: tuple[str, ...] = ()) -> None:
    """SNK6: records, in one folder for each input file if ``file`` names that column; the output must not be an input."""
    if path in inputs:
        raise ValueError("output and input are the same path")
    rows = contigs.select(*([file] if file else []), fasta_text(score=score).alias("value"))
    if file:
        rows.repartition(file).write.option("compression", compression).partitionBy(file).text(path)
    else:
        rows.write.option("compression", compression).text(path)


def write_feature_registry(files: DataFrame, path: str) -> None:
    """SNK7."""
    files.write.options(sep="\t", header=True).csv(path)
