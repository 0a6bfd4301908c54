"""Sequence windows and statistics (SEQ1-SEQ3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.functions.columns import chunk_starts
from asmlens.operators.ordered import exact_quantiles
from asmlens.operators.pileup import base_class


def entropy_bits(counts: list[Column]) -> Column:
    """Shannon entropy of a few counts; 0 if all are 0."""
    total = sum(counts[1:], counts[0])
    part = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)
    return F.when(total > 0, F.log2(total) - sum((part(n) for n in counts[1:]), part(counts[0])) / total).otherwise(0.0)


def window_letters(part: str, first: str, w: str, n: str) -> Column:
    """The ``w`` letters of the window at ``position`` of a sequence of ``n``, of which the binary ``part`` begins at ``first``."""
    position, n = F.col("position"), F.col(n)
    forward = (position < F.floor(n / 2)) | (n == 1)
    start = F.when(forward, position).otherwise(position - F.col(w) + 1)
    return F.substring(part, start - F.col(first) + 1, F.col(w)).cast("string")


def letter_count(win: str, letter: str) -> Column:
    return (F.octet_length(win) - F.octet_length(F.replace(F.col(win), F.lit(letter), F.lit("")))).cast("double")


def window_stats(counts: list[Column]) -> tuple[Column, Column]:
    """Entropy and share of G and C out of the counts of A, C, G and T."""
    total = sum(counts[1:], counts[0])
    return entropy_bits(counts), F.when(total > 0, (counts[1] + counts[2]) / total).otherwise(0.0)


def sequence_window(contigs: DataFrame, w: int = 6, seq: str = "seq", chunk: int = 10_000, base: str | None = None) -> DataFrame:
    """SEQ1: (…, position, seq_window_entropy, seq_window_perc_gc), without a shuffle; ``base`` names a column for the base itself.

    The window looks forward in the first half and back in the second; it shrinks
    to half of a short sequence, and to 1 for a single base. Bases outside ACGTU
    are ignored. Long sequences are cut into overlapping binary chunks first, where
    a window is found in one step.
    """
    keys = [c for c in contigs.columns if c not in (seq, "length")]
    rows = contigs.select(*keys, F.translate(F.upper(F.col(seq)), "U", "T").cast("binary").alias("s"), F.col(seq).cast("binary").alias("raw")).withColumn("n", F.octet_length("s"))
    rows = rows.withColumn("w", F.greatest(F.lit(1), F.least(F.lit(w), F.floor(F.col("n") / 2).cast("int"))))
    rows = rows.select(*keys, "n", "w", "s", "raw", F.explode(chunk_starts("n", chunk)).alias("low"))
    rows = rows.withColumn("base", F.greatest(F.lit(0), F.col("low") - w))
    rows = rows.select(*keys, "n", "w", "low", "base", F.substring("s", F.col("base") + 1, F.lit(chunk + 2 * w)).alias("part"), F.substring("raw", F.col("low") + 1, F.lit(chunk)).alias("own"))
    place = rows.select(*keys, "n", "w", "part", "base", "low", "own", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + chunk, F.col("n")) - 1)).alias("position"))
    bases = [F.substring("own", F.col("position") - F.col("low") + 1, F.lit(1)).cast("string").alias(base)] if base else []
    place = place.select(*keys, "position", *bases, window_letters("part", "base", "w", "n").alias("win"))
    keys = [*keys, "position", *([base] if base else [])]
    place = place.select(*keys, *(letter_count("win", b).alias(f"_{b}") for b in "ACGT"))
    entropy, gc = window_stats([F.col(f"_{b}") for b in "ACGT"])
    return place.select(*keys, entropy.alias("seq_window_entropy"), gc.alias("seq_window_perc_gc"))


def one_hot_base(df: DataFrame, column: str = "ref_base") -> DataFrame:
    """SEQ2: four 0/1 columns."""
    return df.withColumns({f"{column}_{b}": (F.coalesce(base_class(column), F.lit("N")) == b).cast("int") for b in "ACGT"})


def seq_stats(seqs: DataFrame, by: list[str], seq: str = "seq", qual: str | None = None) -> DataFrame:
    """SEQ3: number, total, least, mean and greatest length, quartiles, N50, GC percent, and with qualities Q20 and Q30 percent."""
    s = F.upper(F.col(seq))
    rows = seqs.select(*by, F.length(s).alias("n"), (F.length(s) - F.length(F.translate(s, "GC", ""))).alias("gc"), *([F.col(qual).alias("q")] if qual else []))
    columns = [
        F.count("*").alias("num_seqs"),
        F.sum("n").alias("sum_len"),
        F.min("n").alias("min_len"),
        F.avg("n").alias("avg_len"),
        F.max("n").alias("max_len"),
        (100 * F.sum("gc") / F.nullif(F.sum("n"), F.lit(0))).alias("gc_percent"),
    ]
    if qual:
        above = lambda least: F.sum(F.size(F.filter(F.split("q", ""), lambda c: (F.length(c) > 0) & (F.ascii(c) - 33 >= least))))
        columns += [(100 * above(k) / F.nullif(F.sum(F.length("q")), F.lit(0))).alias(f"q{k}_percent") for k in (20, 30)]
    quarters = exact_quantiles(rows, "n", [0.25, 0.5, 0.75], by).select(*by, *(F.col("q")[k].alias(f"q{k + 1}") for k in range(3)))
    return rows.groupBy(*by).agg(*columns).join(quarters, by).join(n50(rows, by, "n"), by)


def n50(rows: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """The greatest length such that sequences at least as long hold half of all bases.

    Lengths are counted first, so that the window runs over distinct lengths only.
    """
    sizes = rows.groupBy(*by, F.col(length).alias("l")).agg(F.sum(length).alias("b"))
    w = Window.partitionBy(*by)
    down = sizes.withColumn("upto", F.sum("b").over(w.orderBy(F.desc("l")))).withColumn("all", F.sum("b").over(w))
    return down.where(F.col("upto") * 2 >= F.col("all")).groupBy(*by).agg(F.max("l").alias("n50"))
