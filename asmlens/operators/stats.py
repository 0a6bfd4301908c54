"""Global statistics and normalisation (NRM1-NRM5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asmlens.operators.ordered import exact_quantiles, with_group_values

# The families of statistics and their parts.
FAMILIES, PARTS = ("insert_size", "mapq", "al_score"), ("min", "mean", "stdev", "max")
MATCH_STATS = tuple(f"{p}_{f}_Match" for f in FAMILIES for p in PARTS)
EXTRA = ("coverage", "seq_window_entropy", "seq_window_perc_gc")
LOW_STDEV = 1e-3
INSERT_BOUNDS = (117, 493)


def sufficient_stats(features: DataFrame, by: list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
    """NRM1: all_count, mean_cnt, stdev_cnt and each column's sum and sum of squares.

    Nulls are skipped, so deviations have their own count. All are sums: partial results of any split add up.
    """
    columns = columns or tuple(c for c in (*MATCH_STATS, *EXTRA) if c in features.columns)
    out = [F.count("*").alias("all_count")]
    for name, flag in (("mean_cnt", "mean_mapq_Match"), ("stdev_cnt", "stdev_mapq_Match")):
        if flag in features.columns:
            out.append(F.count(flag).alias(name))
    for c in columns:
        x = F.col(c).cast("double")
        out += [F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_sum"), F.sum(x * x).alias(f"{c}_sum2")]
    return features.groupBy(*by).agg(*out)


def merge_stats(stats: DataFrame, columns: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """NRM2: sums over files, then means and population deviations; a small negative variance is 0."""
    sums = stats.groupBy(*(by or [])).agg(*(F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in columns for k in ("n", "sum", "sum2")))
    out = {}
    for c in columns:
        n, s, q = F.nullif(F.col(f"{c}_n"), F.lit(0)), F.col(f"{c}_sum"), F.col(f"{c}_sum2")
        out |= {f"{c}_mean": s / n, f"{c}_stdev": F.sqrt(F.greatest(F.lit(0.0), n * q - s * s)) / n}
    return sums.select(*(by or []), *(v.alias(k) for k, v in out.items()))


def zscore_column(x: Column, mean: Column, stdev: Column, fill_low_stdev: bool = True) -> Column:
    low = stdev <= LOW_STDEV
    z = F.when(low, x - mean).otherwise((x - mean) / stdev)
    return F.coalesce(z, F.lit(0.0)) if fill_low_stdev else F.when(low, z).otherwise(F.coalesce(z, F.lit(0.0)))


def zscore(features: DataFrame, normalizer: DataFrame, columns: tuple[str, ...], fill_low_stdev: bool = True) -> DataFrame:
    """NRM3: z-scores by the one row of ``merge_stats``; columns without statistics stay as they are.

    A deviation of at most 0.001 centres without scaling; missing values become 0.
    """
    known = [c for c in columns if f"{c}_mean" in normalizer.columns]
    rows = with_group_values(features, normalizer.select(*(F.col(f"{c}_{k}").alias(f"_{c}_{k}") for c in known for k in ("mean", "stdev"))), [])
    scored = {c: F.when(F.col(f"_{c}_mean").isNull(), F.col(c).cast("double")).otherwise(zscore_column(F.col(c).cast("double"), F.col(f"_{c}_mean"), F.col(f"_{c}_stdev"), fill_low_stdev)) for c in known}
    return rows.withColumns(scored).select(*features.columns)


def recompute_meta(features: DataFrame, by: list[str]) -> DataFrame:
    """NRM4: mean coverage of each contig, five decimals, and its length."""
    return features.groupBy(*by, "contig").agg(F.count("*").alias("length"), F.round(F.avg("coverage"), 5).alias("avg_coverage"))


def insert_size_gate(features: DataFrame, column: str = "mean_insert_size_Match", bounds: tuple[float, float] = INSERT_BOUNDS) -> DataFrame:
    """NRM5: 4, 5, 95 and 96 % quantiles against the bounds: safe, borderline or reject."""
    q = exact_quantiles(features, column, [0.04, 0.05, 0.95, 0.96])
    lo, hi = bounds
    inner = (F.col("q")[1] >= lo) & (F.col("q")[2] <= hi)
    outer = (F.col("q")[0] >= lo) & (F.col("q")[3] <= hi)
    return q.select(*(F.col("q")[k].alias(n) for k, n in enumerate(("q04", "q05", "q95", "q96"))), F.when(outer, "safe").when(inner, "borderline").otherwise("reject").alias("verdict"))
