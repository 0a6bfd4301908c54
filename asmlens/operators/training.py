"""Training-set construction (TRN1-TRN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.functions.columns import random_below, random_int
from asmlens.operators.ordered import numbered

MARGIN, LEAST_WINDOW = 50, 2000


def train_eval_split(ids: DataFrame, key: str = "contig", eval_percent: int = 10, seed: int = 0, eval_ids: DataFrame | None = None) -> DataFrame:
    """TRN1: adds ``split``: given ids (or a stable random share) are ``eval``, the others ``train``.

    The random form is decided row by row from the key's hash, so it needs no sort and no shuffle.
    """
    if eval_ids is not None:
        marked = eval_ids.select(F.col(key)).distinct().withColumn("chosen", F.lit(True))
        out = ids.join(marked, key, "left")
        return out.withColumn("split", F.when(F.col("chosen"), "eval").otherwise("train")).drop("chosen")
    return ids.withColumn("split", F.when(F.pmod(random_int(key, seed), F.lit(100)) < eval_percent, "eval").otherwise("train"))


def class_downsample(meta: DataFrame, frac_neg: float, key: str = "contig", label: str = "label", translations: int = 1, epoch: int = 0) -> DataFrame:
    """TRN2: all positives and the first ``floor(frac * n)`` negatives in hash order, each ``translations`` times.

    The cut is found from a histogram of hash prefixes, so only one prefix's rows are ranked in one place.
    """
    h = random_int(key, epoch)
    rows = meta.withColumn("h", h).withColumn("bin", F.floor(F.col("h") / (1 << 19)))
    neg = rows.where(F.col(label) == 0)
    bins = neg.groupBy("bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bins = bins.select("bin", before.alias("before"), F.floor(total * frac_neg).alias("want"))  # at most 4096 rows
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("h", key)) + F.col("before")
    kept = neg.join(bins, "bin").withColumn("r", rank).where(F.col("r") <= F.col("want")).drop("before", "want", "r")
    both = rows.where(F.col(label) == 1).unionByName(kept).drop("h", "bin")
    return both.withColumn("translation", F.explode(F.sequence(F.lit(1), F.lit(translations))))


def select_training_interval(meta: DataFrame, max_len: int, translate_short: bool = True, max_translation: int = 10, seed: int = 0, key: str = "contig") -> DataFrame:
    """TRN3: start_idx and end_idx of a random window that holds one random breakpoint.

    ``meta``: key, length, breakpoints array of (lo, hi); empty or null means clean.
    """
    least = min(LEAST_WINDOW, max_len)
    n, bps = F.col("length"), F.coalesce(F.col("breakpoints"), F.array().cast("array<struct<lo:int,hi:int>>"))
    has = F.size(bps) > 0
    b = F.try_element_at(bps, (1 + random_below(F.size(bps), key, seed + 1)).cast("int"))
    first = F.try_element_at(bps, F.lit(1))
    low = F.greatest(F.lit(0), b["hi"] - max_len + MARGIN)
    high = F.least(n - least, b["lo"] - MARGIN)
    with_break = F.when(F.lit(max_len) >= MARGIN + b["hi"] - b["lo"], low + random_below(high - low, key, seed)).otherwise(0)
    long_start = F.when(has, with_break).otherwise(random_below(n - least + 1, key, seed))
    shift = F.when(has, F.least(F.lit(max_translation + 1), F.greatest(F.lit(1), first["lo"] - MARGIN))).otherwise(max_translation + 1)
    short_start = random_below(shift, key, seed) if translate_short else F.lit(0)
    start = F.when(n > max_len, long_start).otherwise(short_start).cast("int")
    end = F.when(n > max_len, F.least(F.col("start_idx") + max_len, n)).otherwise(n).cast("int")
    return meta.withColumn("start_idx", start).withColumn("end_idx", end)


def slice_features(arrays: DataFrame, columns: list[str], max_len: int) -> DataFrame:
    """TRN4: feature arrays cut to [start_idx, end_idx), zeros up to ``max_len``, and mask_len."""
    n = F.col("end_idx") - F.col("start_idx")
    cut = lambda c: F.slice(F.col(c), F.col("start_idx") + 1, n)
    pad = lambda c: F.concat(cut(c), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(max_len) - F.size(cut(c)))))
    return arrays.withColumns({c: pad(c) for c in columns} | {"mask_len": n})


def length_weight(length: str | Column = "length", factor: float = 0) -> Column:
    """TRN5."""
    n = F.col(length) if isinstance(length, str) else length
    return F.least(F.lit(1.0), F.pow(n / factor, F.lit(2.0))) if factor > 0 else F.lit(1.0)


def batch_assign(df: DataFrame, batch_size: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """TRN6: batch numbers in order, the last batch partial; ``by`` numbers each shard on its own."""
    return numbered(df, by or [], order, "_k").withColumn("batch", F.floor((F.col("_k") - 1) / batch_size).cast("long")).drop("_k")


def random_labels(df: DataFrame, key: str = "contig", seed: int = 0) -> DataFrame:
    """TRN7: a 0/1 label, the same for all rows of a contig."""
    return df.withColumn("label", F.pmod(F.floor(random_int(key, seed) / 65536), F.lit(2)).cast("int"))


def conv_output_length(length: str | Column, layers: list[dict], pad: bool) -> Column:
    """TRN8: output length after layers of (kernel, stride, dilation, padding); layers of kernel 1 change nothing."""
    n = F.col(length) if isinstance(length, str) else length
    for layer in layers:
        k, s, d = layer["kernel"], layer.get("stride", 1), layer.get("dilation", 1)
        if k == 1:
            continue
        lost = (k - 1) * d if layer.get("padding", "valid") == "valid" else 0
        n = F.ceil((n - lost) / s) if pad else 1 + F.floor((n - k * d) / s)
    return n
