"""Evaluation metrics (EVL1-EVL11).

Scores are counted by value first, and running sums over the distinct scores are
made range by range, so that no task orders all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.operators.ordered import exact_quantiles, running_sums, with_group_values


def recall_by_class(preds: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """EVL1: recall of class 1 (score > threshold) and of class 0; null for a class without rows."""
    one, hit = F.col("label") == 1, F.col("score") > threshold
    return preds.groupBy(*(by or [])).agg((F.count_if(one & hit) / F.nullif(F.count_if(one), F.lit(0))).alias("recall_1"), (F.count_if(~one & ~hit) / F.nullif(F.count_if(~one), F.lit(0))).alias("recall_0"))


def score_steps(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per distinct score: its positives p and negatives n, true and false positives among scores at least as high, and both totals."""
    by = by or []
    counts = preds.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("n"))
    totals = counts.groupBy(*(F.col(b).alias(f"_{b}") for b in by)).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    steps = running_sums(counts, by, ["-score"], {"tp": "p", "fp": "n"})
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] or F.lit(True)
    return steps.join(F.broadcast(totals) if not by else totals, same).select(*by, "score", "p", "n", "tp", "fp", "pos", "neg")


def pr_curve(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL3's points: (threshold, recall, precision)."""
    s = score_steps(preds, by)
    return s.select(*(by or []), F.col("score").alias("threshold"), (F.col("tp") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def _ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.nullif(b, F.lit(0))


def average_precision(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL2: sum of recall steps times precision, ties together."""
    part = _ratio("p", "pos") * _ratio("tp", F.col("tp") + F.col("fp"))
    return score_steps(preds, by).groupBy(*(by or [])).agg(F.sum(part).alias("average_precision"))


def pr_area(preds: DataFrame, by: list[str] | None = None, interpolate: bool = False) -> DataFrame:
    """EVL3's area: by trapezoids (the curve starts at precision 1), or interpolated.

    Interpolated, false positives grow in proportion to the true ones between two points, so precision follows a
    curve; its integral over a step of true positives has a closed form. Up to the first point precision is constant.
    """
    if interpolate:
        d, low, c = F.col("p").cast("double"), (F.col("tp") - F.col("p")).cast("double"), (F.col("tp") - F.col("p") + F.col("fp") - F.col("n")).cast("double")
        slope = 1 + F.col("n") / F.nullif(d, F.lit(0.0))
        curve = d / slope + (low - c / slope) / slope * F.log(1 + slope * d / F.nullif(c, F.lit(0.0)))
        step = F.when(d == 0, 0.0).when(c == 0, d / slope).otherwise(curve) / F.nullif(F.col("pos"), F.lit(0))
        return score_steps(preds, by).groupBy(*(by or [])).agg(F.sum(step).alias("pr_area"))
    before = F.coalesce(_ratio(F.col("tp") - F.col("p"), F.col("tp") - F.col("p") + F.col("fp") - F.col("n")), F.lit(1.0))
    part = _ratio("p", "pos") * (_ratio("tp", F.col("tp") + F.col("fp")) + before) / 2
    return score_steps(preds, by).groupBy(*(by or [])).agg(F.sum(part).alias("pr_area"))


def roc_curve(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL4's points: (threshold, fpr, tpr)."""
    s = score_steps(preds, by)
    return s.select(*(by or []), F.col("score").alias("threshold"), (F.col("fp") / F.nullif(F.col("neg"), F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif(F.col("pos"), F.lit(0))).alias("tpr"))


def roc_auc(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL4's area; equals the rank statistic."""
    part = _ratio("n", "neg") * (_ratio("tp", "pos") + _ratio(F.col("tp") - F.col("p"), "pos")) / 2
    return score_steps(preds, by).groupBy(*(by or [])).agg(F.sum(part).alias("roc_auc"))


def confusion_counts(preds: DataFrame, by: list[str], threshold: float | None = 0.8, quantile: float | None = None) -> DataFrame:
    """EVL5: tp, tn, fp, fn by group; the threshold is fixed or a quantile of the group's scores."""
    rows = preds
    if quantile is not None:
        rows = with_group_values(rows, exact_quantiles(preds, "score", [quantile], by, "cut").withColumn("cut", F.col("cut")[0]), by)
    else:
        rows = rows.withColumn("cut", F.lit(threshold))
    one, hit = F.col("label") == 1, F.col("score") >= F.col("cut")
    return rows.groupBy(*by).agg(F.count_if(one & hit).alias("tp"), F.count_if(~one & ~hit).alias("tn"), F.count_if(~one & hit).alias("fp"), F.count_if(one & ~hit).alias("fn"))


def accuracy(confusion: DataFrame) -> DataFrame:
    """EVL6."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return confusion.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.nullif(total, F.lit(0)))


def score_truth_join(scores: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """EVL7: every truth row with its score, 0 if there is none."""
    return scores.join(truth, on, "right").withColumn("score", F.coalesce("score", F.lit(0.0)))


def split_by_truth_list(preds: DataFrame, ids: DataFrame, on: str = "contig") -> DataFrame:
    """EVL8: size, mean, deviation, least and greatest score inside and outside an id list, and the true error rate."""
    marked = ids.select(on).distinct().withColumn("listed", F.lit(True))
    rows = preds.join(marked, on, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    s = F.col("score")
    return rows.groupBy("listed").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg("label").alias("error_rate"))


def before_after_ratio(reports: DataFrame, by: list[str], metric: str = "metric", stage: str = "stage", value: str = "value") -> DataFrame:
    """EVL9: value after over value before for each metric."""
    at = lambda name: F.max(F.when(F.col(stage) == name, F.col(value)))
    out = reports.groupBy(*by, metric).agg(at("before").alias("before"), at("after").alias("after"))
    return out.withColumn("ratio", F.col("after") / F.nullif(F.col("before"), F.lit(0)))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal for z >= 0 by a five-term polynomial (absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def exact_rank_sum_p(w: float, n1: int, n2: int) -> float:
    """Two-sided p of W (untied) by the number of ways to reach each sum: choosing one more row multiplies the ways by a polynomial."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for k in range(1, n1 + 1):  # ways times (1 - x^(n2 + k)) / (1 - x^k)
        ways[n2 + k :] -= ways[: len(ways) - n2 - k].copy()
        for low in range(k):
            ways[low::k] = np.cumsum(ways[low::k])
    share = ways / ways.sum()
    tail = share[: int(w) + 1].sum() if w <= n1 * n2 / 2 else share[int(w) :].sum()
    return float(min(1.0, 2 * tail))


def rank_sum_test(df: DataFrame, group: str, first: str, value: str = "value", by: list[str] | None = None, exact_below: int = 50) -> DataFrame:
    """EVL10: W of the rows of group ``first`` against the others, and a two-sided p: exact for fewer than ``exact_below``
    rows on both sides without ties, else by mid-ranks, tie-corrected and continuity-corrected normal.

    Values are counted first; ranks are running sums over the distinct values.
    """

    @F.pandas_udf("double")
    def exact(w: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([exact_rank_sum_p(*row) for row in zip(w, n1, n2)], dtype="float64")

    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"), F.count_if(F.col(group) == first).alias("c1"))
    ranked = running_sums(counts, by, [value], {"upto": "c"}).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2)
    c = F.col("c").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("c1").alias("n1"), F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum(c * c * c - c).alias("ties"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    stat = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    diff = stat - n1 * n2 / 2
    z = (diff - F.signum(diff) * 0.5) / F.nullif(sigma, F.lit(0.0))  # null where all values are equal
    rows = sums.select(*by, stat.alias("w"), z.alias("z"), F.least(F.lit(1.0), 2 * normal_tail(F.abs(z))).alias("p_value"), n1.cast("int").alias("n1"), n2.cast("int").alias("n2"), "ties")
    small = (F.col("ties") == 0) & F.col("n1").between(1, exact_below - 1) & F.col("n2").between(1, exact_below - 1)
    side = lambda c: F.when(small, F.col(c)).otherwise(1)  # noqa: E731  (the function sees sizes below the bound only)
    return rows.withColumn("_exact", exact(F.when(small, F.col("w")).otherwise(0.0), side("n1"), side("n2"))).select(*by, "w", "z", F.when(small, F.col("_exact")).otherwise(F.col("p_value")).alias("p_value"))


def best_epoch(epochs: DataFrame, by: list[str], epoch: str = "epoch", ap: str = "ap", rate: float = 1e-3, drop: float = 0.8, after: int = 10) -> DataFrame:
    """EVL11: the epoch of best average precision, and the learning rate after all drops that follow epoch ``after``."""
    w = Window.partitionBy(*by).orderBy(epoch)
    fell = ((F.col(ap) < F.lag(ap).over(w)) & (F.col(epoch) > after)).cast("int")
    rows = epochs.withColumn("fell", F.coalesce(fell, F.lit(0)))
    return rows.groupBy(*by).agg(F.max_by(epoch, F.struct(F.col(ap), -F.col(epoch))).alias("best_epoch"), F.max(ap).alias("best_ap"), (rate * F.pow(F.lit(drop), F.sum("fell"))).alias("final_rate"))
