"""Relational analysis over result tables (PRJ, FIL, JN, AG, WN, SR, ST, RS).

Thin, named forms of what analyses of assembly errors do with their tables;
Catalyst chooses joins and exchanges. Random choices depend on keys and seeds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.functions.columns import random_int
from asmlens.operators.ordered import exact_quantiles, numbered, quantile_sketches, ranked, sketch_quantiles, with_group_values

RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")


# --- projections and filters


def relocate(df: DataFrame, first: list[str], drop: tuple[str, ...] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """PRJ1: named columns first, some dropped, some renamed."""
    rest = [c for c in df.columns if c not in first and c not in drop]
    return df.select(*first, *rest).withColumnsRenamed(rename or {})


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """PRJ2."""
    return df.withColumns(columns)


def feature_subset(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """PRJ3 (UDX3): keys and the chosen features, so that only those are read."""
    return df.select(*keys, *features)


def split_taxonomy(df: DataFrame, column: str = "taxonomy") -> DataFrame:
    """PRJ4: seven ranks from ``d__A;p__B;…``, prefixes stripped."""
    parts = F.split(F.regexp_replace(column, "(^|;)[a-z]__", "$1"), ";")
    return df.withColumns({r: F.try_element_at(parts, F.lit(k + 1)) for k, r in enumerate(RANKS)})


def unite(df: DataFrame, columns: list[str], into: str, sep: str = "-") -> DataFrame:
    """PRJ5."""
    return df.withColumn(into, F.concat_ws(sep, *columns))


def separate(df: DataFrame, column: str, into: list[str], sep: str = "/") -> DataFrame:
    """PRJ6."""
    parts = F.split(column, sep)
    return df.withColumns({c: F.try_element_at(parts, F.lit(k + 1)) for k, c in enumerate(into)})


def within(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """FIL1: every column inside [low, high]; None leaves a side open."""
    for c, (lo, hi) in ranges.items():
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    return df


def in_set(df: DataFrame, column: str, values: list, negate: bool = False) -> DataFrame:
    """FIL2."""
    hit = F.col(column).isin(*values)
    return df.where(~hit if negate else hit)


def matching(df: DataFrame, column: str, pattern: str, negate: bool = False) -> DataFrame:
    """FIL3."""
    hit = F.col(column).rlike(pattern)
    return df.where(~hit if negate else hit)


def filled(df: DataFrame, column: str) -> DataFrame:
    """FIL4: neither null nor empty."""
    return df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))


def size_class(files: DataFrame, size: str = "size", small: int = 1000, empty: int = 50) -> DataFrame:
    """FIL5: ``empty`` up to 50 bytes, ``small`` below 1000, else ``ok``."""
    return files.withColumn("size_class", F.when(F.col(size) <= empty, "empty").when(F.col(size) < small, "small").otherwise("ok"))


def near_duplicate_hits(hits: DataFrame, identity: float = 0.99, coverage: float = 0.95) -> DataFrame:
    """FIL6: alignments of almost equal contigs."""
    return hits.where((F.col("identity") >= identity) & (F.col("query_cov") >= coverage) & (F.col("target_cov") >= coverage))


def read_quality_gate(reads: DataFrame, least: float = 1e6, below: float = 5e7, longest: int = 150, dedup: float = 90) -> DataFrame:
    """FIL7."""
    return reads.where((F.col("n_reads") >= least) & (F.col("n_reads") < below) & (F.col("read_len") <= longest) & (F.col("dedup_percent") < dedup))


# --- joins


def join_on(left: DataFrame, right: DataFrame, keys: dict[str, str] | list[str], how: str = "inner") -> DataFrame:
    """JN1-JN6: equi-join; a dict maps left keys to right keys, and the left names stay."""
    if isinstance(keys, dict):
        right = right.withColumnsRenamed({r: k for k, r in keys.items()})
        keys = list(keys)
    return left.join(right, keys, how)


def grid(*tables: DataFrame, most_rows: int = 100_000_000) -> DataFrame:
    """JN8: all combinations of value tables, whose number is checked first: more than ``most_rows`` raise an error."""
    n = math.prod(t.count() for t in tables)
    if n > most_rows:
        raise ValueError(f"{n} combinations are more than {most_rows}")
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out


def validated_lookup(rows: DataFrame, lookup: DataFrame, key: str, amount: str) -> tuple[DataFrame, DataFrame]:
    """JN9: rows with a positive amount joined to the lookup, and the keys it lacks."""
    rows = rows.where(F.col(amount) > 0)
    return rows.join(lookup, key), rows.join(lookup, key, "left_anti").select(key).distinct()


def require_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN10: the inner join; an error if it is empty."""
    out = left.join(right, key)
    if out.isEmpty():
        raise ValueError(f"no common values of {key}")
    return out


def remap_ids(df: DataFrame, mapping: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """JN11: ids replaced by the mapping; unmapped ids stay."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


# --- aggregations


def group_count(df: DataFrame, by: list[str]) -> DataFrame:
    """AG1: greatest groups first."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def group_means(df: DataFrame, by: list[str], columns: list[str], length: str | None = None) -> DataFrame:
    """AG2 and AG14: means of columns, and the greatest position as length."""
    more = [F.max(length).alias("length")] if length else []
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns), *more)


def distinct_count(df: DataFrame, by: list[str], column: str, approximate: bool = False) -> DataFrame:
    """AG3."""
    return df.groupBy(*by).agg((F.approx_count_distinct(column) if approximate else F.count_distinct(column)).alias("n_distinct"))


def first_by(df: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """AG4: the row that is first in order."""
    key = F.struct(*order)
    return df.groupBy(*by).agg(*(F.min_by(c, key).alias(c) for c in columns))


def percent_where(df: DataFrame, by: list[str], condition: Column, weight: Column | None = None) -> DataFrame:
    """AG5: the percent of rows, or of weight, that meets a condition."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return df.groupBy(*by).agg((100 * F.sum(F.when(condition, w).otherwise(0.0)) / F.nullif(F.sum(w), F.lit(0.0))).alias("percent"))


def depth_summary(df: DataFrame, by: list[str], column: str = "depth") -> DataFrame:
    """AG6: mean, sd, n, standard error and share of zeros."""
    x = F.col(column)
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("stderr"), (F.count_if(x == 0) / F.count(x)).alias("zero_fraction"))


def five_numbers(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """AG7: quartiles, ends, mean, sd and standard error."""
    x = F.col(column)
    out = df.groupBy(*(by or [])).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("stderr"))
    out = with_group_values(out, exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0], by), by or [])
    return out.select(*(by or []), *(F.col("q")[k].alias(n) for k, n in enumerate(("min", "q1", "median", "q3", "max"))), "mean", "sd", "stderr")


def quantiles(df: DataFrame, column: str, q: list[float], by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """AG8: exact, or from a sketch of a few kilobytes a group (see ``quantile_sketches``)."""
    found = sketch_quantiles(quantile_sketches(df, column, by), q) if approximate else exact_quantiles(df, column, q, by)
    return found.select(*(by or []), F.posexplode("q").alias("k", "value"))


def frequency_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG9."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def composition(df: DataFrame, dataset: str, group: str, least_percent: float = 1.0, other: str = "Other") -> DataFrame:
    """AG10: percent of each group within its dataset; groups below the limit are one."""
    counts = df.groupBy(dataset, group).agg(F.count("*").alias("n"))
    p = counts.withColumn("p", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(dataset)))
    return p.withColumn(group, F.when(F.col("p") < least_percent, other).otherwise(F.col(group))).groupBy(dataset, group).agg(F.sum("p").alias("percent"))


def paf_summary(hits: DataFrame) -> DataFrame:
    """AG11: per query: hits, chimeric, summed hit length and mismatches, and their ratio."""
    out = hits.groupBy("query").agg(F.count("*").alias("hits"), F.sum("hit_len").alias("hit_len"), F.sum("nm").alias("nm"))
    return out.withColumn("chimeric", F.col("hits") > 1).withColumn("nm_ratio", F.col("nm") / F.nullif(F.col("hit_len"), F.lit(0)))


def run_totals(runs: DataFrame, by: list[str], seconds: str = "s", cpu: str = "cpu_time", memory_mb: str = "max_vms") -> DataFrame:
    """AG12: hours, CPU hours and gigabytes."""
    return runs.groupBy(*by).agg((F.sum(seconds) / 3600).alias("hours"), (F.sum(cpu) / 3600).alias("cpu_hours"), (F.max(memory_mb) / 1024).alias("max_gb"))


def throughput(counts: DataFrame, times: DataFrame, key: str, by: list[str], n: str = "n", seconds: str = "s") -> DataFrame:
    """AG13: contigs a second: mean and deviation by class."""
    rate = counts.join(times, key).withColumn("rate", F.col(n) / F.nullif(F.col(seconds), F.lit(0)))
    return rate.groupBy(*by).agg(F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("sd_rate"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """AG15."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def table_difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """AG16: per column: rows on one side only, unequal rows, and the greatest absolute difference."""
    a = left.select(*keys, F.lit(1).alias("_l"), *(F.col(c).cast("double").alias(f"{c}_l") for c in columns))
    b = right.select(*keys, F.lit(1).alias("_r"), *(F.col(c).cast("double").alias(f"{c}_r") for c in columns))
    both = a.join(b, keys, "full")
    one = F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("one_sided")
    pair = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    rows = both.select("_l", "_r", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_l").alias("l"), F.col(f"{c}_r").alias("r")) for c in columns))).alias("x")).select("_l", "_r", "x.*")
    return rows.groupBy("column").agg(one, F.count_if(pair & ~F.col("l").eqNullSafe(F.col("r"))).alias("unequal"), F.coalesce(F.max(F.abs(F.col("l") - F.col("r"))), F.lit(0.0)).alias("max_abs_diff"))


def genome_summary(contigs: DataFrame, by: list[str], length: str = "length", coverage: str = "avg_coverage") -> DataFrame:
    """AG17."""
    n, c = F.col(length), F.col(coverage)
    return contigs.groupBy(*by).agg(F.count("*").alias("n_contigs"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(c).alias("mean_coverage"), F.stddev_samp(c).alias("sd_coverage"))


def top_mean(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """AG18: groups of the greatest mean."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), *by).limit(n)


def positive_groups_with_null(df: DataFrame, by: list[str], value: str, null_curve: DataFrame, rank: str = "rank") -> DataFrame:
    """AG19: rows of groups with a positive total, with the null curve's value of their rank."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("_total")).where("_total > 0").select(*by)
    return df.join(sums, by, "left_semi").join(null_curve, rank, "left")


# --- windows, ranks, sorting


def with_group_size(df: DataFrame, by: list[str], distinct: str | None = None) -> DataFrame:
    """WN1: group size (and distinct count) on each row, by an aggregate joined back, which large groups survive."""
    more = [F.count_distinct(distinct).alias("group_distinct")] if distinct else []
    return df.join(df.groupBy(*by).agg(F.count("*").alias("group_size"), *more), by)


def two_ranks(df: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """WN2: dense ranks by two columns; a minus in front of a name makes its order descend."""
    return ranked(ranked(df, by, first, "rank_1", dense=True), by, second, "rank_2", dense=True)


def running_index(df: DataFrame, by: list[str], order: list[str], into: str = "index") -> DataFrame:
    """WN3 and WN8: 1, 2, 3, … within each group; ranges number a large one in many tasks."""
    return numbered(df, by, order, into)


def random_per_group(df: DataFrame, by: list[str], n: int, key: str, seed: int = 0, keep: Column | None = None) -> DataFrame:
    """WN4: n random rows of each group, or the first ``keep`` of them. Each task sends at most n rows a group."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))
    out = df.withColumn("_h", random_int(key, seed)).withColumn("_r", turn).where(F.col("_r") <= n)
    return (out if keep is None else out.where(F.col("_r") <= keep)).drop("_h", "_r")


def random_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """WN5."""
    return df.orderBy(random_int(key, seed), key).limit(n)


def random_cap_per_group(df: DataFrame, group: str, key: str, most: int = 50, seed: int = 0) -> DataFrame:
    """WN6: each group keeps a random number, from 1 to ``most``, of random rows."""
    return random_per_group(df, [group], most, key, seed, 1 + F.pmod(random_int(group, seed + 1), F.lit(most)))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """WN7, SR1 and SR2: the first k rows in an order of several keys."""
    return df.orderBy(*order).limit(k)


def percent_of_total(df: DataFrame, sample: str, value: str) -> DataFrame:
    """WN12: percent of the sample's total, positive values only.

    Rows meet their total by the sample alone, never by the value: a sum of doubles that is computed twice may differ in its last bit.
    """
    rows = df.where(F.col(value) > 0)
    rows = with_group_values(rows, rows.groupBy(sample).agg(F.sum(value).alias("_total")), [sample])
    return rows.withColumn("percent", 100 * F.col(value) / F.col("_total")).drop("_total")


def abundance_rank(df: DataFrame, sample: str, value: str) -> DataFrame:
    """WN10: percent of the sample's total and rank with gaps, positive values only. Values must be stored ones (see ``ranked``)."""
    return ranked(percent_of_total(df, sample, value), [sample], f"-{value}", "rank")


def first_n_of_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """WN11: each task sends at most n rows a group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


# --- set operations and reshaping


def tagged_union(tables: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """ST1: union by name; columns that a table lacks are null."""
    parts = [t.withColumn(tag, F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def overlap_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """ST2: shared keys, keys of one side only, and all."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()  # noqa: E741
    return both.agg(F.count_if(l & r).alias("shared"), F.count_if(l & ~r).alias("only_left"), F.count_if(~l & r).alias("only_right"), F.count("*").alias("total"))


def distinct_on(df: DataFrame, columns: list[str]) -> DataFrame:
    """ST3."""
    return df.select(*columns).distinct()


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """ST4: the first row in order of each key."""
    others = [c for c in df.columns if c not in keys]
    row = F.min(F.struct(*order, *(c for c in others if c not in order))).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others))


def group_split(df: DataFrame, group: str, shares: dict[str, int], seed: int = 0) -> DataFrame:
    """ST5: whole groups to named splits by percent; what is left over is ``rest``."""
    u, low, out = F.pmod(random_int(group, seed), F.lit(100)), 0, F.lit("rest")
    for name, share in reversed(list(shares.items())):
        low = sum(s for n, s in list(shares.items())[: list(shares).index(name)])
        out = F.when((u >= low) & (u < low + share), name).otherwise(out)
    return df.withColumn("split", out)


def missing_combinations(observed: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """ST6: combinations of the value tables that were not observed."""
    return grid(*(t.select(c).distinct() for c, t in lists.items())).join(observed, list(lists), "left_anti")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """ST7."""
    return left.join(right, keys, "left_anti")


def longer(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """RS1."""
    return df.unpivot(ids, columns, name, value)


def wider(df: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """RS2: one column a name, 0 where there is nothing."""
    out = df.groupBy(*ids).pivot(name, names).agg(F.sum(value))
    return out.fillna(0, [str(n) for n in names])


def percent_shared(df: DataFrame, partition: str, two: tuple, ranks: list[str]) -> DataFrame:
    """RS3: per rank and taxon: 100 * min(a, b) / ((a + b) / 2) of the two partitions' counts."""
    rows = df.select(partition, F.explode(F.array(*(F.struct(F.lit(r).alias("level"), F.col(r).cast("string").alias("taxon")) for r in ranks))).alias("x")).select(partition, "x.*")
    n = lambda v: F.count_if(F.col(partition) == v).cast("double")
    counts = rows.groupBy("level", "taxon").agg(n(two[0]).alias("a"), n(two[1]).alias("b")).where("a + b > 0")
    return counts.withColumn("percent_shared", 100 * F.least("a", "b") / ((F.col("a") + F.col("b")) / 2))


def row_per_item(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """RS4."""
    return df.withColumn(column, F.explode(F.split(column, sep)))
