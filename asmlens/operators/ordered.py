"""Running sums, numbers, ranks and quantiles over whole tables and hot groups, without ordering either in one task.

The rows are cut into ranges of the whole key: the group and its order, of any
types that Spark can order. A bounded random sample of keys says where, and the
number of ranges follows the number of rows. Sums of the ranges, one row a group
and range, are added up first; the windows then run within ranges only. Equal
keys share a range, so values that repeat are counted before they are ordered.

An order is a list of column names; a minus in front makes one descending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 1 << 18  # rows a range should have
SAMPLE = 4096  # keys in the sample at least; sixteen for each range


def _parsed(order: list[str]) -> list[tuple[str, bool]]:
    """Names and whether they descend."""
    return [(c.removeprefix("-"), c.startswith("-")) for c in order]


def _sorted(order: list[str]) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in _parsed(order)]


def range_edges(df: DataFrame, keys: list[str]) -> list[T.Row]:
    """Upper ends of ranges of about ``ROWS`` rows in ascending order of ``keys``, the last one's aside; few enough for a literal.

    One row tells the number of rows, and a sample in proportion to the ranges where they lie; a table of one range has no sample.
    (An ``Observation`` would tell both in one pass, but a session that has one can't serialise Spark ML's fitted models.)
    """
    rows = df.select(*keys)
    n = rows.count()
    ranges = -(-n // ROWS)
    if ranges < 2:
        return []
    found = rows.sample(min(1.0, max(SAMPLE, 16 * ranges) / n), 1).orderBy(*keys).collect()
    places = [len(found) * k // ranges for k in range(1, ranges)]
    return [found[p - 1] for p in dict.fromkeys(places) if p > 0]


def _range(df: DataFrame, keys: list[str], edges: list[T.Row]) -> Column:
    """How many edges lie below the row's keys, by halving steps."""
    if not edges:
        return F.lit(0)
    literal = lambda row: F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(keys, row)))
    known, steps = F.array(*map(literal, edges)), [1 << k for k in reversed(range(len(edges).bit_length()))]
    key = F.struct(*keys)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.try_element_at(known, at + step) < key, at + step).otherwise(at))


def ranged(df: DataFrame, by: list[str], order: list[str], into: str = "_range") -> DataFrame:
    """``df`` with the number of the range that its group and order lie in; ascending by the first columns of one direction."""
    parsed = _parsed(order)
    lead = [c for k, (c, _) in enumerate(parsed) if all(down == parsed[0][1] for _, down in parsed[: k + 1])]
    keys = list(dict.fromkeys([*by, *lead]))
    return df.withColumn(into, _range(df, keys, range_edges(df, keys)))


def _same(by: list[str]) -> list[Column]:
    return [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]


def with_group_values(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the other columns of ``groups``, which has one row a group; null is a group. Without ``by``, of its one row."""
    if not by:
        return df.join(F.broadcast(groups), F.lit(True))
    renamed = groups.withColumnsRenamed({b: f"_by_{b}" for b in by})
    return df.join(renamed, _same(by)).drop(*(f"_by_{b}" for b in by))


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds a column for each ``new: old`` of ``sums``: the sum of ``old`` up to and with each row, in order, within ``by``."""
    rows = ranged(df, by, order)
    turn = F.desc("_range") if _parsed(order)[0][1] else F.asc("_range")
    parts = rows.groupBy(*by, "_range").agg(*(F.sum(old).alias(f"_{new}") for new, old in sums.items()))
    before = Window.partitionBy(*by).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_range").alias("_part"), *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums))
    within = Window.partitionBy(*by, "_range").orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_in_{new}": F.sum(old).over(within) for new, old in sums.items()}).join(parts, [*_same(by), F.col("_range") == F.col("_part")])
    return out.withColumns({new: F.col(f"_in_{new}") + F.col(f"_{new}") for new in sums}).drop("_range", "_part", *(f"_by_{b}" for b in by), *(f"_{new}" for new in sums), *(f"_in_{new}" for new in sums))


def numbered(df: DataFrame, by: list[str], order: list[str], into: str) -> DataFrame:
    """Adds 1, 2, 3, … in order within ``by``."""
    return running_sums(df.withColumn("_one", F.lit(1)), by, order, {into: "_one"}).drop("_one")


def ranked(df: DataFrame, by: list[str], order: str, into: str, dense: bool = False) -> DataFrame:
    """Adds the rank by one column within ``by``: equal values share one; with gaps after them, or dense.

    Values are counted first, so a value that a hot group repeats is one row of the running sums. Rows meet their rank
    by value, so values must be equal whenever ``df`` is computed: write sums of doubles before they are ranked.
    """
    name = order.removeprefix("-")
    counts = df.groupBy(*by, name).agg(F.count("*").alias("_c")).withColumn("_one", F.lit(1))
    sums = running_sums(counts, by, [order], {"_upto": "_c", "_distinct": "_one"})
    rank = F.col("_distinct") if dense else F.col("_upto") - F.col("_c") + 1
    keys = list(dict.fromkeys([*by, name]))
    return with_group_values(df, sums.select(*keys, rank.alias(into)), keys)


def exact_quantiles(df: DataFrame, column: str | Column, q: list[float], by: list[str] | None = None, into: str = "q") -> DataFrame:
    """One row a group with the array ``into``: quantiles with linear interpolation, nulls skipped, null for a group without values.

    Values are counted, and the counts summed up range by range; no task holds a group's values, however many differ.
    """
    by = by or []
    value = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(*by, value.cast("double").alias("_value")).agg(F.count("*").alias("_c")).withColumn("_c", F.when(F.col("_value").isNull(), F.lit(0)).otherwise(F.col("_c")))
    sums = running_sums(counts, by, ["_value"], {"_upto": "_c"})
    rows = with_group_values(sums, counts.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    place = [(F.lit(float(p)) * F.greatest(F.col("_n") - 1, F.lit(0))) for p in q]
    holds = lambda at: (F.col("_upto") - F.col("_c") <= at) & (at < F.col("_upto"))
    near = [F.max(F.when(holds(f(p)), F.col("_value"))).alias(f"_{name}{k}") for k, p in enumerate(place) for name, f in (("low", F.floor), ("high", F.ceil))]
    share = [F.max(p - F.floor(p)).alias(f"_share{k}") for k, p in enumerate(place)]
    found = rows.groupBy(*by).agg(*near, *share)
    part = lambda k: F.when(F.col(f"_share{k}") == 0, F.col(f"_low{k}")).otherwise((1 - F.col(f"_share{k}")) * F.col(f"_low{k}") + F.col(f"_share{k}") * F.col(f"_high{k}"))
    return found.select(*by, F.array(*map(part, range(len(q)))).alias(into))


def quantile_sketches(df: DataFrame, column: str, by: list[str] | None = None, k: int = 800) -> DataFrame:
    """One row a group with a mergeable ``sketch`` of a column, a few kilobytes whatever the group's size.

    With k = 800 a quantile's rank is off by less than 0.5 % of the group's rows in 99 of 100 cases; twice the k is half of that.
    """
    return df.groupBy(*(by or [])).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts as one a group: those of files or days add up like sums."""
    return sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, q: list[float], into: str = "q") -> DataFrame:
    """The array ``into`` of approximate quantiles in place of ``sketch``."""
    return sketches.withColumn(into, F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(float(p)) for p in q)))).drop("sketch")
