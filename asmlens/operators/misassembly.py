"""Misassembly intervals and labels (MIS1-MIS9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.functions.columns import random_below
from asmlens.operators.pileup import KEYS

# The four types, in the order of their bits.
TYPES = ("relocation", "translocation", "inversion", "interspecies translocation")
MOST_GAP = 50
LINE = r"Extensive misassembly \( ?([a-z ]+?) ?(?:,[^)]*)?\) between (\d+) (\d+) and (\d+) (\d+)"


def type_bit(name: str = "type") -> Column:
    """1, 2, 4 or 8 for the four types, else 0."""
    out = F.lit(0)
    for k, kind in enumerate(TYPES):
        out = F.when(F.col(name) == kind, 1 << k).otherwise(out)
    return out


def parse_misassembly(lines: DataFrame, line: str = "line", strand: str = "swap", length: str | None = None, drop_second_interspecies: bool = False) -> DataFrame:
    """MIS1: report lines to rows (…, part, type, start, end, break_start, break_end); lines of another form give none.

    Each interval carries whether it was reversed, also through the sort of the two.
    ``strand="mirror"`` reflects reversed intervals on the contig's ``length`` instead of swapping their ends.
    """
    keys = [c for c in lines.columns if c != line]
    g = lambda k: F.regexp_extract(F.col(line), LINE, k)
    rows = lines.where(F.col(line).rlike(LINE)).select(*keys, g(1).alias("type"), *(g(k).cast("int").alias(n) for k, n in ((2, "a1"), (3, "b1"), (4, "a2"), (5, "b2"))))

    def interval(a: str, b: str) -> Column:
        a, b = F.col(a), F.col(b)
        back = a > b
        if strand == "mirror":
            n = F.col(length)
            return F.struct(F.when(back, n - a + 1).otherwise(a).alias("s"), F.when(back, n - b + 1).otherwise(b).alias("e"), back.alias("inv"))
        return F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"), back.alias("inv"))

    rows = rows.select(*keys, "type", F.array_sort(F.array(interval("a1", "b1"), interval("a2", "b2"))).alias("iv"))
    x, y, inverted = F.col("iv")[0], F.col("iv")[1], F.col("type") == "inversion"
    near = (y["s"] <= x["e"]) | (y["s"] - x["e"] < MOST_GAP)

    def record(s: Column, e: Column, bs: Column, be: Column) -> Column:
        return F.struct(s.alias("start"), e.alias("end"), bs.alias("break_start"), be.alias("break_end"))

    lo, hi = F.least(y["s"], x["e"]), F.greatest(y["s"], x["e"])
    first, second = record(x["s"], x["e"], x["e"], x["e"]), record(y["s"], y["e"], y["s"], y["s"])
    joined = F.when(~inverted, record(x["s"], y["e"], lo, hi)).when(x["inv"], record(x["s"], x["e"], lo, hi)).otherwise(record(y["s"], y["e"], lo, hi))
    both = F.array(first, second)
    if drop_second_interspecies:
        both = F.when(F.col("type") == "interspecies translocation", F.array(first)).otherwise(both)
    apart = F.when(~inverted, both).when(x["inv"], F.array(first)).otherwise(F.array(second))
    return rows.select(*keys, "type", F.posexplode(F.when(near, F.array(joined)).otherwise(apart)).alias("part", "r")).select(*keys, "part", "type", "r.*")


def misassembly_types_per_contig(records: DataFrame, order: list[str]) -> DataFrame:
    """MIS2: rows (sample, contig, types): types in report order, joined by ``;``, spaces as ``_``."""
    names = F.array_sort(F.collect_list(F.struct(*order, F.replace(F.col("type"), F.lit(" "), F.lit("_")).alias("t"))))
    return records.groupBy(*_keys(records)).agg(F.array_join(F.transform(names, lambda x: x["t"]), ";").alias("types"))


def _keys(*tables: DataFrame) -> list[str]:
    return [k for k in KEYS if all(k in t.columns for t in tables)]


FINER, MOST_LEVELS = 4, 12  # how much wider the bins of the next level are, and how many levels there are


def binned(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """``intervals`` with ``_level`` and ``_bin``: an interval lies at the first level whose bins are as wide as it, in one bin or two."""
    size = F.col(end) - F.col(start) + 1
    level = F.lit(MOST_LEVELS - 1)
    for k in reversed(range(MOST_LEVELS - 1)):
        level = F.when(size <= width * FINER**k, k).otherwise(level)
    rows = intervals.withColumn("_level", level)
    wide = F.element_at(F.array(*(F.lit(width * FINER**k).cast("long") for k in range(MOST_LEVELS))), F.col("_level") + 1)
    first, last = (F.floor(F.col(c) / wide) for c in (start, end))
    return rows.withColumn("_bin", F.explode(F.sequence(first, last)))


def levels_of(intervals: DataFrame) -> list[int]:
    """The levels that some interval lies at."""
    return sorted(r._level for r in intervals.select("_level").distinct().collect())  # at most MOST_LEVELS


def looked_up(points: DataFrame, at: Column, levels: list[int], width: int) -> DataFrame:
    """``points`` with the ``_level`` and ``_bin`` of ``at``, a row for each of ``levels``."""
    places = [F.struct(F.lit(k).alias("_level"), F.floor(at / (width * FINER**k)).alias("_bin")) for k in levels or [0]]
    if len(places) == 1:
        return points.withColumn("_place", places[0]).select("*", "_place.*").drop("_place")
    return points.withColumn("_place", F.explode(F.array(*places))).select("*", "_place.*").drop("_place")


def interval_join(positions: DataFrame, records: DataFrame, bin_width: int = 1000) -> DataFrame:
    """JN7: positions (0-based) with every record (1-based, inclusive) of their contig that covers them; keys are those of the positions.

    A range join by bins of several widths: an interval of any length is a row or two, and a position looks it up at each
    level in use. Records of a long contig spread over its bins.
    """
    keys = _keys(positions, records)
    more = [c for c in records.columns if c not in keys]
    spans = binned(records.where(F.col("start") <= F.col("end")).select(*keys, *more), "start", "end", bin_width)
    rows = looked_up(positions, F.col("position") + 1, levels_of(spans), bin_width)
    return rows.join(spans, [*keys, "_level", "_bin"]).where((F.col("position") + 1).between(F.col("start"), F.col("end"))).drop("_level", "_bin")


def label_stretches(records: DataFrame, bin_width: int = 1000) -> DataFrame:
    """Disjoint stretches (keys, low, high: 1-based, inclusive) with the types that cover all of them: by_pos and mask.

    Overlapping intervals of one type are merged first, so at most one interval a type covers a stretch.
    """
    keys = _keys(records)
    by = Window.partitionBy(*keys, "type").orderBy("start", "end")
    rows = records.where(F.col("start") <= F.col("end")).select(*keys, "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*keys, "type", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    cuts = merged.select(*keys, F.explode(F.array("start", F.col("end") + 1)).alias("low")).distinct()
    cuts = cuts.withColumn("high", F.lead("low").over(Window.partitionBy(*keys).orderBy("low")) - 1).where("high is not null")
    spans = binned(merged.select(*keys, "type", "start", "end"), "start", "end", bin_width)
    covered = looked_up(cuts, F.col("low"), levels_of(spans), bin_width).join(spans, [*keys, "_level", "_bin"]).where(F.col("low").between(F.col("start"), F.col("end")))
    return covered.groupBy(*keys, "low", "high").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("by_pos"), F.bit_or(type_bit()).alias("mask"))


def label_positions(positions: DataFrame, records: DataFrame, bin_width: int = 1000) -> DataFrame:
    """MIS3: positions (0-based) with the types of all intervals (1-based, inclusive) of their own sample's contig that cover them.

    Adds by_pos (types joined by commas, ``None`` if none), mask (bits) and misassembled (whether the contig has any
    record). Records become disjoint stretches first, so a position meets one at most and the positions are not
    grouped; Spark broadcasts the stretches if they are small, and else deals both sides by bin. Stretches lie at levels
    by their length, as in ``interval_join``; the positions meet the stretches of each level in use once.
    """
    keys = _keys(positions, records)
    spans = label_stretches(records.select(*keys, "type", "start", "end"), bin_width)
    spans = binned(spans.select(*(F.col(k).alias(f"_{k}") for k in keys), "low", "high", "by_pos", "mask"), "low", "high", bin_width)
    at = F.col("position") + 1
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out, levels = positions, levels_of(spans) or [0]
    for k in levels:
        here = spans.where(F.col("_level") == k).withColumnsRenamed({"by_pos": f"_by_pos_{k}", "mask": f"_mask_{k}"})
        out = out.join(here, [*same, F.floor(at / (bin_width * FINER**k)) == F.col("_bin"), at.between(F.col("low"), F.col("high"))], "left").drop(*(f"_{k}" for k in keys), "_level", "_bin", "low", "high")
    out = out.withColumns({"by_pos": F.coalesce(*(f"_by_pos_{k}" for k in levels)), "mask": F.coalesce(*(f"_mask_{k}" for k in levels))}).drop(*(f"_{name}_{k}" for name in ("by_pos", "mask") for k in levels))
    flags = records.select(*keys).distinct().withColumn("misassembled", F.lit(1))
    out = out.join(flags, keys, "left")
    return out.withColumns({"by_pos": F.coalesce("by_pos", F.lit("None")), "mask": F.coalesce("mask", F.lit(0)), "misassembled": F.coalesce("misassembled", F.lit(0))})


def contig_label_stretches(contigs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``label_positions`` adds, before positions are laid out; ``contigs`` have their keys and ``length``.

    Stretches (keys of the contigs, start: from 0, n, label, mask) within their contig, ``label`` being a hash of by_pos so
    that it adds up by hash; and the distinct (label, by_pos).
    """
    keys = _keys(contigs, records)
    spans = label_stretches(records.select(*keys, "type", "start", "end")).select(*(F.col(k).alias(f"_{k}") for k in keys), "low", "high", "by_pos", "mask").withColumn("label", F.xxhash64("by_pos"))
    rows = contigs.select(*_keys(contigs), "length").join(spans, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    start = F.greatest(F.col("low") - 1, F.lit(0))
    rows = rows.select(*_keys(contigs), start.alias("start"), (F.least("high", "length") - start).alias("n"), "label", "mask")
    return rows.where("n > 0"), spans.select("label", "by_pos").distinct()


def mirror_interval(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """MIS4: reversed intervals (start > end) reflected on their contig's length; others as they are."""
    back, n = F.col("start") > F.col("end"), F.col("length")
    keys = _keys(intervals, lengths)
    rows = intervals.join(lengths.select(*keys, "length"), keys)
    return rows.withColumn("s", F.when(back, n - (F.col("start") - 1)).otherwise(F.col("start"))).withColumn("e", F.when(back, n - (F.col("end") - 1)).otherwise(F.col("end"))).drop("start", "end").withColumnsRenamed({"s": "start", "e": "end"})


def contig_label(contigs: DataFrame, records: DataFrame) -> DataFrame:
    """MIS5: contigs with misassembly_cnt and label (0/1)."""
    keys = _keys(contigs, records)
    counts = records.groupBy(*keys).agg(F.count("*").alias("misassembly_cnt"))
    out = contigs.join(counts, keys, "left").withColumn("misassembly_cnt", F.coalesce("misassembly_cnt", F.lit(0)))
    return out.withColumn("label", (F.col("misassembly_cnt") > 0).cast("int"))


def breakpoint_histograms(breaks: DataFrame) -> DataFrame:
    """MIS6: rows (kind, bin, n): 50 bins of 200 bases of the distance to the nearest end, 20 bins of the relative place.

    ``breaks``: rows (lo, hi, length). A breakpoint counts at its middle and at the mirrored place; the last bins are open.
    """
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    both = breaks.select("length", mid.alias("mid")).select("length", F.explode(F.array("mid", F.col("length") - F.col("mid"))).alias("mid"))
    end = F.least(F.lit(49), F.floor(F.least("mid", F.col("length") - F.col("mid")) / 200))
    rel = F.greatest(F.lit(0), F.least(F.lit(19), F.floor(20 * F.col("mid") / F.col("length"))))
    bins = both.select(F.explode(F.array(F.struct(F.lit("end").alias("kind"), end.cast("int").alias("bin")), F.struct(F.lit("relative").alias("kind"), rel.cast("int").alias("bin")))).alias("b")).groupBy("b.kind", "b.bin").agg(F.count("*").alias("n"))
    spine = breaks.sparkSession.range(70).select(F.when(F.col("id") < 50, "end").otherwise("relative").alias("kind"), F.when(F.col("id") < 50, F.col("id")).otherwise(F.col("id") - 50).cast("int").alias("bin"))
    return spine.join(bins, ["kind", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def select_breakpoint_chunk(contigs: DataFrame, chunk: int = 500, margin: int = 50, seed: int = 0) -> DataFrame:
    """MIS7: a chunk for each breakpoint, which lies at a random offset between the margins; one chunk of a clean contig.

    ``contigs``: sample?, contig, length, breakpoints array of (lo, hi). Adds ord, chunk_start, chunk_end, lo and hi from the chunk's start.
    """
    keys = _keys(contigs)
    rows = contigs.select(*keys, "length", F.posexplode_outer("breakpoints").alias("ord", "b"))
    ord_ = F.coalesce("ord", F.lit(0))
    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys), ord_.cast("string"))
    mid = F.floor((F.col("b.lo") + F.col("b.hi")) / 2)
    offset = margin + random_below(F.lit(chunk - 2 * margin + 1), key, seed)
    start = F.least(F.greatest(F.lit(0), mid - offset), F.col("b.lo"))
    start = F.when(F.col("b").isNull(), random_below(F.col("length") - chunk + 1, key, seed)).otherwise(F.least(start, F.col("length") - chunk))
    rows = rows.withColumn("ord", ord_).withColumn("chunk_start", F.when(F.col("length") <= chunk, 0).otherwise(start).cast("int"))
    rows = rows.withColumn("chunk_end", F.least("length", F.col("chunk_start") + chunk).cast("int"))
    return rows.select(*keys, "ord", "chunk_start", "chunk_end", (F.col("b.lo") - F.col("chunk_start")).alias("lo"), (F.col("b.hi") - F.col("chunk_start")).alias("hi"))


def misassembly_type_counts(df: DataFrame, by: list[str], types: str = "by_pos") -> DataFrame:
    """MIS8: comma lists to one row a type and contig, counted by group; detail after ``inconsistency`` is dropped."""
    one = df.select(*by, "contig", F.explode(F.split(types, ",")).alias("type")).withColumn("type", F.trim(F.regexp_replace("type", " inconsistency.*", "")))
    return one.distinct().groupBy(*by, "type").agg(F.count("*").alias("n"))


def max_types_per_position(df: DataFrame, by: list[str], types: str = "by_pos") -> DataFrame:
    """MIS9."""
    return df.groupBy(*by).agg(F.max(F.when(F.col(types) == "None", 0).otherwise(F.size(F.split(types, ",")))).alias("max_types"))


def carry_forward(lines: DataFrame, value: Column, by: list[str], order: str, into: str, block: int = 100_000) -> DataFrame:
    """WN9: the last non-null ``value`` at or before each row, within ``by``; ``order`` is a whole number.

    Rows are ordered within blocks of ``block`` numbers; each block hands its last value on to the next, so a long
    file is not ordered in one task.
    """
    rows = lines.withColumns({"_block": F.floor(F.col(order) / block), "_value": value})
    w = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*by, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    ends = ends.select(*by, "_block", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    here = F.last("_value", ignorenulls=True).over(w)
    return rows.withColumn("_here", here).join(ends, [*by, "_block"]).withColumn(into, F.coalesce("_here", "_before")).drop("_block", "_value", "_here", "_before")
