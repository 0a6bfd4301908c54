"""Mixing sources to target weights with a splitting tree. DataFrame and SQL functions only.

Sources get weights in order of their names and share the words of the corpus;
a target is at most ``most`` times its source, and what a full source leaves is
shared again by weight. A source's documents are cut into blocks by a hash, of
about ``shard_words / SHARES`` words each. A source that needs ``r`` times its
words draws ``floor(r)`` whole copies of its blocks and, for the rest, blocks up
to the quota and documents of one more block: the source's quota of block draws.

A binary tree splits the vector of quotas among the output shards. At a node
half of its shards take half of its draws, and how many of them belong to each
source is a multivariate-hypergeometric draw, made source after source from
hypergeometric ones by inversion. The leaves hold each shard's exact quota of
each source, and their sums are the quotas of the root. The draws of a source
are then permuted by a hash, each shard takes its quota of them from the
permutation, no draw twice, and orders its rows by another hash.

The number of shards and blocks follows the words of the input. Sources and
blocks are broadcast only up to ``SMALL`` rows; above, they are joined by key,
where blocks are even. The table of sources, one row each, is ranked in one
task, and a node holds one element for each source that still has draws in it.

Cases: null text has size 0. A null source is a source of its own, last in
order. Rows equal in id and text are drawn alike; others with one id are not.
Very long texts are one document of their block, which is then larger. Sources
without words have target 0. An empty table gives an empty table. Columns with
the names of the outputs are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asmlens.llm._spark import dropped, fresh, stage, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
SHARD_WORDS, SHARES = 1 << 21, 32
SMALL = 50_000  # rows of a broadcast table, each of a few numbers
SPREAD = 8  # levels of the tree after which nodes go to several tasks
REACH = 12  # standard deviations that the inversion covers: what lies outside is below the precision of a double


def uniform(*parts: Column) -> Column:
    """60 bits of an MD5 digest, as a long that other SQL engines can make too."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")


def _text(value) -> Column:
    return (F.lit(value) if isinstance(value, (int, str)) else value).cast("string")


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows (source, source_size, n) with k (the source's place in order) and target: every source at ``level * weight`` or at its cap."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("k", F.row_number().over(order).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "k")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose cap holds its share sets the level; those before it are full
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return filled.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("k", "source", "source_size", "n", "target")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _up_to(n: Column) -> Column:
    """0 .. n - 1 as longs; nothing for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(marked: Column, others: Column, taken: Column, u: Column) -> Column:
    """How many of ``taken`` elements, drawn without replacement, are marked: the inverse of the distribution at ``u`` in [0, 1).

    Outcomes are ordered from the mode upwards, then from the mode downwards; weights follow from their ratios.
    """
    marked, others, taken = marked.cast("double"), others.cast("double"), taken.cast("double")
    total = marked + others
    mode = F.floor((taken + 1) * (marked + 1) / (total + 2))
    deviation = F.sqrt(taken * marked / total * others / total * (total - taken) / F.greatest(total - 1, F.lit(1.0)))
    span = F.ceil(REACH * deviation) + REACH
    low, high = F.greatest(F.lit(0.0), taken - others), F.least(taken, marked)
    given = F.struct(
        marked.alias("a"), others.alias("b"), taken.alias("n"), mode.cast("double").alias("mode"), u.alias("u"),
        F.least(span, (high - mode).cast("long")).alias("up"), F.least(span, (mode - low).cast("long")).alias("down"),
    )

    def draw(g: Column) -> Column:
        up = lambda x: (g["a"] - x) * (g["n"] - x) / ((x + 1) * (g["b"] - g["n"] + x + 1))  # noqa: E731  weight of x + 1 over that of x
        state = lambda w, s, x: F.struct(w.alias("w"), s.alias("s"), x.alias("x"))

        def step(goal: Column, go: int, ratio: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
            def one(acc: Column, i: Column) -> Column:
                at = g["mode"] + go * i
                return _with(acc["w"] * ratio(at), lambda w: state(w, acc["s"] + w, F.when((acc["x"] < 0) & (acc["s"] + w > goal), at + go).otherwise(acc["x"])))

            return one

        def walk(goal: Column) -> Column:
            """Sum of all weights, and the outcome at which it passes ``goal`` (-1: at none)."""
            out = state(F.lit(1.0), F.lit(1.0), F.when(goal < 1, g["mode"]).otherwise(F.lit(-1.0)))
            for steps, go, ratio in (("up", 1, up), ("down", -1, lambda x: 1 / up(x - 1))):
                out = F.aggregate(_up_to(g[steps]), out, step(goal, go, ratio), lambda acc: state(F.lit(1.0), acc["s"], acc["x"]))
            return out

        return _with(g["u"] * walk(F.lit(float("inf")))["s"], lambda goal: walk(goal)["x"])

    # rounding may leave the goal just above the sum of all weights: then the mode
    drawn = _with(_with(given, draw), lambda x: F.when(x < 0, mode.cast("double")).otherwise(x)).cast("long")
    return F.when(taken <= 0, F.lit(0)).when(others <= 0, taken.cast("long")).otherwise(drawn).cast("long")


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (k, q) to rows (shard, k, q): each shard's draws of each source, by a binary tree of multivariate-hypergeometric splits."""
    part, kind = F.struct(F.col("k").cast("long").alias("k"), F.col("q").cast("long").alias("q")), "array<struct<k:bigint,q:bigint>>"
    nodes = quotas.where("q > 0").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("n"), "parts")
    for level in range(max(shards - 1, 0).bit_length()):
        if level == SPREAD:
            nodes = nodes.repartition("low")
        half = F.ceil(F.col("n") / 2)
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["q"])
        start = F.struct(total.alias("rest"), F.floor(total * half / F.col("n")).cast("long").alias("open"), F.array().cast("array<bigint>").alias("left"))

        def one(acc: Column, p: Column) -> Column:
            u = uniform(_text(seed), _text(F.col("low")), _text(F.col("n")), _text(p["k"])) / float(1 << 60)
            x = hypergeometric(p["q"], acc["rest"] - p["q"], acc["open"], u)
            return _with(x, lambda x: F.struct((acc["rest"] - p["q"]).alias("rest"), (acc["open"] - x).alias("open"), F.concat(acc["left"], F.array(x)).alias("left")))

        split = nodes.withColumn("half", half).withColumn("left", F.aggregate("parts", start, one, lambda acc: acc["left"]))
        side = lambda f: F.filter(F.zip_with("parts", "left", lambda p, x: F.struct(p["k"].alias("k"), f(p["q"], x).alias("q"))), lambda p: p["q"] > 0).cast(kind)
        children = F.array(
            F.struct(F.col("low").alias("low"), F.col("half").alias("n"), side(lambda q, x: x).alias("parts")),
            F.struct((F.col("low") + F.col("half")).alias("low"), (F.col("n") - F.col("half")).alias("n"), side(lambda q, x: q - x).alias("parts")),
        )
        nodes = split.select(F.explode(children).alias("c")).select("c.*").where("n > 0")
    return nodes.select(F.col("low").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.k", "p.q")


def deal(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """Draws (k, block, copy) with the shard of each: a shard takes its quota of each source from the source's permuted draws, none twice."""
    shuffle = uniform(_text(seed), _text("draw"), _text(F.col("k")), _text(F.col("copy")), _text(F.col("block")))
    permuted = draws.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(shuffle, "copy", "block")).cast("long"))
    quotas = split_tree(draws.groupBy("k").agg(F.count("*").alias("q")), shards, seed)
    upto = F.sum("q").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    places = quotas.withColumn("upto", upto).select("k", "shard", F.explode(F.sequence(F.col("upto") - F.col("q") + 1, F.col("upto"))).alias("place"))
    return permuted.join(places, ["k", "place"]).drop("place")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """``docs`` with a struct column ``mixed``: size, source_size, target, and draws: [(copy, shard, place)].

    A document is drawn once for each element of ``draws``; ``place`` orders it in its shard.
    """
    docs = docs.drop("mixed") if "mixed" in [c.lower() for c in docs.columns] else docs
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.regexp_count(body, F.lit(WORD)).cast("long")
    u = uniform(_text(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(body))
    narrow = written(docs.select(F.col(source).alias("source"), size.alias("size"), u.alias("u")), "sizes")
    block_words = max(1, shard_words // SHARES)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(times + 1e-9).cast("int")
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    sources = sources.withColumns({"whole": whole, "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")})
    sources = written(sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "sources")
    known = _small(sources)

    # whole blocks up to the quota, then the block that crosses it
    placed = narrow.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("k", "size", "rest", (F.col("u") % F.col("blocks")).alias("block"), F.floor(F.col("u") / F.col("blocks")).alias("order"))
    sums = placed.groupBy("k", "block").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = sums.withColumn("before", F.coalesce(upto, F.lit(0).cast("long"))).join(_small(sources.select("k", "source_size", "target", "whole", "rest")), "k")
    full = (F.col("rest") > 0) & (F.col("before") + F.col("words") <= F.col("rest"))
    blocks = written(blocks.withColumns({"full": full, "open": (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))}), "blocks")
    edge = _small(blocks.where("open").select("k", "block", (F.col("rest") - F.col("before")).alias("room")))  # one block a source
    inner = placed.join(edge, ["k", "block"]).groupBy("k", "order", "room").agg(F.sum("size").alias("size"))
    sofar = F.coalesce(F.sum("size").over(Window.partitionBy("k").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bound = inner.withColumn("sofar", sofar).where(F.col("sofar") + F.col("size") / 2 <= F.col("room")).groupBy("k").agg(F.max("order").alias("bound"))

    some, none = F.sequence(F.lit(1), F.col("whole")), F.array().cast("array<int>")
    copies = F.concat(F.when(F.col("whole") > 0, some).otherwise(none), F.when(F.col("full") | F.col("open"), F.array(F.col("whole") + 1)).otherwise(none))
    draws = blocks.select("k", "block", "whole", "open", F.explode(copies).alias("copy"))
    words = sources.agg(F.sum("target")).first()[0] or 0
    dealt = deal(draws, max(1, math.ceil(words / shard_words)), seed).join(bound, "k", "left")
    last = F.when(F.col("open") & (F.col("copy") > F.col("whole")), F.coalesce("bound", F.lit(-1).cast("long")))
    plan = dealt.groupBy("k", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", last.alias("last")))).alias("drawn"))  # at most most + 1 elements
    plan = written(blocks.select("k", "block", "source_size", "target").join(plan, ["k", "block"], "left"), "mix-plan")
    dropped(narrow, blocks)

    size_, u_, k_, blocks_, source_, block_ = (fresh(docs, n) for n in ("mix_size", "mix_u", "mix_k", "mix_blocks", "mix_source", "mix_block"))
    rows = docs.withColumns({size_: size, u_: u})
    known = _small(sources.select(F.col("source").alias(source_), F.col("k").alias(k_), F.col("blocks").alias(blocks_)))
    rows = rows.join(known, rows[source].eqNullSafe(known[source_]), "left").withColumn(block_, F.col(u_) % F.col(blocks_))
    plan = _small(plan.select(F.col("k").alias(k_), F.col("block").alias(block_), F.struct("source_size", "target", "drawn").alias("mixed")))
    rows = rows.join(plan, [k_, block_], "left")
    mine = F.filter(F.coalesce("mixed.drawn", F.array().cast("array<struct<copy:int,shard:bigint,last:bigint>>")), lambda d: d["last"].isNull() | (F.floor(F.col(u_) / F.col(blocks_)) <= d["last"]))
    place = lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.xxhash64(F.col(u_), d["copy"], F.lit(seed)).alias("place"))
    made = F.struct(F.col(size_).alias("size"), F.col("mixed.source_size").alias("source_size"), F.col("mixed.target").alias("target"), F.transform(mine, place).alias("draws"))
    return rows.select(*(rows[c] for c in docs.columns), made.alias("mixed"))


def shuffled(mixed: DataFrame, into: str = "mixed") -> DataFrame:
    """The mix itself: one row a draw, partitioned by shard, in the order of ``place``."""
    names = [c for c in mixed.columns if c != into]
    draw = fresh(mixed, "draw")
    rows = mixed.select(*names, F.explode(F.col(into)["draws"]).alias(draw))
    return rows.repartition(F.col(draw)["shard"]).sortWithinPartitions(F.col(draw)["shard"], F.col(draw)["place"]).drop(draw)


def op7_mixing_tree(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it, summed over the shards that drew it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    m = F.col("mixed")
    return mix(docs).select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * F.size(m["draws"])).alias("taken"))


@stage
def mixed_rows(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix draws it, shard by shard."""
    names = docs.columns
    return shuffled(mix(docs)).select(*names)
