import datetime as dt
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from asmlens.operators import ordered as O
from asmlens.operators import relational as R
from asmlens.operators import study as Y
from asmlens.operators import training as L
from asmlens.plans.catalogue import ENTRIES


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(O, "ROWS", 40)


def loop(rows, by, order):
    """1, 2, 3, … by a plain sort; None first, and last where descending."""
    out, groups = {}, {}
    for r in rows:
        groups.setdefault(r[by], []).append(r)
    for g in groups.values():
        for c in reversed(order):
            k = abs(c) - 1
            g.sort(key=lambda r: (r[k] is not None, r[k] if r[k] is not None else 0), reverse=c < 0)
        out |= {r[0]: n + 1 for n, r in enumerate(g)}
    return out


DAY = dt.date(2020, 1, 1)
KINDS = {
    "string": lambda k: f"contig_{k:05d}",
    "date": lambda k: DAY + dt.timedelta(k),
    "timestamp": lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=k),
    "decimal(20,3)": lambda k: Decimal(k) / 8,
    "double": lambda k: k / 3 - 50,
    "bigint": lambda k: (1 << 60) + k,
    "binary": lambda k: f"NODE_{k:04d}".encode(),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_numbers_of_any_type_spread_over_ranges(spark, small, kind):
    dice = random.Random(kind)
    rows = [(k, "hot" if k % 10 else None, None if k % 97 == 5 else KINDS[kind](dice.randrange(3000))) for k in range(1500)]
    df = spark.createDataFrame(rows, f"id int, g string, x {kind}")
    got = {r.id: r.n for r in O.numbered(df, ["g"], ["x", "id"], "n").collect()}
    assert got == loop(rows, 1, [3, 1])
    sizes = [r["count"] for r in O.ranged(df, ["g"], ["x", "id"]).groupBy("_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 200


def test_mixed_directions_and_sums(spark, small):
    dice = random.Random(1)
    rows = [(k, k % 3, dice.randrange(20), dice.random()) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, g int, a int, b double")
    want = loop(rows, 1, [-3, 1])
    assert {r.id: r.n for r in O.numbered(df, ["g"], ["-a", "id"], "n").collect()} == want
    assert {r.id: r.n for r in O.numbered(df, ["g"], ["-a", "-b"], "n").collect()} == loop(rows, 1, [-3, -4])
    total = {}
    for r in sorted(rows, key=lambda r: (r[1], want[r[0]])):
        total[r[0]] = r[3] + (total[last] if (last := next((s[0] for s in rows if s[1] == r[1] and want[s[0]] == want[r[0]] - 1), None)) is not None else 0)
    got = {r.id: r.s for r in O.running_sums(df, ["g"], ["-a", "id"], {"s": "b"}).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in total.items())


def test_ranks_of_a_hot_group_with_ties(spark, small):
    dice = random.Random(2)
    rows = [(k, "hot" if k % 20 else "cold", None if k % 50 == 0 else dice.choice([1.5, 2.5, dice.random() * 100])) for k in range(2000)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    for order, down in (("x", False), ("-x", True)):
        got = {r.id: (r.gaps, r.dense) for r in O.ranked(O.ranked(df, ["g"], order, "gaps"), ["g"], order, "dense", dense=True).collect()}
        for g in ("hot", "cold"):
            values = sorted(((r[2] is not None, r[2] or 0) for r in rows if r[1] == g), reverse=down)
            distinct = list(dict.fromkeys(values))
            for r in rows:
                if r[1] == g:
                    v = (r[2] is not None, r[2] or 0)
                    assert got[r[0]] == (values.index(v) + 1, distinct.index(v) + 1)


def test_operators_over_ranges(spark, small):
    rows = [(k, f"NODE_{k % 400}", k % 7, DAY + dt.timedelta(k % 90)) for k in range(800)]
    df = spark.createDataFrame(rows, "id int, taxon string, a int, day date")
    batches = {r.id: r.batch for r in L.batch_assign(df, 32, ["day", "id"]).collect()}
    assert batches == {k: (n - 1) // 32 for k, n in loop([(r[0], 0, r[3]) for r in rows], 1, [3, 1]).items()}
    two = R.two_ranks(df.withColumn("g", F.lit(1)), ["g"], "-a", "day").collect()
    assert {(r.a, r.rank_1) for r in two} == {(a, 7 - a) for a in range(7)} and max(r.rank_2 for r in two) == 90
    even = Y.even_abundance(df.withColumn("community", F.lit("c"))).collect()
    assert len({r["rank"] for r in even}) == 800 and all(abs(r.perc_rel_abund - 100 / 800) < 1e-12 for r in even)
    few = R.random_per_group(df, ["a"], 5, "id", 1).groupBy("a").count().collect()
    assert all(r["count"] == 5 for r in few) and len(few) == 7


@pytest.mark.parametrize("n", [0, 1, 2, 3, 41, 1000])
def test_exact_quantiles(spark, small, n):
    dice = random.Random(n)
    rows = [("a" if k % 3 else None, dice.choice([dice.random(), 0.25, None])) for k in range(n)]
    rows += [("empty", None)] if n else []
    q = [0.0, 0.04, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in O.exact_quantiles(df, "x", q, ["g"]).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, q))).alias("q")).collect()}
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert got[g] == ([None] * len(q) if values is None else pytest.approx(values, abs=1e-12))
    (whole,) = [r.q for r in O.exact_quantiles(df, "x", [0.5]).collect()] or [[None]]
    known = [x for _, x in rows if x is not None]
    assert whole == [pytest.approx(statistics.median(known))] if known else whole == [None]


def test_sketches_merge_and_hold_their_rank_error(spark):
    df = spark.range(200_000).select((F.col("id") % 4).alias("part"), ((F.col("id") * 7919) % 200_003).cast("double").alias("x"))
    parts = O.quantile_sketches(df, "x", ["part"])
    q = [0.01, 0.25, 0.5, 0.99]
    (found,) = [r.q for r in O.sketch_quantiles(O.merged_sketches(parts), q).collect()]
    exact = O.exact_quantiles(df, "x", q).first().q
    assert all(abs(a - b) < 0.005 * 200_000 for a, b in zip(found, exact))
    approximate = R.quantiles(df, "x", q, ["part"], approximate=True)
    assert approximate.count() == 16


def test_more_ranges_than_the_first_sample_allows(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS", 10)
    monkeypatch.setattr(O, "SAMPLE", 160)
    df = spark.range(3000).select((F.col("id") * 37 % 3001).alias("x"))
    assert len(O.range_edges(df, ["x"])) > 100
    assert {r.x: r.n for r in O.numbered(df, [], ["x"], "n").collect()} == {x: k + 1 for k, x in enumerate(sorted(37 * k % 3001 for k in range(3000)))}


def test_percent_of_total_keeps_sums_that_differ_when_computed_again(spark):
    """Sums of doubles differ in their last bits from one evaluation to the next; no row may be lost for that."""
    shaken = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    rows = [(p, s, float(v)) for p in "abc" for s in "FOP" for v in range(1, 4)]
    orders = spark.createDataFrame(rows, "o_orderpriority string, o_orderstatus string, v double").withColumn("o_totalprice", shaken("v")).drop("v")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ENTRIES["wn12_percent_of_total"].build({"orders": orders}).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == 9 and all(abs(r.percent - 100 / 3) < 1e-6 for r in got)
