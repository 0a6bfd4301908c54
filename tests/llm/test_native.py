import numpy as np
import pytest
from pyspark.sql import functions as F

from asmlens.llm import mixing as M
from asmlens.llm import sharding as H


def fill(sizes, weights, most=3):
    free, left, out = set(sizes), float(sum(sizes.values())), {}
    while True:
        w = sum(weights[s] for s in free)
        over = [s for s in free if w and left * weights[s] / w > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / w for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
            left -= out[s]


def test_mix_targets_and_takes(spark, documents):
    rng = np.random.default_rng(5)
    rows = [(k, "w " * int(rng.integers(1, 60)), f"s{k % 4}" if k % 3 else "big") for k in range(900)] + [(1000, None, "s1"), (1001, "one two", None), (1002, "", "zero"), (1003, "a b", "tiny")]
    docs = documents(rows)
    out = M.mix(docs).select("doc_id", "source", "mixed.*").collect()
    assert len(out) == len(rows)
    sizes, took = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        took[r.source] = took.get(r.source, 0) + r["size"] * len(r.draws)
        assert len(r.draws) <= 3 and len({d.copy for d in r.draws}) == len(r.draws)
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(took[s] - t) <= 60
    again = {r.doc_id: r.mixed for r in M.mix(docs).collect()}
    assert all(again[r.doc_id].draws == r.draws for r in out)
    mixed = M.mixed_rows(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.draws) for r in out)


def test_hypergeometric_has_the_right_distribution(spark):
    from math import comb

    n = 40_000
    for marked, others, taken in ((5, 7, 4), (1, 30, 6), (12, 3, 9), (300, 200, 250)):
        u = M.uniform(F.lit("t"), F.col("id").cast("string")) / float(1 << 60)
        counts = {r.x: r["count"] for r in spark.range(n).select(M.hypergeometric(F.lit(marked), F.lit(others), F.lit(taken), u).alias("x")).groupBy("x").count().collect()}
        for x in range(taken + 1):
            p = comb(marked, x) * comb(others, taken - x) / comb(marked + others, taken) if x <= marked and taken - x <= others else 0
            assert abs(counts.get(x, 0) - n * p) <= 5 * (n * p) ** 0.5 + 1
        assert sum(counts.values()) == n
    edges = spark.range(1).select(*(M.hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.999999999)).alias(f"c{i}") for i, (a, b, c) in enumerate([(4, 0, 3), (4, 3, 0), (3, 4, 7), (0, 4, 2)]))).first()
    assert tuple(edges) == (3, 0, 3, 0)


def test_tree_splits_quotas_exactly(spark):
    quotas = {1: 400, 2: 7, 3: 0, 4: 93}
    rows = M.split_tree(spark.createDataFrame(list(quotas.items()), "k long, q long"), 13, 5).collect()
    for k, q in quotas.items():
        assert sum(r.q for r in rows if r.k == k) == q
    by_shard = [sum(r.q for r in rows if r.shard == s) for s in range(13)]
    assert sum(by_shard) == 500 and max(by_shard) - min(by_shard) <= 1
    again = M.split_tree(spark.createDataFrame(list(quotas.items()), "k long, q long"), 13, 5).collect()
    assert sorted(again) == sorted(rows)
    # a deep tree goes over several tasks
    deep = M.split_tree(spark.createDataFrame([(1, 2000), (2, 1000)], "k long, q long"), 1500, 5).collect()
    assert sum(r.q for r in deep) == 3000 and {r.shard for r in deep} == set(range(1500))


def test_deal_draws_each_block_once(spark):
    draws = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("block"), F.lit(1).alias("copy"))
    rows = M.deal(draws, 16, 1).collect()
    assert sorted(r.block for r in rows) == list(range(1000))
    sizes = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    quotas = {(r.shard, r.k): r.q for r in M.split_tree(draws.groupBy("k").agg(F.count("*").alias("q")), 16, 1).collect()}
    assert quotas == {key: sum((r.shard, r.k) == key for r in rows) for key in quotas}


def test_mix_over_many_shards_repeats_and_long_texts(documents):
    rows = [(k % 50, "w " * (k % 40), f"s{k % 2}") for k in range(600)] + [(None, "same row", "s0")] * 30 + [(7, "v " * 30_000, "s1")]
    docs = documents(rows).withColumn("mixed", F.lit("clash")).withColumn("mix_u", F.lit(1))
    out = M.mix(docs, shard_words=1500).select("doc_id", "text", "source", "mix_u", "mixed.*").collect()
    assert len(out) == len(rows) and len({d.shard for r in out for d in r.draws}) > 10
    alike = {}
    for r in out:
        assert len(r.draws) <= 3 and alike.setdefault((r.doc_id, r.text, r.source), r.draws) == r.draws
    for name, room in (("s0", 90), ("s1", 15_000)):  # half of the largest document
        own = [r for r in out if r.source == name]
        assert abs(sum(r["size"] * len(r.draws) for r in own) - own[0].target) <= room


def test_mix_empty(spark, documents):
    empty = documents([(1, "a")]).where("doc_id < 0")
    assert M.mix(empty).count() == 0 and M.mixed_rows(spark, empty, "").count() == 0


def test_shards_fit(documents):
    rows = [(k, "x" * (k % 50)) for k in range(2000)] + [(5000, "y" * 900), (None, "z"), (None, None), (7, "x" * 7), (7, "x" * 7)]
    docs = documents(rows).withColumn("shard", F.lit("clash"))
    out = H.shard(docs, limit=600).select("doc_id", "shard.*").collect()
    assert len(out) == len(rows)
    sums = {}
    for r in out:
        sums.setdefault(r.name, []).append(r.bytes)
        assert len(r.name) == r.depth
    for r in out:
        assert r.shard_bytes == sum(sums[r.name]) and r.shard_rows == len(sums[r.name])
        assert r.shard_bytes <= 600 or r.shard_rows == 1
    # no name is the beginning of another, and only oversized parents were split
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for parent in {n[:-1] for n in names if n}:
        assert sum(sum(v) for n, v in sums.items() if n.startswith(parent)) > 600


def test_deep_splits_and_equal_rows(documents):
    out = H.shard(documents([(k, "x" * 100) for k in range(300)] + [(9, "same" * 50)] * 6), limit=150).select("shard.*").collect()
    assert all(r.shard_bytes <= 150 or r.shard_rows in (1, 6) for r in out) and len(out) == 306


def test_many_shards_a_long_text_and_one_hot_id(documents, monkeypatch):
    monkeypatch.setattr(H, "STEP", 3)
    rows = [(1, f"t{k} " * 20) for k in range(700)] + [(2, "z" * 500_000)] + [(k, None) for k in range(50)]
    out = H.shard(documents(rows).withColumn("prefix", F.lit("clash")).withColumn("u", F.lit("clash")), limit=400).select("prefix", "shard.*").collect()
    sums = {}
    for r in out:
        sums.setdefault(r.name, []).append(r.bytes)
    assert len(out) == len(rows) and len(sums) > 64 and {r.prefix for r in out} == {"clash"}
    for r in out:
        assert r.shard_bytes == sum(sums[r.name]) and r.shard_rows == len(sums[r.name]) and (r.shard_bytes <= 400 or r.shard_rows == 1)
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for parent in {n[:-1] for n in names if n}:
        assert sum(sum(v) for n, v in sums.items() if n.startswith(parent)) > 400


def test_shard_empty(documents):
    assert H.shard(documents([(1, "a")]).where("doc_id < 0")).count() == 0
