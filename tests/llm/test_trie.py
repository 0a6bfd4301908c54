import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from asmlens.llm import trie as T

CHAT = "conv_id long, turn long, role string, text string"


def ordered(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in chats.items()}


def changed_heads(chats):
    out = {}
    for c, turns in chats.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = chats.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(chats):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1].encode()) if path else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(c), len(p), str(min(members[p[:-1]]) if p else None), len(c), kids[p], leaves[p], saved[p], digest(p)) for p, c in members.items())


def got(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(str(r[c]) if c == "parent_conv_id" else r[c] for c in columns) for r in df.collect())


def chat_rows(seed, most=12):
    dice, rows = random.Random(seed), []
    for c in range(60):
        for turn in range(dice.choice([1, 2, 3, 5, most])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", dice.choice(["é", "bb", ""]) if turn % 3 else "same"))
    long = [(100 + k, t, "user", f"t{t}" if t < 40 or k % 3 else f"x{k}") for k in range(9) for t in range(38 + k)]
    copies = [(200 + k, t, "user", "copy") for k in range(40) for t in range(10)]
    odd = [(300, None, "user", "later"), (300, None, None, "first"), (300, 1, "user", None), (300, 1, "user", None), (None, 0, "user", "nobody"), (301, 0, "user", "very long " * 30_000)]
    return rows + long + copies + odd


@pytest.mark.parametrize(("border", "stream"), [(8, 1 << 18), (1, 1), (2, 3), (4, 30)])
def test_trie_equals_brute_force(spark, border, stream):
    rows = chat_rows(border)
    turns = T.numbered_turns(spark.createDataFrame(rows, CHAT).withColumn("depth", F.lit("clash")).withColumn("n", F.lit(0)))
    ids = turns.select("conv_id").distinct()
    assert got(T.prefix_trie(turns, ids, border, stream)) == brute(ordered(rows))


def test_changed_heads(spark):
    rows = [r for r in chat_rows(7) if r[0] not in (5, 10, 50)]  # groups without a first conversation
    want = changed_heads(ordered(rows))
    turns, ids = T.rebuilt(spark.createDataFrame(rows, CHAT))
    assert got(T.prefix_trie(turns, ids)) == brute(want)
    assert any(not t for t in want.values())


def test_empty_turnless_and_all_alike(spark):
    none = spark.createDataFrame([], CHAT)
    assert T.prefix_trie(T.numbered_turns(none), none.select("conv_id")).count() == 0
    ids = spark.range(5).select(F.col("id").alias("conv_id"))
    (r,) = T.prefix_trie(T.numbered_turns(none), ids).collect()
    assert (r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) == (0, 0, 5, 0, 1, 0)
    assert r.ends_sha256 == hashlib.sha256(b"0,1,2,3,4").hexdigest()


def test_lists_of_ends_longer_than_a_piece(spark, monkeypatch):
    n = 10_000
    ids = spark.range(n).select(F.col("id").alias("conv_id"))
    turns = T.numbered_turns(ids.select("conv_id", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text")))
    rows = {r.depth: r for r in T.prefix_trie(turns, ids).collect()}
    assert rows[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert rows[0].ends_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].saved_tokens == rows[1].saved_tokens == 2 * (n - 1)


def test_query_equals_brute_force_over_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(T.op11_prefix_trie(spark, path)) == brute(changed_heads(ordered(rows)))
