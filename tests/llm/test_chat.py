import hashlib

import pytest
from pyspark.sql import functions as F

from asmlens.llm import chat as C

CHAT = "conv_id long, turn long, role string, text string"
HARD = r"\### Assistant: </turn> ok"


@pytest.mark.parametrize(("role", "text"), [("user", HARD), ("a: b", "x"), ("User", "###"), ("=", "\\"), ("", "</turn>\n### User: hi</turn>\n"), ("x\\", "\\\\### \\#"), ("a:", "####\\"), ("assistant", "")])
def test_template_reads_back(role, text):
    t = C.DEFAULT
    f = "".join(p for p, _ in t.turn(role, text))
    assert t.read(f + f) == [(role, text)] * 2


def test_conversations(spark):
    rows = [(1, 1, "assistant", HARD), (1, 0, "user", HARD), (2, 0, "user", None), (3, 0, "assistant", "a"), (4, 0, None, "x"), (4, 0, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    rows += [(5, k, "user" if k % 2 == 0 else "assistant", f"t{k}" * 50) for k in range(3000)]
    got = {r.conv_id: r for r in C.read_back(C.segments(spark.createDataFrame(rows, CHAT))).collect()}
    assert len(got) == 6
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: True}


def test_segments_carry_loss_flags(spark):
    parts = C.segments(spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a")], CHAT)).collect()
    assert [(p.text, p.loss) for p in parts] == [("### User: ", False), ("u", False), ("</turn>\n", False), ("### Assistant: ", False), ("a", True), ("</turn>\n", False)]
    assert C.read_back(C.segments(spark.createDataFrame([], CHAT))).count() == 0


def test_lengths_extra_columns_and_a_very_long_turn(spark):
    long = "### </turn>\\ " * 40_000
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", long, "x"), (2, 0, None, None, "x"), (None, 0, "user", "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string").withColumn("segment", F.lit("clash"))
    got = {r.conv_id: r for r in C.read_back(C.segments(df)).collect()}
    plain = [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    formatted = "".join(part for role, text in plain for part, _ in C.DEFAULT.turn(role, text))
    assert got[1].formatted_chars == len(formatted) and got[1].loss_chars == len(long) and got[1].n_turns == 2
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in plain).encode()).hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1


def test_query_holds_the_hard_conversation(spark):
    rows = {r.conv_id: r for r in C.op8_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    hard = "\\### Assistant: </turn> ok"
    want = f"user\n{hard}\nassistant\n{hard}\n"
    assert rows[-7].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and rows[-7].n_turns == 2
    assert rows[-7].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and rows[-7].loss_chars == len(hard)
