import hashlib
import random

import pytest
import tokenizers
from pyspark.sql import functions as F

from asmlens.llm import bpe as B

TEXTS = [
    "", " ", "  ", "   a", "a  b   c ", "it's we'll I'd", "a\tb\n\nc  \n d", "日本語 テスト", "🙂 \x00 x", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext", "é" * 500 + "x" * 300,
    " \n", " x", "word " * 5000, "1234567 ½²", "  x\u0085y\x1cz", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\U000323b0࢏՘ neu", "́́ é", "﻿bom", "\r\n\r\n x", None,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.default_vocabulary())


def test_encode_decode_match_the_library(spark, documents, library):
    docs = documents(list(enumerate(TEXTS)) + [(0, ""), (None, "no id")])
    rows = B.decode(B.encode(docs, B.default_vocabulary(), outputs=tuple(B.OUTPUTS)), B.default_vocabulary()).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == back
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_random_texts_match_the_library(library):
    dice, tool = random.Random(3), B.coder(B.default_vocabulary())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(600):
        alphabet = dice.choices(every[: 10 ** dice.randint(2, 6)], k=dice.randint(1, 30))
        text = "".join(dice.choices(alphabet, k=dice.randint(0, 300)))
        assert tool.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_one_very_long_word_and_words_beyond_the_table(library, monkeypatch):
    tool = B.Coder(B.default_vocabulary())
    long = "".join(random.Random(5).choices("abcdeinrst", k=200_000))
    assert tool.encode(long) == library.encode(long, add_special_tokens=False).ids
    monkeypatch.setattr(B, "KNOWN", 3)
    text = "one two three four five six one two three"
    assert tool.encode(text) == library.encode(text, add_special_tokens=False).ids and len(tool.known) <= 3


def test_decode_leaves_out_unknown_ids_and_mends_bytes(library):
    tool = B.coder(B.default_vocabulary())
    for ids in ([50256, 5, 999_999], [tool.of_byte[0xE2]], [tool.of_byte[0xE2], tool.of_byte[0x28]], [tool.of_byte[b] for b in b"\xf0\x9f\x98 \xff\xc0\x80\xed\xa0\x80"], []):
        assert tool.decode(ids) == library.decode([i for i in ids if i <= 50256], skip_special_tokens=False)


def test_empty_and_clashing_columns(spark, documents):
    docs = documents([(1, "abc")]).withColumn("IDS", F.lit("old")).withColumn("n_tokens", F.lit("old"))
    assert B.encode(docs.where("doc_id < 0"), B.default_vocabulary()).count() == 0
    out = B.encode(docs, B.default_vocabulary(), outputs=("ids", "n_tokens"))
    assert [c.lower() for c in out.columns].count("ids") == 1 and out.first().n_tokens == 1


def test_a_table_of_another_kind_is_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="no plain byte-level"):
        B.Coder(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library_over_the_whole_table(spark, library):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = B.op13_bpe_merge_queue(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
