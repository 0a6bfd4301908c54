import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from asmlens.llm import pieces as P

TEXTS = ["", " ", "  ", "   a", "a  b   c ", "▁", "▁ ▁x ▁▁", "a\tb\n\nc  \n d", "日本語 テスト", "🙂 \x00 x", "a▁b c", "</s> <s> <unk> <0x41>", "é" * 500 + "x" * 300, " \n", " x", "word " * 5000, None]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def test_encode_decode_match_the_library(spark, documents, library):
    out = P.encode(documents(list(enumerate(TEXTS)) + [(0, "")]), P.default_model(), outputs=("ids", "starts", "ends", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"))
    rows = P.decode(out, P.default_model()).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = r.text or ""
        ids = library.encode(text, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        # spans tile the text
        raw = text.encode()
        assert r.covered_bytes == len(raw) and all(a <= b for a, b in zip(r.starts, r.ends))
        assert r.starts[1:] == r.ends[:-1] and r.ends[-1] == len(raw)


def test_spans_are_those_of_ascii_pieces(library):
    tool, text = P.Encoder(P.default_model()), "The quick  brown fox\njumps, over."
    start, end = tool.spans(text, tool.encode([text])[0])
    want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
    assert list(zip(start.tolist(), end.tolist()))[:-1] == want


def test_a_very_long_text_and_clashing_columns(spark, documents, library):
    text = "Überlang und  länger, " * 20_000
    docs = documents([(1, text), (2, "kurz")]).withColumn("ids", F.lit("old")).withColumn("N_TOKENS", F.lit("old"))
    rows = {r.doc_id: r for r in P.encode(docs, P.default_model(), outputs=("ids", "n_tokens", "covered_bytes")).collect()}
    assert rows[1].ids == library.encode(text, add_eos=True) and rows[1].n_tokens == len(rows[1].ids)
    assert rows[1].covered_bytes == len(text.encode()) and rows[2].ids == library.encode("kurz", add_eos=True)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_longest_prefix_normalisation_with_offsets(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    tool = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = pb.ModelProto()
    proto.ParseFromString(tool.serialized_model_proto())
    mine = P.Normalizer(proto.normalizer_spec)
    for text in ("Ｈello　①②③ ﬁne", "  a  b ", "ÀÉ é́ x", "​z ㍿ ﬃ", "ｶﾞｷﾞ", "한글 한", "", "   ", "plain"):
        got, source = mine(text)
        want, offsets = tool.normalize(text, with_offsets=True)
        assert got == want
        chars = [len(text[:k].encode()) for k in range(len(text) + 1)]
        at = [source[len(got[:k].encode())] for k in range(len(got))]
        assert at == [chars[k] for k in offsets[: len(got)]]


def test_empty(spark, documents):
    assert P.encode(documents([(1, "a")]).where("doc_id < 0"), P.default_model()).count() == 0
