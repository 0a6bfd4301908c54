import os
import time

import corpus_pipeline
import sentencepiece
from asmlens.llm import _spark, pieces, quality, simhash, suffix

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs = docs.cache()
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert n > counts[0] > counts[1] == counts[2] and counts[4] == counts[3]


def test_run_is_the_chain(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_good(spark, docs, SF)
    cut = {r.doc_id: r.text for r in suffix.cut_later_copies(spark, simhash.keep_one(spark, kept, SF), SF).collect()}
    assert rows and all(r.ids == lib.encode(cut[r.doc_id], add_eos=True) and r.n_tokens == len(r.ids) for r in rows)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_two_corpora_in_one_session_keep_their_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = quality.keep_good(spark, docs, SF)
    b = quality.keep_good(spark, docs.where("doc_id % 2 = 0"), SF)
    part = simhash.keep_one(spark, b, SF).where("length(text) > 100").groupBy("lang").count()
    del b
    suffix.cut_later_copies(spark, docs.where("doc_id < 50"), SF)
    assert a.count() > 0 and part.count() > 0


def test_tables_that_nothing_reads_are_deleted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    one = _spark.written(docs, "one")
    path, derived = one.written_to, one.where("doc_id > 3").groupBy().count()
    del one
    _spark.swept(spark)
    assert os.path.exists(path)
    rows = derived.collect()
    assert rows[0][0] > 0
    del derived
    for _ in range(20):  # the JVM hears of it a moment later
        _spark.swept(spark)
        if not os.path.exists(path):
            break
        time.sleep(0.5)
    assert not os.path.exists(path) and path not in _spark._made
