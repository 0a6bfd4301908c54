import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from asmlens.llm import ranked as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    counted = [(i, Counter(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i].update(terms(text))
    out = set()
    for item, query in asked.items():
        scores = []
        for doc, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in query.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out |= {(item, k + 1, s[2], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top])}
    return out


def rows(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def corpus(seed, n=300):
    dice = random.Random(seed)
    vocabulary = [a + b for a in ("Ab", "ü", "日本", "x9", "the") for b in ("", "ly", "É", "s", "77")]
    some = lambda k: " ".join(dice.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))], k=k))
    docs = [(k, some(dice.choice([1, 3, 10, 40, 200]))) for k in range(n)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(5, "repeat repeat me"), (5, "repeat repeat me"), (None, "nobody ab"), (None, None), (7, None), (8, ""), (9, "--- ,.")]
    docs += [(10, "very long " * 40_000 + "needle")]
    items = [(k, some(dice.randint(1, 12))) for k in range(30)] + [(40, "needle nowhere"), (41, "nowhere"), (42, None), (43, ""), (44, "Repeat!repeat"), (None, "ab nobody"), (44, "me")]
    return docs, items


@pytest.mark.parametrize(("block", "at_once", "first"), [(1 << 18, 256, 3), (50, 7, 1), (1, 1000, 0)])
def test_search_equals_brute_force(spark, documents, monkeypatch, block, at_once, first):
    docs, items = corpus(block)
    monkeypatch.setattr(R, "BLOCK", block)
    table = documents(docs).withColumn("n", F.lit("clash")).withColumn("m", F.lit(0))
    index, n_docs = R.build_index(table)
    got = rows(R.search(index, n_docs, spark.createDataFrame(items, ITEM).withColumn("term", F.lit("clash")), at_once=at_once, first=first))
    assert set(got) == brute(docs, items) and max(got.values()) == 1
    if block == 50:
        assert index.groupBy("m").count().where("count > 1").count() > 0
    held = index.select(F.sum(F.size("docs"))).first()[0]
    assert held == sum(bool(terms(t)) for _, t in docs)  # every document with a term


def test_strata_below_the_tenth_score_are_not_visited(spark, documents, monkeypatch):
    docs = [(k, "rare words here") for k in range(12)] + [(100 + k, "rare " + "filler " * k) for k in range(1, 400)]
    index, n_docs = R.build_index(documents(docs))
    visited, visit = [], R._visit
    monkeypatch.setattr(R, "_visit", lambda index, visits, *rest: visited.append(visits.count()) or visit(index, visits, *rest))
    items = [(1, "rare words here")]
    assert set(rows(R.search(index, n_docs, spark.createDataFrame(items, ITEM)))) == brute(docs, items)
    assert visited == [R.FIRST, 0] and index.select("m").distinct().count() > 100


def test_empty(spark, documents):
    docs, none = documents([(1, "a b")]), spark.createDataFrame([], ITEM)
    assert R.search(*R.build_index(docs), none).count() == 0
    assert R.search(*R.build_index(docs.where("doc_id < 0")), spark.createDataFrame([(1, "a")], ITEM)).count() == 0


def test_query_equals_brute_force_over_whole_tables(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows(R.op12_length_strata(spark, path))) == brute(docs, items)
