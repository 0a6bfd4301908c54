import hashlib

import numpy as np
import pytest

from asmlens.llm import suffix as S


def brute(texts, first):
    seen, out = {}, []
    windows = [[t[i : i + 200] for i in range(len(t) - 199)] for t in texts]
    for w in windows:
        for s in w:
            seen[s] = seen.get(s, 0) + 1
    met = set()
    for t, w in zip(texts, windows):
        gone = np.zeros(len(t), bool)
        for i, s in enumerate(w):
            if (s in met) if first else seen[s] > 1:
                gone[i : i + 200] = True
            met.add(s)
        out.append(gone)
    return out


def corpus():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(80), text(60), text(45)]
    texts = ["", "short", text(300), "a" * 700, "ab" * 400, text(2000), shared[0]]
    for k in range(25):
        texts.append(text(rng.integers(5, 60)) + shared[k % 3] + text(rng.integers(5, 60)) + (shared[0][50:300] if k % 4 == 0 else ""))
    texts += [texts[9], texts[9], shared[1] + shared[1], shared[2][:210], "x" + texts[5][100:900], "b" * 199, "b" * 199]
    return texts


@pytest.mark.parametrize("hot", [20_000, 2])
def test_spans_match_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus()
    raw = [t.encode() for t in texts]
    docs = documents([*enumerate(texts), (1000, None)])
    left, keyed = S.passages(docs)
    rows = {r.doc_id: r for r in keyed.join(left, ["k1", "k2"], "left").collect()}
    for k, (t, gone) in enumerate(zip(raw, brute(raw, False))):
        r = rows[k]
        if len(t) < 200:
            assert r.n_removed is None and not gone.any()
            continue
        want = hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
        assert (r.n_removed, r.kept_sha256) == (int(gone.sum()), want), k
        assert r.n_spans == int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    got = {r.doc_id: r.text for r in S.cut_later_copies(spark, docs, "").collect()}
    assert len(got) == len(texts) + 1 and got[1000] is None
    for k, (t, gone) in enumerate(zip(raw, brute(raw, True))):
        want = np.frombuffer(t, np.uint8)[~gone].tobytes()
        # a character cut in two stays whole
        assert 0 <= len(got[k].encode()) - len(want) <= 2 * (1 + gone.sum() // 200), k
        if "é" not in texts[k]:
            assert got[k].encode() == want


def test_ties_nulls_and_clashes(spark, documents):
    long = "".join(chr(97 + k * k % 26) + str(k) for k in range(200))
    docs = documents([(1, long), (1, long), (2, long), (None, long)]).withColumnRenamed("n_chars", "k1")
    out = S.cut_later_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 99, len(r.text)) for r in out.collect()) == [(1, len(long)), (1, len(long)), (2, 0), (99, 0)]
    empty = documents([(1, "a")]).where("doc_id < 0")
    assert S.cut_later_copies(spark, empty, "").count() == 0


def prefix(a, b, most):
    n = 0
    while n < min(len(a), len(b), most) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("text, depth", [(b"banana" * 50 + b"nab" * 30, 16), (b"abracadabra" * 9 + b"\x00\x00ab", 40), (bytes(np.random.default_rng(3).integers(97, 99, 400)), 200)])
def test_longest_previous_factors(text, depth):
    data, raw = np.frombuffer(text, np.uint8), text + b"\0" * (depth + 8)
    order = S.Suffixes(data, depth)
    heads = sorted({raw[i : i + depth] for i in range(len(data))})
    assert [heads[r] for r in np.unique(order.rank, return_inverse=True)[1]] == [raw[i : i + depth] for i in range(len(data))]
    suffix = np.lexsort((np.arange(len(data)), order.rank))
    common = np.zeros(len(suffix), np.int64)
    common[1:] = order.common(suffix[1:], suffix[:-1])
    assert common[1:].tolist() == [prefix(raw[i : i + depth], raw[j : j + depth], depth) for i, j in zip(suffix[1:], suffix)]
    earlier, later = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    earlier[suffix] = S.longest_previous_factors(suffix, common)
    later[suffix] = S.longest_previous_factors(-suffix, common)
    match = [[prefix(raw[i : i + depth], raw[j : j + depth], depth) for j in range(len(data))] for i in range(len(data))]
    assert earlier.tolist() == [max(m[:i], default=0) for i, m in enumerate(match)]
    assert later.tolist() == [max(m[i + 1 :], default=0) for i, m in enumerate(match)]


def test_factors_of_nothing_and_of_one():
    assert S.longest_previous_factors(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    assert S.longest_previous_factors(np.array([7]), np.array([0])).tolist() == [0]


def test_a_very_long_text(spark, documents):
    rng = np.random.default_rng(8)
    part = "".join(map(chr, rng.integers(97, 123, 3000)))
    long = "".join(map(chr, rng.integers(97, 123, 1_500_000))) + part
    rows = {r.doc_id: r.text for r in S.cut_later_copies(spark, documents([(1, long), (2, "x" * 100 + part)]), "").collect()}
    assert rows == {1: long, 2: "x" * 100}
