import random
import re

import numpy as np
import pytest
import xxhash

from asmlens.llm import simhash as S
from asmlens.llm.components import connected_components


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "É É é x", "a b a b a b a b", "x " * 20_000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain(text)


def components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("split_above", [1000, 3])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, split_above):
    monkeypatch.setattr(S, "SPLIT_ABOVE", split_above)
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for base in list(fps[:12]):
        for _ in range(12):  # chains of close fingerprints, also three bits away
            base ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.append(base)
    fps = list(dict.fromkeys(fps))
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    found = connected_components(S.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()
    label = {r.node: r.component for r in found}
    want = components(fps)
    same = {}
    for v, w in zip(signed, want):
        same.setdefault(w, set()).add(label.get(v, v))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({label.get(v, v) for v in signed})


def test_near_duplicates_and_stage(spark, documents):
    long = " ".join(f"w{k}" for k in range(400))
    docs = documents([(5, long), (3, long), (3, long), (9, "other words here"), (7, None), (8, ""), (None, "other words here"), (4, long + " tail")])
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == 8
    by = {(r.doc_id, r.component_id) for r in rows}
    assert {(5, 3), (3, 3), (7, 7), (8, 7), (9, 9), (None, 9)} <= by
    kept = S.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({min(i for i, c in by if c == x and i is not None) for _, x in by})


def test_only_null_ids(spark, documents):
    kept = S.keep_one(spark, documents([(None, "a b c d"), (None, "a b c d")]), "").collect()
    assert len(kept) == 1 and kept[0].text == "a b c d"


def test_unlike_texts_without_ids_all_stay(spark, documents):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    kept = S.keep_one(spark, documents([(None, t) for t in [*texts, texts[0]]]), "").collect()
    assert sorted(r.text for r in kept) == texts


def test_one_id_on_unlike_texts(spark, documents):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    kept = S.keep_one(spark, documents([(5, a), (7, a), (5, b), (9, b)]), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, a), (5, b)]


def shares(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def planted(rng, n, length, changed):
    """Texts with a copy each in which ``changed`` words, six or more apart, are others."""
    out = []
    for k in range(n):
        a = [f"w{int(x)}" for x in rng.integers(0, 5000, length)]
        b = list(a)
        for at in range(changed):
            b[10 + at * ((length - 20) // changed)] = f"new{k}x{at}"
        out.append((" ".join(a), " ".join(b)))
    return out


@pytest.mark.parametrize("changed, low, high", [(2, 0.94, 1), (5, 0.85, 0.92), (8, 0.8, 0.84), (12, 0.6, 0.79)])
def test_stage_finds_planted_copies_by_five_word_similarity(spark, documents, changed, low, high):
    pairs = planted(np.random.default_rng(changed), 150, 400, changed)
    assert all(low <= shares(a, b) < high for a, b in pairs)
    docs = documents([(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)])
    kept = {r.doc_id for r in S.keep_one(spark, docs, "").collect()}
    assert {2 * k for k in range(150)} <= kept  # the lesser id stays
    copies = sum(2 * k + 1 in kept for k in range(150))
    print("changed", changed, "copies kept", copies)
    assert copies == 150 if high < 0.8 else copies <= 7


@pytest.mark.parametrize("split_above", [1000, 20])
def test_stage_joins_a_large_group_of_near_copies(spark, documents, monkeypatch, split_above):
    monkeypatch.setattr(S.similar, "SPLIT_ABOVE", split_above)
    rng = np.random.default_rng(1)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for k in range(300):
        t = list(base)
        t[int(rng.integers(0, 200))] = f"new{k}"
        texts.append(" ".join(t))
    kept = S.keep_one(spark, documents(list(enumerate(texts))), "").collect()
    assert [r.doc_id for r in kept] == [0]


def test_empty(spark, documents):
    empty = documents([(1, "a")]).where("doc_id < 0")
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(spark, empty, "").count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("(id * 37) % 200 as a", "((id * 37) % 200 + 1) % 200 as b").where("a <> 199")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.where("a < 0")).count() == 0


def test_pivot_table():
    """A pair's coordinates differ by at most its distance, and sums of twins depend on their own group of bits only."""
    rng = np.random.default_rng(7)
    fp = rng.integers(0, 2**63, 50, dtype=np.uint64)
    table = S.pivot_distances(fp).astype(int)
    flat = S.REFERENCES.ravel()
    assert table[3, 17] == (int(fp[3]) ^ int(flat[17])).bit_count()
    apart = np.array([[(int(a) ^ int(b)).bit_count() for b in fp] for a in fp])
    assert (np.abs(table[:, None] - table[None]).max(2) <= apart).all()
    other = fp ^ np.uint64(S.FULL ^ S.MASKS[4])  # all bits outside the fifth group turned
    sums = lambda x: S.pivot_distances(x).reshape(len(x), len(S.MASKS), S.PAIRS, 2).sum(3)
    assert (sums(fp)[:, 4] == sums(other)[:, 4]).all() and (sums(fp)[:, 3] != sums(other)[:, 3]).any()


def test_bits_and_bands_grow_with_the_texts():
    few, many = S.similar.samples(10_000), S.similar.samples(1 << 30)
    assert (len(few), len(few[0])) == (S.similar.BANDS, S.similar.TAKEN) and len(many[0]) == S.similar.TAKEN + 7
    meet = lambda bands: 1 - (1 - S.similar.AGREE ** len(bands[0])) ** len(bands)
    assert meet(many) >= meet(few) > 0.995
    assert all(len(set(b.tolist())) == len(b) for b in many) and (1 << 30) >> len(many[0]) <= S.similar.SPLIT_ABOVE


@pytest.mark.parametrize("few", [1 << 23, 16])
def test_near_copies_are_found_with_more_bits(spark, documents, monkeypatch, few):
    monkeypatch.setattr(S.similar, "FEW", few)
    dice = random.Random(few)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(150):
        base = dice.choices(words, k=120)
        twin = list(base)
        for at in dice.sample(range(120), 2):
            twin[at] = dice.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(twin))]
    same = {k: S.similar.jaccard(rows[2 * k][1].encode(), rows[2 * k + 1][1].encode()) >= 0.8 for k in range(150)}
    kept = {r.doc_id for r in S.keep_one(spark, documents(rows), "").select("doc_id").collect()}
    assert all(2 * k in kept for k in range(150)) and sum(same.values()) > 100
    assert sum(2 * k + 1 not in kept for k in range(150) if same[k]) >= 0.99 * sum(same.values())
    assert all(2 * k + 1 in kept for k in range(150) if not same[k])


def test_pivot_table_of_the_stage():
    """Sums of twins depend on their group only, coordinates never exceed the distance, and pairs found through them are all pairs."""
    rng, m = np.random.default_rng(9), S.similar
    fp = rng.integers(0, 2**64, (120, m.LANES), dtype=np.uint64)
    for k in range(60):  # copies with up to 70 bits turned, also beyond the reach
        bits = np.zeros(64 * m.LANES, bool)
        bits[rng.choice(64 * m.LANES, int(rng.integers(0, 71)), replace=False)] = True
        fp[60 + k] = fp[k] ^ np.packbits(bits, bitorder="little").view(np.uint64)
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    near = m.coordinates(fp)
    differ = np.bitwise_count(near[:, None] ^ near[None]).sum(2)
    assert (differ <= apart).all() and (differ[apart > 100] > m.REACH).mean() > 0.99
    bands = m.samples(100)
    refs = m.references(bands, len(bands[0]) - 4, 2)
    assert m.pivot_distances(fp, refs[5])[7, 3, 1] == sum((int(x) ^ int(y)).bit_count() for x, y in zip(fp[7], refs[5, 3, 1]))
    outside = np.ones(64 * m.LANES, bool)
    outside[bands[5]] = False
    turned = fp ^ np.packbits(outside, bitorder="little").view(np.uint64)
    assert (m.bucket_keys(fp, refs[5], 5) == m.bucket_keys(turned, refs[5], 5)).all()
    bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
    for band, sample in enumerate(bands):  # all that agree on a sample meet
        keys, agree = m.bucket_keys(fp, refs[band], band), (bits[:, None, sample] == bits[None][:, :, sample]).all(2)
        assert (keys[:, None] == keys[None])[agree].all()
    found = {(min(x, y), max(x, y)): d for a, b, c in m._near(np.zeros(120, np.int64), fp, near) for x, y, d in zip(a.tolist(), b.tolist(), c.tolist())}
    assert found == {(i, j): apart[i, j] for i in range(120) for j in range(i + 1, 120) if apart[i, j] <= m.REACH} and len(found) > 30


def test_a_link_is_found_though_nearer_edges_fail(spark, documents, monkeypatch):
    """The forest has the least distances; where its edges are no links, the pairs it left out are tried."""
    base = [f"w{k}" for k in range(300)]
    x, y, z = list(base), list(base), list(base)
    for k in range(3):
        x[20 + 40 * k], y[40 + 40 * k] = f"one{k}", f"two{k}"
    z[-1] = "odd"
    texts = [" ".join(t) for t in (x, y, z)]
    fp = np.stack([S.similar.wide_fingerprint(S.similar.shingles(t.encode())) for t in texts])
    a, b = np.array([0, 0, 1]), np.array([1, 2, 2])
    d = S.similar._distance(fp, a, b)
    assert sorted(S.similar.forest(a, b, d).tolist()) == [1, 2] and d.max() <= S.similar.REACH  # both edges at z
    monkeypatch.setattr(S.similar, "jaccard", lambda one, other, words: 0.0 if b"odd" in one + other else 1.0)
    assert sorted(r.doc_id for r in S.keep_one(spark, documents(list(enumerate(texts))), "").collect()) == [0, 2]
