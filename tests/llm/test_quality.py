import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asmlens.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w, seen, dup = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    c, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = ["", None, " \n\t ", "a", "a b c a b c", "x\nx\nx \n\nx", "é à\x0bü # $ | x", "the cat sat on the cat sat on", "a\n\n b\n b\na", "\n", "日本 語\n日本 語", "w " * 3000]


def test_statistics_match_brute_force(documents):
    docs = documents(list(enumerate(TEXTS)) + [(99, "a b c a b c")]).withColumn("model_index", F.lit("clash")).withColumn("model_name", F.lit("clash"))
    rows = Q.report(docs, Q.fit_models(docs, least_texts=1)).select("doc_id", "text", "model_index", "quality.*").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert (r.log_perplexity is None) == (not r.text) and r.model_index == "clash"


@pytest.mark.parametrize("text", ["", "a", "ab\n", "é🙂x", "日本"])
def test_codes_are_utf16_units_after_the_edge(text):
    raw = (text + "z").encode()
    got, ends = Q.codes(np.frombuffer(raw, np.uint8), np.array([0, len(text.encode()), len(raw)]))
    units = np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist()
    padded = [Q.EDGE] * 3 + units
    want = [sum(u << (16 * (3 - k)) for k, u in enumerate(padded[i : i + 4])) for i in range(len(units))]
    assert got.tolist() == [*want, (Q.EDGE << 48) + (Q.EDGE << 32) + (Q.EDGE << 16) + ord("z")] and ends.tolist() == [0, len(units), len(units) + 1]


def reference(texts, least=2, order=4):
    """A plain modified Kneser-Ney model; n-grams are tuples of units."""
    units = [np.frombuffer(t.encode("utf-16-le"), np.uint16).tolist() for t in texts if t]
    counts = {order: collections.Counter(tuple(([Q.EDGE] * 3 + u)[i : i + order]) for u in units for i in range(len(u)))}
    for o in range(order - 1, 0, -1):
        counts[o] = collections.Counter(g[1:] for g in counts[o + 1])
    share, back = {}, {}
    for o, found in counts.items():
        n = [sum(c == k for c in found.values()) for k in (1, 2, 3, 4)]
        d = [0.5] * 3 if not all(n) else [k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1] for k in (1, 2, 3)]
        d = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.85))]
        total = collections.Counter()
        for g, c in found.items():
            total[g[:-1]] += c
        for g, c in found.items():
            if c >= least or o == 1:
                share[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]]
                back[g[:-1]] = back.get(g[:-1], 1.0) - share[g]

    def p(g):
        return share.get(g, 0.0) + back.get(g[:-1], 1.0) * p(g[1:]) if g else 1 / (len(counts[1]) + 1)

    return p, sorted(g[0] for g in counts[1])


def test_model_is_modified_kneser_ney(documents):
    rng = np.random.default_rng(2)
    texts = [prose(rng, 40, "abcé🙂") for _ in range(30)] + ["xyz", "", None]
    model = Q.fit_models(documents(list(enumerate(texts))), least_texts=5).models[0]
    p, alphabet = reference(texts)
    pack = lambda g: sum(u << (16 * (3 - k)) for k, u in enumerate(g))
    heads = [tuple(([Q.EDGE] * 3 + [ord(c) for c in t])[-3:]) for t in ("", "a", "ab", "cba", "zzz", "xy")]
    for head in heads:
        grams = [(*head, u) for u in [*alphabet, 0x4E00]]
        got = np.exp(model.score(np.array([pack(g) for g in grams], np.uint64)))
        assert np.allclose(got, [p(g) for g in grams], rtol=1e-4)
        assert abs(got.sum() - 1) < 1e-4  # 0x4E00 stands for any other unit


def test_models_are_bounded_and_counts_merge(documents, monkeypatch):
    monkeypatch.setattr(Q, "FLUSH", 50)
    rng = np.random.default_rng(4)
    texts = [prose(rng, 100) for _ in range(20)]
    docs = documents(list(enumerate(texts)))
    found = Q.fit_models(docs, least_texts=5, most=100).models[0]
    assert all(len(found.grams[o]) <= 100 for o in (2, 3, 4))
    rows = list(Q._count(iter([pa.RecordBatch.from_arrays([pa.array([0] * 20, pa.int32()), pa.array(texts)], names=["m", "text"])])))
    merged = collections.Counter()
    for b in rows:
        for code, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            merged[code] += n
    assert sum(merged.values()) == sum(map(len, texts))


def prose(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(n)) + "."


def words_of(rng, n, known):
    return " ".join(rng.choice(known, n)) + "."


def test_default_bands_reject_outliers_of_both_sides_by_language(spark, documents):
    """Each language's own texts stay; dull and strange texts go, also such as the other language would keep."""
    rng = np.random.default_rng(1)
    vocabulary = {"en": prose(rng, 60, "aeioutnsrh").split(), "fr": prose(rng, 60, "éèçqxzjkvw").split()}
    parts, base = [], 0
    for lang, known in vocabulary.items():
        other = vocabulary["fr" if lang == "en" else "en"]
        rows = [(base + k, words_of(rng, 200, known)) for k in range(150)]
        dull = "".join(known[0][:3])
        rows += [(base + 500, prose(rng, 200, "0123456789@#%?!+=")), (base + 501, words_of(rng, 200, other)), (base + 502, " ".join(dull * (k % 9 + 1) + known[0][0] * (k // 9) for k in range(100)))]
        parts.append(documents(rows, lang=lang))
        base += 1000
    docs = parts[0].unionByName(parts[1])
    kept = {r.doc_id for r in Q.quality(docs).where("quality.kept").collect()}
    scored = {r.doc_id: r.quality for r in Q.quality(docs).collect()}
    for start in (0, 1000):
        own = [scored[start + k].log_perplexity for k in range(150)]
        assert len([k for k in range(start, start + 150) if k in kept]) >= 148
        assert scored[start + 500].log_perplexity > max(own) and start + 500 not in kept
        assert scored[start + 501].log_perplexity > max(own) and start + 501 not in kept
        assert not scored[start + 502].base_failed and scored[start + 502].log_perplexity < min(own) and start + 502 not in kept
    assert sorted(r.doc_id for r in Q.keep_good(spark, docs, "").collect()) == sorted(kept)


def test_languages_and_clashing_columns(spark, documents):
    docs = documents([(1, "a b c")]).unionByName(documents([(2, "d e f")], lang=None)).withColumn("quality", F.lit(5)).withColumn("band_low", F.lit(1)).withColumn("kept", F.lit(1))
    out = Q.quality(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "band_low", "kept", "quality"] and out.count() == 2
    kept = Q.keep_good(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 0
    two = Q.fit_models(docs, least_texts=1)
    assert sorted(r.name for r in two.names.collect()) == ["=en", "null"] and len(two.models) == 2


def test_small_languages_are_judged_by_the_base_rules(spark, documents):
    rng = np.random.default_rng(6)
    text = prose(rng, 80)
    docs = documents([(1, text), (1, text), (2, "few words")], lang="xx")
    assert [r.doc_id for r in Q.keep_good(spark, docs, "").collect()] == [1, 1]


def test_a_very_long_text(documents):
    docs = documents([(1, "word " * 700_000), (2, None)])
    r = Q.report(docs, Q.fit_models(docs, least_texts=1)).where("doc_id = 1").first().quality
    assert (r.n_words, r.word_chars, r.n_repeat_words) == (700_000, 2_800_000, 700_000) and r.log_perplexity > 0


def test_empty_table(spark, documents):
    empty = documents([(1, "a")]).where("doc_id < 0")
    assert Q.quality(empty).count() == 0 and Q.keep_good(spark, empty, "").count() == 0


def test_ngrams_beyond_the_collected_ones_count_in_full(spark, documents, monkeypatch):
    """Scores don't depend on how many n-grams are collected, also of texts that the models are not of."""
    rng = np.random.default_rng(8)
    own = documents([(k, t) for k, t in enumerate([prose(rng, 80) for _ in range(30)] + ["", None])] + [(40, "a b c"), (41, "a b c")])
    own = own.unionByName(documents([(100 + k, prose(rng, 80, "éèç🙂日本")) for k in range(20)], lang="fr")).withColumn("text_key", F.lit("clash"))
    strange = own.unionByName(documents([(200, prose(rng, 60, "xyz#é")), (201, "never seen before: 日本")]).withColumn("text_key", F.lit(None).cast("string")))
    whole, part = Q.fit_models(own, least_texts=5), Q.fit_models(own, least_texts=5, most=40)
    for docs in (own, strange):
        want, got = ({(r.doc_id, r.text_key): r.quality for r in Q.report(docs, models).collect()} for models in (whole, part))
        assert want.keys() == got.keys() and len(got) == docs.count()
        for k, q in want.items():
            assert (q.log_perplexity is None) == (got[k].log_perplexity is None), k
            assert q.log_perplexity is None or abs(q.log_perplexity - got[k].log_perplexity) < 1e-5, k
    assert all(sum(len(m.grams[o]) for m in part.models.values()) <= 40 for o in (1, 2, 3, 4)) and 40 < sum(len(m.grams[4]) for m in whole.models.values())
    kept = {r.doc_id for r in Q.keep_good(spark, own, "").collect()}
    monkeypatch.setattr(Q, "fit_models", lambda docs, text, lang: part)
    assert kept and {r.doc_id for r in Q.keep_good(spark, own, "").collect()} == kept
