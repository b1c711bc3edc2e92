"""Leaks against plain search, paraphrases, odd rows; the factorisation against numpy's."""

import random

import numpy as np
import pytest

from traffic_risk.llm import decontaminate as dc
from traffic_risk.llm import registry

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_lcs(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcde") for _ in range(rng.randrange(70))] for _ in range(2))
    assert dc.lcs(a, b) == plain_lcs(a, b)


def test_whole_table_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    true = {(d.doc_id, i) for d in docs for i, t in items if t in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op6_decontaminate"](spark, SF).collect()}
    assert true and true <= got
    words = {d.doc_id: dc.words_of(d.text or "") for d in docs}
    asked = {i: dc.words_of(t) for i, t in items}
    for d, i in got - true:  # other spellings of the item only
        assert plain_lcs(asked[i], words[d]) >= 0.55 * len(asked[i])


def prose(rng, n):
    return [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(n)]


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(5)
    item, short, common = prose(rng, 30), ["q1", "q2", "q3"], ["the"] * 10
    fuzzy = list(item)
    for k in range(0, 25, 6):
        fuzzy[k] = "zzz"
    loose = [w for k, w in enumerate(item) if k % 3 or k > 24]  # most of it, and its last words
    half = item[:15]
    rows = [
        (1, " ".join([*prose(rng, 100), *item, *prose(rng, 50)])),
        (2, " ".join([*prose(rng, 33), *fuzzy, *prose(rng, 10)])),
        (3, " ".join([*prose(rng, 20), *loose, *prose(rng, 20)])),
        (4, " ".join([*prose(rng, 20), *half, *prose(rng, 60)])),
        (5, " ".join([*prose(rng, 40), *short, *prose(rng, 40)])),
        (6, " ".join([*prose(rng, 40), *reversed(item), *prose(rng, 40)])),
        (7, None), (8, ""), (9, " ".join(item).upper()), (9, " ".join(item).upper()), (None, " ".join(item)),
    ] + [(100 + k, " ".join(["the", *prose(rng, 60)])) for k in range(60)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, cosine double")
    tests = [(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(common)), (4, None), (5, ""), (6, " ".join(item))]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    for block in (4096, 2):
        found = dc.find_leaks(docs, bench, params=dc.LeakParams(block_items=block)).collect()
        got = sorted((r.doc_id or 0, r.item_id) for r in found)
        whole = [(d, i) for d in (0, 1, 2, 3, 9, 9) for i in (1, 6)]
        assert got == sorted([*whole, (5, 2)]), block
    left = dc.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {4, 6, 7, 8} | set(range(100, 160))
    assert dc.find_leaks(docs.limit(0), bench).collect() == []
    assert dc.find_leaks(docs, bench.limit(0)).collect() == []


def test_basis_spans_dominant_directions(spark):
    rng = random.Random(2)
    vocabulary = prose(rng, 40)
    groups = [rng.sample(vocabulary, 6) for _ in range(4)]
    texts = [" ".join(rng.choice(groups[k % 4]) for _ in range(32)) for k in range(120)]
    terms = {t.encode(): k for k, t in enumerate(sorted(set(vocabulary)))}
    weights = np.ones(len(terms))
    items = [dc.words_of(t) for t in texts]
    sample = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    basis = dc.fit(sample, items, terms, weights, dc.LeakParams(rank=4, extra=8))
    rows = np.zeros((len(texts), len(terms)))
    for k, t in enumerate(texts):
        for w in dc.words_of(t):
            rows[k, terms[w]] += 1
    best = np.linalg.svd(rows, full_matrices=False)
    optimum = np.linalg.norm(rows - rows @ best[2][:4].T @ best[2][:4])
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-8)
    assert np.linalg.norm(rows - rows @ basis @ basis.T) < 1.1 * optimum


def test_space_is_fitted_on_all_documents(spark):
    """More documents than a sample would hold, against the factorisation of all their passages."""
    rng = random.Random(3)
    vocabulary = sorted(set(prose(rng, 24)))
    texts = [" ".join(rng.choices(vocabulary[k % 20 :][:5], k=rng.randrange(1, 50))) for k in range(6000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    params = dc.LeakParams(rank=4, extra=40, common_share=1.0)
    index = dc.build(docs, [(1, " ".join(vocabulary))], "text", params)[0]
    terms = {w.encode(): k for k, w in enumerate(vocabulary)}
    rows, held = [], [set(t.encode().split()) for t in texts]
    for words in [t.encode().split() for t in texts]:
        for at in range(0, len(words), 32):
            rows.append(np.bincount([terms[w] for w in words[at : at + 32]], minlength=len(terms)))
    df = np.array([sum(w in h for h in held) for w in terms])
    weights = np.maximum(np.log((len(texts) + 1) / (df + 0.5)), params.least_weight)
    rows, own = np.array(rows), np.ones(len(terms)) * weights
    boost = (rows.sum(axis=0) * weights**2).sum() / (own**2).sum()
    best = np.linalg.eigh((rows * weights).T @ (rows * weights) + boost * np.outer(own, own))[1][:, -4:]
    basis = index.latent / weights[:, None]
    assert list(index.terms) == list(terms)
    assert np.allclose(basis @ basis.T, best @ best.T, atol=1e-4)


def test_hot_long_and_common_items(spark):
    """Items leaked into a third of the documents, of 300 words, of everyday words, and paraphrases of them."""
    rng = random.Random(9)
    everyday = ["the", "of", "and", "to", "in", "is", "it", "for", "was", "on", "are", "as", "with", "his", "they", "at"]
    hot, long_, common = prose(rng, 30), prose(rng, 300), rng.choices(everyday, k=24)
    tests = [(1, " ".join(hot)), (2, " ".join(long_)), (3, " ".join(common))]
    rows, want = [], set()

    def filler(n):
        return [w for x in prose(rng, n) for w in (x, rng.choice(everyday))]

    def loose(words):
        return [w if rng.random() > 0.15 else "zzz" for w in words]

    for d in range(300):
        words = filler(60)
        if d % 3 == 0:
            words += (loose(hot) if d % 2 else hot) + filler(rng.randrange(20))
            want.add((d, 1))
        if d % 50 == 7:
            words += (loose(long_) if d % 4 == 1 else long_) + filler(rng.randrange(20))
            want.add((d, 2))
        if d % 50 == 11:
            words += common + filler(rng.randrange(20))
            want.add((d, 3))
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    assert {g for g in got if g[1] == 3} >= {w for w in want if w[1] == 3}
    paraphrased = {w for w in want if w[1] < 3 and plain_lcs(dc.words_of(tests[w[1] - 1][1]), dc.words_of(rows[w[0]][1])) >= 0.76 * len(tests[w[1] - 1][1].split())}
    assert got >= paraphrased and len(paraphrased) > 80
    assert got <= want


def test_rate_of_paraphrases_found(spark):
    """Four hundred paraphrases with graded edits: words replaced, left out, put in or swapped. At least nine in ten are found."""
    rng = random.Random(21)
    vocabulary = prose(rng, 4000)
    items = [rng.choices(vocabulary, k=rng.randrange(20, 90)) for _ in range(40)]
    rows, planted, plain = [], {}, 0
    for d in range(400):
        item = rng.randrange(40)
        out, edits = [], rng.uniform(0.0, 0.24)
        for w in items[item]:
            kind = rng.random()
            if kind < 0.5 * edits:
                out.append(rng.choice(vocabulary))
            elif kind < 0.75 * edits:
                continue
            elif kind < edits:
                out += [w, rng.choice(vocabulary)]
            else:
                out.append(w)
        if len(out) > 4 and rng.random() < 0.3:
            k = rng.randrange(len(out) - 1)
            out[k], out[k + 1] = out[k + 1], out[k]
        if plain_lcs(items[item], out) >= dc.LeakParams().least_lcs * len(items[item]):
            planted[d] = item
        rows.append((d, " ".join([*rng.choices(vocabulary, k=rng.randrange(200)), *out, *rng.choices(vocabulary, k=rng.randrange(200))])))
    rows += [(1000 + d, " ".join(rng.choices(vocabulary, k=300))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    caught = sum((d, i) in got for d, i in planted.items())
    assert len(planted) > 300 and caught >= 0.9 * len(planted), (caught, len(planted))
    assert not any(d >= 1000 for d, _ in got)


def test_rows_without_id_stay_if_they_do_not_leak(spark):
    rng = random.Random(3)
    item = " ".join(prose(rng, 30))
    rows = [(None, f"{' '.join(prose(rng, 40))} {item}", 1), (None, " ".join(prose(rng, 60)), 2), (None, None, 3), (7, f"{item} x", 4), (7, " ".join(prose(rng, 50)), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob int")
    bench = spark.createDataFrame([(1, item), (2, item), (None, item)], "item_id long, text string")
    assert sorted(r.blob for r in dc.drop_leaks(docs, bench).collect()) == [2, 3, 5]
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in dc.find_leaks(docs, bench).collect()) == [(0, 0), (0, 1), (0, 2), (7, 0), (7, 1), (7, 2)]


def test_long_texts_are_searched_in_stretches(monkeypatch):
    rng = random.Random(4)
    vocabulary = prose(rng, 300)
    items = [[w.encode() for w in rng.choices(vocabulary, k=40)] for _ in range(5)]
    words = [w.encode() for w in rng.choices(vocabulary, k=5000)]
    for k, item in enumerate(items):
        words[700 * k + 13 : 700 * k + 13] = item
    terms = {w.encode(): k for k, w in enumerate(sorted(set(vocabulary)))}
    latent = np.linalg.qr(np.random.default_rng(1).standard_normal((len(terms), 64)))[0].astype(np.float32)
    pieces = [(k, p) for k, item in enumerate(items) for p in dc.pieces_of(item, 32)]
    vectors = np.array([latent[[terms[w] for w in p]].sum(axis=0) for _, p in pieces])
    lengths = np.linalg.norm(vectors, axis=1)
    index = dc.Index(terms, latent, list(range(5)), items, np.array([k for k, _ in pieces]), vectors / lengths[:, None], lengths)
    whole = sorted((w, i, round(c, 5)) for w, i, c in dc.candidates(words, index, dc.LeakParams()))
    monkeypatch.setattr(dc, "STRETCH", 7)
    assert sorted((w, i, round(c, 5)) for w, i, c in dc.candidates(words, index, dc.LeakParams())) == whole
    assert {i for _, i, _ in whole} == set(range(5))
