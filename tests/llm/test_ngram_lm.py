"""Counts and base scores against a plain version; the automaton against the backoff formula; sums to one."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traffic_risk.llm import ngram_lm, registry

SF = "/root/testdata/sf0.01"
END = "</end>"


def plain_tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), END]


def plain_model(texts, order, least, discount):
    """Probability of a word after a context, by recursion."""
    n = [Counter() for _ in range(order + 1)]
    for t in texts:
        words = [END, *plain_tokens(t)]
        n[1].update((w,) for w in words[1:])
        for k in range(2, order + 1):
            n[k].update(tuple(words[i - k + 1 : i + 1]) for i in range(k - 1, len(words)))
    total, v = sum(n[1].values()), len(n[1])
    least = max(least * total, 2)
    kept = [None, {g for g, c in n[1].items() if c >= least}]
    for k in range(2, order + 1):
        kept.append({g for g, c in n[k].items() if c >= least and g[:-1] in kept[k - 1] and g[1:] in kept[k - 1]})
    members = {}
    for k in range(2, order + 1):
        for g in kept[k]:
            members.setdefault(g[:-1], []).append(g)

    lefts = {}

    def p(context, word):
        context = context[-(order - 1) :]
        if not context:
            return (n[1][(word,)] + 1) / (total + v + 1)
        if context not in members:
            return p(context[1:], word)
        grams = members[context]
        k = len(context) + 1
        all_ = n[k - 1][context]  # every context is followed by something
        if context not in lefts:
            lefts[context] = 1 - sum(n[k][g] - discount for g in grams) / all_
        left = lefts[context]
        own = n[k][(*context, word)] - discount if (*context, word) in kept[k] else 0
        return own / all_ + left * p(context[1:], word)

    return p, n[1], total, v


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    p, c, total, v = plain_model([t for i, t in docs.items() if not held[i]], 1, 0, 0)
    rows = registry.QUERIES["op8_ngram_lm"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = plain_tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(c[(w,)] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((c[(w,)] + 1) / (total + v + 1)) for w in words), rel=1e-9)
    fresh = [r for r in rows if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


@pytest.mark.parametrize("order, share", [(1, 0.01), (2, 0.001), (3, 0.02), (4, 0.01)])
def test_scores_follow_the_formula(spark, order, share):
    texts = ["a b a b a c", "a b c a b d", "B a b a b", "", None, "x a b a b a c c c", "a b a b a c"] * 3
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "q a b a", "z"), (99, "unseen a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    params = ngram_lm.LmParams(order=order, share=share)
    held = F.coalesce(F.col("doc_id") == 99, F.lit(False))
    got = {r.doc_id: r for r in ngram_lm.score_texts(docs, held, params=params).collect()}
    assert len(got) == len(rows)
    p, c, total, v = plain_model([t for i, t, _ in rows if i != 99], order, share, params.discount)
    for i, text, _ in rows:
        words = plain_tokens(text)
        path = [END, *words]
        want = sum(math.log10(p(tuple(path[max(0, k - order + 1) : k]), path[k])) for k in range(1, len(path)))
        assert got[i].score == pytest.approx(want, rel=1e-9), text
    vocabulary = [w for (w,) in c]
    for context in [(END,), ("a",), ("a", "b"), ("b", "a"), ("never", "a")]:
        unseen = p(context, "never seen")
        assert sum(p(context, w) for w in vocabulary) + unseen == pytest.approx(1)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = ngram_lm.score_texts(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert ngram_lm.score_texts(docs.limit(0), F.lit(False)).collect() == []


def test_ngrams_seen_twice_count_in_any_corpus(spark):
    """100,000 other tokens do not push out n-grams that occur twice."""
    texts = ["red green blue", "red green blue"] + [" ".join(f"w{40 * i + j}" for j in range(40)) for i in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score_texts(docs, F.lit(False)).where("doc_id < 2").collect()}
    p, *_ = plain_model(texts, 3, 0, ngram_lm.LmParams().discount)
    path = [END, *plain_tokens(texts[0])]
    want = sum(math.log10(p(tuple(path[max(0, k - 2) : k]), path[k])) for k in range(1, len(path)))
    assert got[0].score == pytest.approx(want, rel=1e-9)
    assert got[0].score > got[0].base_score + 8


@pytest.mark.parametrize("block_bytes", [3_000, 16 << 20])
def test_whole_small_table_follows_the_formula(spark, monkeypatch, block_bytes):
    """Every score of the 200 documents, whatever the number of blocks and parts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    monkeypatch.setattr(ngram_lm, "PART_KEYS", 9_000)
    params = ngram_lm.LmParams(block_bytes=block_bytes)
    rows = ngram_lm.score_texts(docs, registry.language.held_out("doc_id", 7, 2), params=params).collect()
    p, *_ = plain_model([t for i, t in texts.items() if not held[i]], 3, 0, params.discount)
    assert len(rows) == len(texts)
    for r in rows:
        path = [END, *plain_tokens(texts[r.doc_id])]
        want = sum(math.log10(p(tuple(path[max(0, k - 2) : k]), path[k])) for k in range(1, len(path)))
        assert r.score == pytest.approx(want, rel=1e-9)


def block_of(texts, order):
    import numpy as np

    number, codes, sizes = {ngram_lm.END: 0}, [], []
    for t in texts:
        words = [ngram_lm.END, *ngram_lm.tokens(t)]
        codes += [number.setdefault(w, len(number)) for w in words]
        sizes.append(len(words))
    hashes = np.array([ngram_lm.xxhash.xxh3_64_intdigest(w) for w in number], dtype=np.uint64)
    row = {"codes": ngram_lm._pack_planes(np.array(codes, dtype=np.int32), 4), "n": len(codes), "sizes": sizes, "held": [False] * len(texts), "words": hashes.tobytes()}
    return ngram_lm.Grams(row, order)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_stretches_walk_like_one_reader(monkeypatch, order):
    """A reader with one state, a word at a time, against all stretches of the texts at once; failure arcs lead to shorter contexts."""
    import random

    import numpy as np

    rng = random.Random(order)
    texts = [" ".join(rng.choices("abcdef", k=rng.randrange(60))) for _ in range(30)] + ["a b c " * 700]
    grams = block_of(texts, order)
    passing = [grams.different(1)]
    passing = [(passing[0][0], *passing[0])]
    told = []
    for k in range(1, order + 1):
        keys, where, counts = grams.different(k)
        if k > 1:
            context = grams.keys[k - 2][where - 1]
            by = np.lexsort((keys, context))
            context, keys, where, counts = context[by], keys[by], where[by], counts[by]
            passing.append((context, keys, where, counts))
            kept = counts >= 2
            given = [float((counts[(context == c) & kept] - 0.5).sum()) for c in ngram_lm._contexts(passing, k)]
            told.append({"k": k, "part": 0, "n": len(keys), "m": len(given), "kept": np.packbits(kept).tobytes(), "counts": ngram_lm._pack(counts[kept]), "given": ngram_lm._pack(np.array(given))})
        else:
            told.append({"k": 1, "part": 0, "n": len(keys), "counts": ngram_lm._pack(counts)})
    n, v = int((grams.sizes - 1).sum()), len(grams.hashes)
    machine, _ = ngram_lm.automaton(grams, passing, told, n, v, ngram_lm.LmParams(order=order))
    assert (machine.fail[1 : 1 + v] == 0).all() and (machine.fail_weight <= 1e-12).all()
    alone, at = [], 0
    for size in grams.sizes.tolist():
        state = np.zeros(1, dtype=np.int64)
        for place in range(at, at + size):
            state, more = machine.read(state, grams.codes[place : place + 1])
            alone.append(0.0 if place == at else float(more[0]))
        at += size
    for stretch in (7, 512, 10_000):
        monkeypatch.setattr(ngram_lm, "STRETCH", stretch)
        assert ngram_lm.walk(grams, machine, order).tolist() == alone


def test_memory_of_a_block():
    """The automaton is made order by order: beside the texts it takes a bounded number of bytes a token, all n-grams kept."""
    import random
    import tracemalloc

    import numpy as np

    order, rng = 3, random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(250)] * 2
    grams = block_of(texts, order)
    told, below = [], None
    for k in range(1, order + 1):
        keys, where, counts = grams.different(k)
        if k == 1:
            told.append({"k": 1, "part": 0, "n": len(keys), "counts": ngram_lm._pack(counts), "passed": None})
        else:
            context = grams.keys[k - 2][where - 1]
            counts = counts[np.argsort(context, kind="stable")]
            context = np.sort(context)
            first = np.searchsorted(context, below), np.searchsorted(context, below, side="right")
            sums = np.append(0, np.cumsum(counts - 0.5))
            ones = np.packbits(np.ones(len(keys), dtype=np.uint8)).tobytes()
            given = ngram_lm._pack(sums[first[1]] - sums[first[0]])
            told.append({"k": k, "part": 0, "n": len(keys), "m": len(below), "passed": ones, "kept": ones, "counts": ngram_lm._pack(counts), "given": given})
        below = keys
    n, v = int((grams.sizes - 1).sum()), len(grams.hashes)
    tracemalloc.start()
    try:
        machine, _ = ngram_lm.automaton(grams, ngram_lm._passing(grams, told, order), told, n, v, ngram_lm.LmParams(order=order))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(machine.arcs) > 0.9 * n  # the texts are there twice, with two orders of arcs
    assert peak < 130 * n


def test_words_are_found_together():
    import random

    import pyarrow as pa

    rng = random.Random(4)
    signs = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", "\x08", "\x0e", "\x1f", "a", "A", "Z", "@", "[", "é", "É", "\xa0", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(7))) for _ in range(2000)] + ["", " ", "a", "", "b"]
    for some in (texts, texts[7:60], [""], ["", ""], ["x"], [" ", "y"]):
        words, codes, sizes = ngram_lm._numbered(pa.array(["left out", *some], pa.large_string()).slice(1))
        ends = [0, *sizes.cumsum().tolist()]
        want = [[ngram_lm.END, *ngram_lm.tokens(t)] for t in some]
        assert [[words[c] for c in codes[a:b]] for a, b in zip(ends, ends[1:], strict=False)] == want
        assert words[0] == ngram_lm.END and len(set(words)) == len(words)


def test_order_of_hashes():
    import numpy as np

    rng = np.random.default_rng(5)
    close = rng.integers(0, 40, 3000).astype(np.uint64)  # hashes that differ in their last bits only
    for values in (rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), close, close << np.uint64(58), close[:1], close[:0]):
        assert ngram_lm._order(values).tolist() == np.argsort(values, kind="stable").tolist()


def test_packing_costs_no_python_call_a_word(spark, monkeypatch):
    import cProfile
    import pstats
    from types import SimpleNamespace

    import pyarrow as pa

    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    caught = []
    whole = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, fn, schema: caught.append(fn) or SimpleNamespace(withColumn=lambda *_: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        ngram_lm.packed(docs, "id", "text", F.lit(False), ngram_lm.LmParams())
    monkeypatch.setattr(type(docs), "mapInArrow", whole)

    def calls(times):
        texts = ["Some words that come again and again. " * times] * 20
        batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([False, True] * 10), pa.array(texts)], ["id", "held", "text"])
        profile = cProfile.Profile()
        (block,) = profile.runcall(list, caught[0](iter([batch])))
        assert block.column("n").to_pylist() == [20 * (7 * times + 2)] and block.column("train").to_pylist() == [10 * (7 * times + 1)]
        return pstats.Stats(profile).total_calls

    calls(1)
    assert calls(200) < calls(2) + 20 * 7 * 198 / 10
