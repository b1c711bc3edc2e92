"""Suffix arrays against sorting; removed bytes against a plain version, also with hot groups."""

import hashlib
import random
from collections import Counter

import pytest

from traffic_risk.llm import registry, substring_dedup
from traffic_risk.llm.substring_dedup import DedupParams, remove_repeated
from traffic_risk.llm.suffixes import repeated_starts, suffix_array

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """(bytes, removed, spans, digest of the rest) of every text."""
    data = [(t or "").encode() for t in texts]
    n = Counter()
    for t in data:
        for i in range(len(t) - length + 1):
            n[hashlib.blake2b(t[i : i + length], digest_size=16).digest()] += 1
    out = []
    for t in data:
        inside = bytearray(len(t))
        reach = 0
        for i in range(len(t)):
            if i + length <= len(t) and n[hashlib.blake2b(t[i : i + length], digest_size=16).digest()] > 1:
                reach = i + length
            inside[i] = i < reach
        rest = bytes(b for b, x in zip(t, inside) if not x)
        spans = sum(x and not (i and inside[i - 1]) for i, x in enumerate(inside))
        out.append((len(t), sum(inside), spans, hashlib.sha256(rest).hexdigest()))
    return out


def result(rows):
    return sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(20):
        s = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed", range(40))
def test_segments(seed):
    rng, length = random.Random(seed), 40
    letters = rng.choice([b"ab", b"abc\0", bytes(range(97, 120))])
    pool = bytes(rng.choice(letters) for _ in range(200))
    segments = []
    for _ in range(rng.randrange(1, 8)):
        a = rng.randrange(0, 100)
        data = bytearray(pool[a : a + length + rng.randrange(0, 60)])
        if rng.random() < 0.5:
            data[rng.randrange(len(data))] = rng.choice(letters)
        segments.append((bytes(data), 100 - a, len(data) - length + 1))
    placed, any_ = Counter(), Counter()
    for data, anchor, k in segments:
        for x in range(k):
            placed[data[x : x + length], (x - anchor) % 16] += 1
            any_[data[x : x + length]] += 1
    for (data, anchor, k), found in zip(segments, repeated_starts(segments, length)):
        for x in range(k):
            assert found[x] or placed[data[x : x + length], (x - anchor) % 16] == 1
            assert not found[x] or any_[data[x : x + length]] > 1


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = sorted((d.doc_id, *w) for d, w in zip(docs, plain([d.text for d in docs], 400)))
    assert result(registry.QUERIES["op1_suffix_dedup"](spark, SF).collect()) == want


def made(rng):
    """Texts with copies, shared passages in other contexts, repeats inside a text, runs of one byte."""
    def prose(n):
        return " ".join(rng.choice("the of an re ti on ör é ban cal dor".split()) + str(rng.randrange(30)) for _ in range(n))

    passages = [prose(20), prose(60), prose(100)]
    texts = [None, "", "short", "x" * 700, "xy" * 300, "x" * 150, "a" * 99 + "b"]
    for _ in range(40):
        parts = [prose(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        texts.append(rng.choice([" ", ""]).join(parts))
    texts += rng.sample(texts, 10)
    twice = prose(50)
    return [*texts, f"{twice} {prose(3)} {twice}"]


@pytest.mark.parametrize("seed, most", [(1, 4096), (2, 4096), (3, 2), (4, 1), (5, 5)])
def test_made_texts(spark, seed, most):
    texts = made(random.Random(seed))
    rows = [(i + 1, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    params = DedupParams(length=100, most=most)
    want = sorted((i + 1, *w) for i, w in enumerate(plain(texts, 100)))
    assert result(remove_repeated(docs, params=params).collect()) == want


def test_seams_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdef ") for _ in range(6000))
    texts = [base, "zz" + base[1000:5000] + "yy", base[2500:2700], base[300:420]]
    monkeypatch.setattr(substring_dedup, "PLACE_BITS", 10)
    found = [substring_dedup.anchors_of(t.encode(), 100) for t in texts]
    assert all(sum(part[4].sum() for part in f) == max(0, len(t) - 99) for f, t in zip(found, texts))
    for f in found:
        assert [int(x) for part in f for a, n in zip(part[3], part[4]) for x in range(a, a + n)] == list(range(sum(p[4].sum() for p in f)))


def test_odd_rows(spark):
    rng = random.Random(1)
    long, other = ("".join(rng.choice("abcdefgh") for _ in range(500)) for _ in range(2))
    rows = [(1, long), (1, long), (2, other), (2, "q"), (None, long[:450]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(remove_repeated(docs).collect())
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 0, 0), (0, 450, 450), (1, 500, 500), (1, 500, 500), (2, 1, 0), (2, 500, 0)]
    assert remove_repeated(docs.limit(0)).collect() == []
