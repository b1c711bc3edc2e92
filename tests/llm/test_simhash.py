"""Fingerprints and groups against a plain version; links against all pairs."""

import random
import re

import pytest
import xxhash

from traffic_risk.llm.components import components
from traffic_risk.llm import simhash
from traffic_risk.llm.simhash import ball_links, fingerprint, fingerprints, keep_one, links, simhash_groups

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(found):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    root = {i: i for i, _ in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in found:
        for j, y in found:
            if i < j and bin(x ^ y).count("1") <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in root}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    got = simhash_groups(docs).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == dict(prints)
    assert {r.doc_id: r.component_id for r in got} == plain_groups(prints)


@pytest.mark.parametrize("shared", [64, 3, 1])
def test_links_keep_components_of_random_prints(spark, monkeypatch, shared):
    monkeypatch.setattr(simhash, "SHARED", shared)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = set(seeds)
    for s in seeds:
        for _ in range(25):
            x = s
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    stars = {r.node: r.root for r in components(links(frame), "fp", "hub").collect()}
    want = plain_groups([(v, v % (1 << 64)) for v in signed])
    assert {v: stars.get(v, v) for v in signed} == want


def test_segments_shared_by_many_make_no_square(spark):
    """2,000 fingerprints of one second segment and 2,000 of one first segment, a link here and there."""
    rng = random.Random(8)
    low = rng.sample(range(1 << 32), 2000)
    values = {(77 << 32) | x for x in low} | {(x << 32) | 5 for x in rng.sample(range(1 << 32), 2000)}
    for x in low[:40]:
        values |= {(77 << 32) | (x ^ 3), (77 << 32) | (x ^ (1 << 9)), ((77 ^ 1) << 32) | (x ^ 4)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(8)
    got = {r.node: r.root for r in components(links(frame), "fp", "hub").collect()}
    want = {r.node: r.root for r in components(ball_links(frame), "fp", "hub").collect()}
    assert got == want and len(got) >= 160
    found = links(frame).collect()
    assert len(found) < 3 * len(got)


def test_long_texts_and_ties(spark):
    long = " ".join(str(i % 997) for i in range(150_000))
    rows = [(3, long, "a"), (1, long + " 997", "b"), (2, long, "c"), (2, long, "d"), (9, "other words than those", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.doc_id, r.component_id) for r in simhash_groups(docs).collect()} == {(3, 1), (1, 1), (2, 1), (9, 9)}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 9]


def test_keep_one_restores_all_columns(spark):
    names = "doc_id long, text string, fp string, root string, place int, _salt int, _text string, hub long, node long, members string, Value int"
    rows = [(i, "same words in all of these" if i % 2 else f"text number {i} of its own", *"xy", 1, 2, "t", 3, 4, "m", i) for i in range(6)]
    docs = spark.createDataFrame([*rows, (None, "same words in all of these", *"xy", 1, 2, "t", 3, 4, "m", 9)], names)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(r for r in rows if r[0] in (0, 1, 2, 4))


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(edges, "a", "b").collect()} == {0}


@pytest.mark.parametrize("text", ["", " \t\n", "one", "one two", "É é A a", "a\x0bb c\x1cd", "w " * 3000])
def test_single_texts(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b c d", "z"), (7, "a b c d", "z"), (9, "q r s t u", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r)[0] or 0, r.component_id) for r in simhash_groups(docs).collect())
    assert got == [(0, 7), (1, 1), (2, 1), (2, 1), (7, 7), (9, 9)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(docs).collect() == []
    assert fingerprints(docs, "doc_id", "text").collect() == []
