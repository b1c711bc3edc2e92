"""Rounds against a plain version with exact integers; the query's SQL is compared with the other queries' (test_queries)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from traffic_risk.llm import clustering, registry
from traffic_risk.llm.clustering import ClusterParams, cluster
from verification.compare import connect, differences

SF = "/root/testdata/sf0.001"


def plain(rows, dims, k, rounds):
    import hashlib

    def good(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [min(max(math.floor(256 * x), -(1 << 26)), 1 << 26) for x in v]) for i, v in rows if good(v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]
    if not cents:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    told = [(i, *nearest(v)) for i, v in kept]
    within = {}
    for _, d, c in told:
        within[c] = within.get(c, 0) + d
    return sorted(((i is None, i, c, d, within[c], sum(within.values()), cents[c]) for i, d, c in told), key=repr)


def found(df):
    return sorted(((r[0] is None, *r) for r in map(tuple, df.collect())), key=repr)


def test_whole_table_against_sql(spark):
    query = registry.QUERIES["op11_clusters"](spark, SF)
    assert differences(query, connect(SF), registry.CHECKS["op11_clusters"]) is None


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_do_not_change_anything(spark, block):
    rng = random.Random(block)
    base = [[rng.gauss(0, 0.2) for _ in range(7)] for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(i, [rng.uniform(-2, 2) for _ in range(7)]) for i in range(300, 420)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = cluster(frame, params=ClusterParams(dims=7, k=6, rounds=4, block=block))
    assert found(got) == plain(rows, 7, 6, 4)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [-0.5, 0.0]), (None, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [inf, 0.0]),
        (6, [nan, 0.0]), (7, [1e30, -1e30]), (8, []), (9, [-0.001, 0.001]), (10, [0.5, 0.5]), (11, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    assert found(cluster(frame, params=ClusterParams(dims=2, k=3, rounds=3))) == plain(rows, 2, 3, 3)


def test_equal_vectors_and_few_rows(spark):
    rows = [(i, [0.25, -0.25]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.cluster, r.distance, r.inertia) for r in cluster(frame, params=ClusterParams(dims=2)).collect()} == {(0, 0, 0)}
    one = cluster(frame.limit(1), params=ClusterParams(dims=2)).collect()
    assert [(r.cluster, r.distance) for r in one] == [(0, 0)]


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = cluster(frame)
    assert got.columns[:3] == ["vec_id", "cluster", "distance"] and got.collect() == []


def test_chunks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(clustering, "CHUNK", 37)
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    chunks = clustering.encode(frame, "vec_id", "embedding", ClusterParams(dims=4)).select(F.size("ids").alias("n")).collect()
    assert sum(r.n for r in chunks) == 200
    assert found(cluster(frame, params=ClusterParams(dims=4, k=5, rounds=2))) == plain(rows, 4, 5, 2)
