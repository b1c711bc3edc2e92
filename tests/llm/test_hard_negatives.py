"""Mined rows against all pairs; elimination of cells against distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traffic_risk.llm import hard_negatives, registry
from traffic_risk.llm.hard_negatives import mine
from traffic_risk.llm.split_tree import grow, products
from verification.compare import connect, differences

SF = "/root/testdata/sf0.001"


def plain(rows, anchors, dims):
    """Rows (id, vector, label) by comparing all pairs."""

    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(256 * x) for x in v] + [0] * (dims - len(v)), c) for i, v, c in rows if good(v) and c is not None]
    out = []
    for a, (i, v, c) in enumerate(kept):
        if i is None or not anchors(i):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), j is None, j, d) for b, (j, w, d) in enumerate(kept) if b != a]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for s in [s for s in scored if s[3] == c][:5]:
            fit = [n for n in scored if n[3] != c and 30 * -s[0] <= 100 * -n[0] <= 90 * -s[0]][:10]
            out += [(i, s[2], r + 1, n[2], -s[0], -n[0]) for r, n in enumerate(fit)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table_against_sql(spark):
    query = registry.QUERIES["op13_hard_negatives"](spark, SF)
    assert differences(query, connect(SF), registry.CHECKS["op13_hard_negatives"]) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_clustered_vectors_with_small_blocks_and_sample(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = []
    for i in range(700):
        c = rng.randrange(12)
        rows.append((i, [x + rng.gauss(0, 0.1 * (1 + c)) for x in centres[c]], rng.choice([c % 4, rng.randrange(4)])))
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(300)]  # a vector with a third of all rows
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = mine(frame, F.col("vec_id") % 20 == 0)
    assert found(got) == plain(rows, lambda i: i % 20 == 0, 5)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.3], 2), (2, [0.5, 0.3], 2), (3, [0.6, 0.2], None), (4, None, 2),
        (5, [nan, 1.0], 2), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (None, [0.6, 0.3], 2), (None, [0.9, 0.5], 1), (8, [0.7], 3), (9, [], 3),
        (10, [-1.0, -1.0], 1), (100, [0.0, 0.0], 1),
    ]
    schema = "vec_id long, embedding array<double>, label int, rid string, leaf int, place int, anchor string"
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema)
    got = mine(frame, F.col("vec_id") % 100 == 0)
    assert found(got) == plain(rows, lambda i: i % 100 == 0, 2)
    assert any(r.negative_id is None for r in got.collect())


def test_empty_tables_and_no_anchor(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mine(frame, F.col("vec_id") % 100 == 0).collect() == []
    frame = spark.createDataFrame([(1, [1.0], 1), (3, [2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert mine(frame, F.col("vec_id") % 100 == 0).collect() == []


def test_cells_out_of_reach_hold_nothing():
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.integers(-300, 300, 6) + rng.integers(-20, 20, (50, 6)) for _ in range(30)])
    tree = grow(rows[rng.permutation(len(rows))[:400]], int((rows**2).sum(axis=1).max()))
    leaf, told = tree.cells(rows)
    tree.low = np.full((256, told.shape[1]), np.nan)
    tree.high = tree.low.copy()
    for n in np.unique(leaf):
        tree.low[n], tree.high[n] = told[leaf == n].min(axis=0), told[leaf == n].max(axis=0)
    anchors = rows[::97]
    scores = products(anchors, rows)
    gone = 0
    for i in range(len(anchors)):
        best = np.sort(scores[i])[::-1]
        least, most = float(best[40]), float(best[10])
        a = anchors[i : i + 1]
        reach = [tree.radius(a, np.array([[x]]))[:, 0] for x in (most, least)]
        opened = set(tree.open_cells(a, *reach))
        inside = set(leaf[(scores[i] >= least) & (scores[i] <= most)].tolist())
        assert inside <= opened
        gone += len(np.unique(leaf)) - len(opened)
    assert gone > len(anchors) * 20  # clustered vectors: most cells are eliminated


def test_products_of_large_numbers_are_exact():
    a = np.array([[1 << 26, (1 << 26) - 1]])
    assert products(a, a)[0, 0] == (1 << 52) + ((1 << 26) - 1) ** 2
