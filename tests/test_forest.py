"""Rows that go down a forest, against a walk of one row after the other."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from traffic_risk.operators import models


def grown(rng, features, n_trees):
    trees = []
    for tree in range(n_trees):
        sample = pd.DataFrame(np.round(rng.exponential(2, (64, len(features))), 1), columns=features)
        trees.append(models._grow(sample.assign(tree=tree, date=0, distinct_id=np.arange(64)), features, 6, 1))
    lone = [[n_trees, 0, -1, 0.0, 0, 0, 0.7]]  # a tree of one leaf
    return pd.concat([*trees, pd.DataFrame(lone, columns=trees[0].columns)]).reset_index(drop=True)


def plain_path(nodes, row):
    at = 0
    while nodes[at]["feature"] >= 0:
        at = int(nodes[at]["left"] if row[int(nodes[at]["feature"])] <= nodes[at]["threshold"] else nodes[at]["right"])
    return nodes[at]["path"]


def test_paths_follow_the_nodes(spark):
    rng = np.random.default_rng(3)
    names = ["a", "b", "c"]
    nodes = grown(rng, names, 5)
    forest = models.IsolationForest(tuple(names), nodes)
    x = np.round(rng.exponential(2, (300, 3)), 1)
    x[:3, 0] = [np.nan, np.inf, -np.inf]
    by_tree = [own.sort_values("node").to_dict("records") for _, own in nodes.groupby("tree")]
    want = np.array([[plain_path(own, row) for own in by_tree] for row in x])
    found = models._paths(np.ascontiguousarray(x.T), forest._arrays())
    assert np.array_equal(found, want)
    rows = [("2024-01-01", str(k), *map(float, row)) for k, row in enumerate(x)]
    df = spark.createDataFrame(rows, "date string, distinct_id string, a double, b double, c double")
    scored = {int(r.distinct_id): r.anomaly_score for r in forest.score(df).collect()}
    assert np.array_equal([scored[k] for k in range(len(x))], np.power(2.0, -want.mean(axis=1)))
    assert forest.score(df.where(F.lit(False))).collect() == []
