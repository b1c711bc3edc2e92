"""Isolation forest and boosted trees over user-day features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traffic_risk.columns import FEATURES, USER_DAY
from traffic_risk.functions import exact_quantiles
from traffic_risk.params import ForestParams
from traffic_risk.session import ship_package
from traffic_risk.sources.store import require_columns

EULER = 0.5772156649015329


def normalize_anomaly(prediction: Column, encoding: str) -> Column:
    """Raw prediction -> -1 (anomalous) or 1.

    ``signed`` predictions are -1 or 1 already; ``binary`` ones are bot scores cut at 0.5. The
    encoding is said by the caller, never guessed from the data.
    """
    if encoding == "signed":
        rule = prediction == -1
    elif encoding == "binary":
        rule = prediction >= 0.5
    else:
        raise ValueError(f"unknown encoding {encoding}")
    return F.when(rule, F.lit(-1)).otherwise(F.lit(1))


def single_prediction(per_class: Column, encoding: str) -> Column:
    """One number out of a per-class array: column 1 for bot scores, else the largest's index."""
    if encoding == "binary":
        return F.get(per_class, 1)
    return (F.array_position(per_class, F.array_max(per_class)) - 1).cast("double")


def clip_probability(prob: Column) -> Column:
    p = F.coalesce(prob, F.lit(0.0))
    p = F.when(F.isnan(p), F.lit(0.0)).otherwise(p)
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))


def class_probability(per_class: Column, classes: Sequence, bot_label=1) -> Column:
    """Probability of the bot class, found by its label, else column 1, else the only column."""
    at = list(classes).index(bot_label) if bot_label in classes else (1 if len(classes) > 1 else 0)
    return clip_probability(F.get(per_class, at))


def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) that depends on the parts alone, not on the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _model_input(df: DataFrame, features: Sequence[str]) -> list[Column]:
    require_columns(df, [*USER_DAY, *features], "feature table")
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]


def draw_samples(df: DataFrame, features: Sequence[str], params: ForestParams) -> DataFrame:
    """``sample_size`` rows per tree on average, chosen by hashes of the user-day.

    Every pair of a row and a tree is drawn with the same chance, whatever the size of the table. How many
    trees a row goes to is binomial and comes from one hash; only rows that go to any pick their trees.
    """
    n = df.count()
    chance = min(1.0, params.sample_size / max(n, 1))
    trees = params.trees
    below, steps = 0.0, []
    for k in range(trees):
        below += math.comb(trees, k) * chance**k * (1 - chance) ** (trees - k)
        steps.append(below)
        if below >= 1.0 - 2.0**-53:
            break
    seed = F.lit(params.seed)
    rows = df.select(*USER_DAY, *_model_input(df, features), _uniform(*USER_DAY, seed).alias("_u"))
    drawn = rows.where(F.col("_u") >= steps[0])
    limits = F.array(*[F.lit(s) for s in steps])
    times = F.size(F.filter(limits, lambda limit: limit <= F.col("_u")))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    order = F.array_sort(F.transform(every, lambda t: F.struct(F.xxhash64(*USER_DAY, seed + 1, t).alias("h"), t.alias("t"))))
    return drawn.withColumn("tree", F.explode(F.transform(F.slice(order, 1, times), lambda s: s["t"]))).drop("_u")


def average_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary search tree of ``n`` nodes."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


_NODE = "tree int, node int, feature int, threshold double, left int, right int, path double"


def _grow(sample: pd.DataFrame, features: list[str], limit: int, seed: int) -> pd.DataFrame:
    """One isolation tree from one tree's sample (a few hundred rows)."""
    sample = sample.sort_values(list(USER_DAY))
    x = sample[features].to_numpy(float)
    tree = int(sample["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    unit = max(average_path(len(x)), 1.0)  # of the rows this tree has seen
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = me
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([tree, me, -1, 0.0, me, me, (depth + average_path(len(rows))) / unit])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:  # neighbouring floats: rounding must not leave a side empty
            cut = float(low[f])
        nodes.append([tree, me, f, cut, -1, -1, 0.0])
        below = x[rows, f] <= cut
        todo.append((rows[~below], depth + 1, me, 1))
        todo.append((rows[below], depth + 1, me, 0))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])


BLOCK = 8192
"""Rows that go down a forest together."""


def _paths(x: np.ndarray, trees: list) -> np.ndarray:
    """Path of every row (a column of ``x``) in every tree."""
    n = x.shape[1]
    values, row = x.ravel(), np.arange(n)
    out = np.empty((n, len(trees)))
    for t, (depth, feature, cut, following, path) in enumerate(trees):
        node, first = np.zeros(n, dtype=np.intp), feature * n
        for _ in range(depth):
            below = values.take(first.take(node) + row) <= cut.take(node)
            node = following.take(2 * node + below)
        out[:, t] = path.take(node)
    return out


@dataclass(frozen=True)
class IsolationForest:
    """Fitted forest: at most trees x (2 x sample_size - 1) nodes, about 3 MB with the defaults.

    ``path`` of a leaf is its depth in units of the mean path length for the rows its tree was grown on.
    """

    features: tuple[str, ...]
    nodes: pd.DataFrame
    threshold: float = 0.5

    def _arrays(self):
        """Per tree: depth, and per node feature, cut, the two next nodes (of values above the cut first) and path; a leaf leads to itself."""
        trees = []
        for _, own in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            feature, left, right = (own[c].to_numpy(np.intp) for c in ("feature", "left", "right"))
            following = np.column_stack((right, left))
            depth, level = 0, np.array([0], dtype=np.intp)
            while (feature[level] >= 0).any():
                level = following[level[feature[level] >= 0]].ravel()
                depth += 1
            cut = np.where(feature >= 0, own["threshold"].to_numpy(float), np.inf)
            trees.append((depth, np.maximum(feature, 0), cut, following.ravel(), own["path"].to_numpy(float)))
        return trees

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """Anomaly score in (0, 1); the trees travel as a broadcast of fixed size.

        A block of rows goes down one tree after the other, a level at a time, so a tree and the block's values stay in the processor's cache.
        """
        spark = df.sparkSession
        ship_package(spark)
        trees = spark.sparkContext.broadcast(self._arrays())

        @F.pandas_udf("double")
        def forest(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in columns])
            total = np.empty(x.shape[1])
            for at in range(0, len(total), BLOCK):
                part = x[:, at : at + BLOCK]
                total[at : at + BLOCK] = _paths(np.ascontiguousarray(part), trees.value).mean(axis=1)
            return pd.Series(np.power(2.0, -total))

        return df.withColumn(name, forest(*_model_input(df, self.features)))

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.score(df)
        raw = F.when(F.col("anomaly_score") > F.lit(self.threshold), -1).otherwise(1)
        return scored.withColumn("model_anomaly", normalize_anomaly(raw, "signed"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        head = [(list(self.features), self.threshold)]
        spark.createDataFrame(head, "features array<string>, threshold double").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        head = spark.read.parquet(f"{path}/head").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        return cls(tuple(head["features"]), nodes.reset_index(drop=True), head["threshold"])


def iforest_fit(
    df: DataFrame, features: Sequence[str] = FEATURES, params: ForestParams = ForestParams()
) -> IsolationForest:
    """Grow the trees in parallel, one task group per tree, and set the cut at the contamination
    quantile of the training scores."""
    names = list(features)
    limit = math.ceil(math.log2(max(params.sample_size, 2)))
    seed = params.seed

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        return _grow(sample, names, limit, seed)

    ship_package(df.sparkSession)
    samples = draw_samples(df, names, params)
    nodes = samples.groupBy("tree").applyInPandas(grow, _NODE).toPandas()
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    if nodes.empty:
        raise ValueError("no rows to fit an isolation forest on")
    forest = IsolationForest(tuple(names), nodes)
    cut = exact_quantiles(
        forest.score(df), [], "anomaly_score", {"cut": 1.0 - params.contamination}, 0.0, 1.0
    ).first()["cut"]
    return IsolationForest(forest.features, forest.nodes, cut)


def iforest_score(df: DataFrame, model: IsolationForest) -> DataFrame:
    return model.transform(df)


@dataclass(frozen=True)
class BoostedTrees:
    """Fitted boosted-tree classifier over a fixed feature list."""

    features: tuple[str, ...]
    model: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        inputs = _model_input(df, self.features)
        packed = df.withColumns({f"_in_{c}": e for c, e in zip(self.features, inputs)})
        scored = self.model.transform(packed)
        prob = class_probability(vector_to_array("probability"), [0, 1])
        return scored.select(*df.columns, prob.alias("xgb_bot_prob")).withColumn(
            "model_anomaly", normalize_anomaly(F.col("xgb_bot_prob"), "binary")
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        model = PipelineModel.load(path)
        inputs = model.stages[0].getInputCols()
        return cls(tuple(c.removeprefix("_in_") for c in inputs), model)


def gbt_fit(
    df: DataFrame,
    label: str,
    features: Sequence[str] = FEATURES,
    rounds: int = 20,
    depth: int = 4,
    seed: int = 42,
) -> BoostedTrees:
    """Boosted trees on labelled user-days (label 1 = bot)."""
    names = tuple(features)
    inputs = _model_input(df, names)
    rows = df.select(*[e.alias(f"_in_{c}") for c, e in zip(names, inputs)], F.col(label).cast("double"))
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"_in_{c}" for c in names], outputCol="_features"),
            GBTClassifier(
                featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed
            ),
        ]
    )
    return BoostedTrees(names, pipeline.fit(rows))


def gbt_score(df: DataFrame, model: BoostedTrees) -> DataFrame:
    return model.transform(df)


def score_features(features: DataFrame, model: IsolationForest | BoostedTrees) -> DataFrame:
    """Score a stored feature table; fails when it lacks one of the model's features.

    Earlier scores in the table are dropped, so both models can share one table.
    """
    bare = features.drop("model_anomaly", "xgb_bot_prob", "anomaly_score")
    return model.transform(bare)
