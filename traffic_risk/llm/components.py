"""Connected components of a graph given as edges, by alternating large and small stars.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii: Connected Components in MapReduce and
Beyond (2014). Every round is a minimum per node and a join back, so no list of neighbours is ever
built; hubs are split by adaptive execution, see ``attach``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traffic_risk.functions.skew import attach
from traffic_risk.llm.common import drop_written, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row per node with an edge: ``node`` and ``root``, the smallest node it is joined to.

    Loops, repeated edges and either direction are allowed; rows with a null end are ignored.
    """
    ends = F.col(a), F.col(b)
    now = edges.select(F.greatest(*ends).alias("v"), F.least(*ends).alias("u")).where(
        ends[0].isNotNull() & ends[1].isNotNull() & (F.col("u") < F.col("v"))
    )
    now = written(now.distinct(), "edges")
    state = None
    while True:
        following = written(_small_star(_large_star(now)), "edges")
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = following
        if state == mark:
            break
        state = mark
    roots = now.groupBy("u").agg(F.lit(1)).select(F.col("u").alias("node"), F.col("u").alias("root"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = attach(both.where("v > u"), smallest, ["u"], ["v"], how="inner")
    return linked.where("v <> m").select("v", F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of them."""
    smallest = edges.groupBy("v").agg(F.min("u").alias("m"))
    linked = attach(edges, smallest, ["v"], ["u"], how="inner")
    moved = linked.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(smallest.select("v", F.col("m").alias("u"))).distinct()
