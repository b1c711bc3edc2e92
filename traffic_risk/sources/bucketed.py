"""Tables that are dealt by key once, on write, so that joins and groups by that key shuffle nothing.

A table is a set of Parquet files in buckets by a hash of its keys, one file a bucket and write, sorted by the keys. Tables with the same keys and
number of buckets are joined bucket by bucket. Conditions on the first key skip row groups by their statistics. The bucketing is kept in a small file
beside the data, so any session can open a table by its path.

A bucket holds all rows of its keys; buckets are sized for the largest key, as there is no shuffle left that adaptive execution could split.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from traffic_risk.columns import USER_DAY
from traffic_risk.sources import versions

_SPEC = "_bucketed.json"


def _name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:16]}"


def write_bucketed(df: DataFrame, path: str, buckets: int, keys: Sequence[str] = USER_DAY, append: bool = False) -> DataFrame:
    """Write a table, or add rows to one, and open it. Rows are shuffled once, here; every task writes one bucket."""
    spark, root = df.sparkSession, path.rstrip("/")
    if append:
        have = spec(spark, root)
        if (have["buckets"], have["keys"]) != (buckets, list(keys)):
            raise ValueError(f"{path} has {have['buckets']} buckets by {have['keys']}")
        open_bucketed(spark, root)
        df = df.select(*spark.table(_name(root)).columns)
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", root)
    writer.mode("append" if append else "overwrite").saveAsTable(_name(root))
    versions.write_text(spark, f"{root}/{_SPEC}", json.dumps({"buckets": buckets, "keys": list(keys), "schema": df.schema.toDDL()}))
    return open_bucketed(spark, root)


def spec(spark: SparkSession, path: str) -> dict:
    """Number of buckets, keys and schema of a table."""
    return json.loads(versions.read_text(spark, f"{path.rstrip('/')}/{_SPEC}"))


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with its bucketing, also one that another session wrote."""
    root = path.rstrip("/")
    if not spark.catalog.tableExists(_name(root)):
        have = spec(spark, root)
        keys = ", ".join(f"`{k}`" for k in have["keys"])
        spark.sql(
            f"CREATE TABLE {_name(root)} ({have['schema']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {have['buckets']} BUCKETS LOCATION '{root}'"
        )
    return spark.table(_name(root))


def forget(spark: SparkSession, path: str) -> None:
    """Take a table out of this session's catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
