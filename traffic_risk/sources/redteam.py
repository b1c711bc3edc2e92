"""Red-team result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_VERSION = "未知版本"
_COUNTS = (
    "user_days",
    "iforest_black",
    "xgb_05_black",
    "xgb_09_black",
    "xgb_095_black",
    "both_black",
    "xgb_high_new",
    "xgb_mid_new",
    "xgb_edge",
)
_FIELDS = [
    ("scenario", "string"),
    ("attack_type", "string"),
    *[(c, "bigint") for c in _COUNTS],
    ("verdict", "string"),
    ("resolution_z_mean", "double"),
    ("resolution_z_p95", "double"),
]
_RECORDS = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in _FIELDS) + ">>"
SCHEMA = f"attack_results {_RECORDS}, normal_results {_RECORDS}, model_version string"


def read_redteam_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Attack and normal records of a result file, each with the model version.

    Records are read with a fixed schema: columns a file lacks are null, and a file without a version
    gets a placeholder. A file without one of the arrays is an error.
    """
    payload = spark.read.schema(SCHEMA).json(path, multiLine=True)
    version = F.coalesce("model_version", F.lit(UNKNOWN_VERSION)).alias("model_version")

    def records(name: str) -> DataFrame:
        present = F.coalesce(name, F.raise_error(F.lit(f"result file has no {name}")))
        return payload.select(version, F.inline(present))

    return records("attack_results"), records("normal_results")
