"""Session settings the library is written for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # days and hours are calendar values of the data, not of the cluster's zone
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # replacing dates must touch only the partitions that are written
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Put the library's settings on a session builder; cluster sizing stays with the caller.

    ``spark.sql.shuffle.partitions`` is deliberately left alone: on a cluster set it to a few
    times the number of cores and let AQE coalesce what turns out small.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    partitions = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("traffic_risk")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC -XX:-DontCompileHugeMethods")
        .config("spark.ui.showConsoleProgress", "false")
        # small inputs: keep partitions apart that a cluster would merge, or one core does it all
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.buffer.pageSize", "2m")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """Folder for streaming state and intermediate tables.

    On a cluster that is the shared ``spark.checkpoint.dir``; only where it is unset
    (local runs) a temporary folder is made and set for the rest of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="traffic_risk-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}"


_scratch: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below ``work_dir``; it is removed when the driver ends."""
    path = work_dir(spark, f"{name}-{uuid.uuid4().hex}")
    if not _scratch:
        atexit.register(_remove_scratch)
    _scratch.append((spark, path))
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(hadoop).delete(folder, True)


def _remove_scratch() -> None:
    for spark, path in _scratch:
        try:
            remove_folder(spark, path)
        except Exception:  # the session has ended: only a folder on this machine can still be reached
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, whatever folder the driver runs in."""
    context = spark.sparkContext
    if getattr(context, "_shipped_traffic_risk", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="traffic_risk-")) / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._shipped_traffic_risk = True
