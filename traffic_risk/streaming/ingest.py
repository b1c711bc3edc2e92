"""Incremental ingest: new event files go into the day-partitioned raw table, and the days they
touch are scored again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from traffic_risk.sources.store import append_batch, claim_name
from traffic_risk.sources.versions import Derive


def ingest_batch(
    batch: DataFrame,
    batch_id: int,
    raw_path: str,
    on_dates: Callable[[list[str]], None] | None = None,
    name: str = "stream",
    derive: Derive | None = None,
) -> None:
    """Append one micro-batch to the raw table and hand the touched days to ``on_dates``.

    The ingest's name and the batch id are a partition level below the day: replaying a batch after a failure
    writes the same rows to the same place, and other ingests have places of their own. The batch is read once; the days are
    those written. Features need whole days, so ``on_dates`` reads the days back rather than the batch.
    """
    days = append_batch(batch.where(F.col("date").isNotNull()), raw_path, name, batch_id, derive)
    if on_dates is not None and days:
        on_dates(days)


def stream_ingest_rescore(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    raw_path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    on_dates: Callable[[list[str]], None] | None = None,
    glob: str = "*.parquet",
    files_per_trigger: int = 1000,
    name: str = "stream",
    derive: Derive | None = None,
) -> StreamingQuery:
    """Take in all new files of ``source``, then stop.

    ``derive`` makes tables that are kept with every batch, such as ``partials.stored``, so that scoring a touched day
    merges a few partial aggregates and reads no events.

    ``name`` belongs to ``checkpoint`` for good: batch numbers start anew with a new checkpoint, which so needs a name of
    its own, and so does every other source of the same raw table.

    ``prepare`` turns file rows into page views (the source filter); ``on_dates`` is
    ``rescore_store`` bound to a store and its models, or any other day-wise job.
    """
    claim_name(spark, raw_path, name, checkpoint)
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source)
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, raw_path, on_dates, name, derive)

    return (
        prepare(stream)
        .writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

