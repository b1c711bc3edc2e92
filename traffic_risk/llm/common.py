"""What the text operators share: running a function over texts, written tables, fixed patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from traffic_risk.session import remove_folder, scratch_dir, ship_package

SPACE = "[\\x20\\x09-\\x0D]+"
"""White space between words, as a Java or Python pattern."""
SLICE_BYTES = 4 << 20
"""Bytes of rows that a function gets at once, on average."""


_REMEMBERED: dict[str, object] = {}


def remembered(key: str, make: Callable[[], object]):
    """What this Python worker remembers under a key, from its first task on."""
    if key not in _REMEMBERED:
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget(but: str | None = None) -> None:
    """Let go of what this Python worker remembers for other operators, which may be done."""
    others = [key for key in _REMEMBERED if key != but]
    for key in others:
        del _REMEMBERED[key]
    if others:
        pa.default_memory_pool().release_unused()


def map_texts(
    df: DataFrame,
    keys: Sequence[str | Column],
    text: str | Column,
    fn: Callable[[pa.RecordBatch, list], Iterable[Sequence]],
    schema: str | StructType,
    slice_bytes: int = SLICE_BYTES,
    remembers: str | None = None,
) -> DataFrame:
    """``fn(keys, texts)`` over batches of rows; only the named columns reach Python.

    ``fn`` gets the key columns of a batch and the list of its texts (null: empty) and gives the
    output columns, each as long as the batch. A Python worker serves one operator after the other: what others
    remember in it goes, all but that of the key ``remembers``.
    """
    ship_package(df.sparkSession)
    text = F.col(text) if isinstance(text, str) else text
    chosen = df.select(*keys, F.coalesce(text, F.lit("")).alias(fresh("_text", df.select(*keys))))
    if isinstance(schema, StructType):
        names = schema.fieldNames()
    else:
        names = [part.strip().split(" ")[0] for part in _top_level(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(remembers)
        for batch in batches:
            # a batch has a number of rows, not of bytes: take a few MB of it at a time
            rows = max(1, batch.num_rows * slice_bytes // max(batch.nbytes, 1))
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                columns = fn(part, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names
                )

    return chosen.mapInArrow(run, schema)


def as_bytes(values: pa.LargeBinaryArray | pa.LargeStringArray) -> list[bytes]:
    """All values, none of them null; much faster than one by one."""
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    raw = (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _top_level(schema: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared checkpoint folder: computed once, no lineage.

    The folder goes when the driver ends, or earlier by ``drop_written``.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table made by ``written`` that no later result reads; other tables stay."""
    if hasattr(df, "_written_to"):
        remove_folder(df.sparkSession, df._written_to)
