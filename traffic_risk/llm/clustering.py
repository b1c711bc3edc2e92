"""Lloyd rounds over vectors of integers by dictionaries of their subvectors.

Jegou, Douze and Schmid: Product quantization for nearest neighbor search (2011) has the tables of partial
distances; here the dictionaries are lossless, so all distances are exact.

Vectors are read once, in chunks of at most ``CHUNK`` rows. Of a chunk, the components are cut into blocks, every
block is written as the list of its different subvectors and a 16-bit code for each row, and the chunk is one row of a table in the
shared folder. A round takes the squared distance of every listed subvector to all centroids once, and a
vector's distance is the sum over its codes. Dictionaries belong to their chunk, so their size has a bound for
any values, and no round shuffles vectors: a task sends one row of exact sums for each centroid.

Defined cases: vectors of another length than ``dims``, null ones and those with a null or non-finite component take no part; rows
without id are clustered but are no first centroid; rows of one id are rows of their own, and of equal hashes the smaller
vector comes first; with fewer rows than ``k`` there are as many centroids as rows; an empty table gives an empty result; whole
components beyond 2^26 count as 2^26, with their sign; only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.llm.common import drop_written, written
from traffic_risk.llm.vectors import LIMIT, SCALE, finite, whole
from traffic_risk.session import ship_package

CHUNK = 1 << 15
"""Rows that share their dictionaries; codes have 16 bits."""


@dataclass(frozen=True)
class ClusterParams:
    dims: int = 64
    k: int = 40
    rounds: int = 5
    block: int = 2
    """Components of a subvector."""
    seed: str = "2:"
    """The first centroids are the rows with the smallest SHA-256 of this and their id."""


def encode(vectors: DataFrame, id_col: str, vec_col: str, params: ClusterParams) -> DataFrame:
    """One row for each chunk: ``ids``, ``codes`` (a row of 16-bit codes for each block) and ``words`` (each block's subvectors)."""
    ship_package(vectors.sparkSession)
    dims, width = params.dims, params.block

    def chunk(ids: list, parts: list) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        codes, words = [], []
        for first in range(0, dims, width):
            different, code = np.unique(rows[:, first : first + width], axis=0, return_inverse=True)
            codes.append(code.reshape(-1).astype(np.uint16).tobytes())
            words.append(different.astype(np.int32).tobytes())
        columns = [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.binary())), pa.array([words], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "codes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                if held + part.num_rows > CHUNK:
                    yield chunk(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(part.column(0))
                parts.append(whole(part.column(1), dims))
                held += part.num_rows
        if held:
            yield chunk(ids, parts)

    chosen = vectors.where(finite(vec_col, dims)).select(F.col(id_col).cast("long"), vec_col)
    return chosen.mapInArrow(run, "ids array<bigint>, codes array<binary>, words array<binary>")


def distances(codes: list[bytes], words: list[bytes], centroids: np.ndarray, block: int) -> np.ndarray:
    """Squared distances of a chunk's vectors (rows) to the centroids: partial distances of subvectors, added up by code."""
    n = len(codes[0]) // 2
    out = np.zeros((n, len(centroids)), dtype=np.int64)
    for b, (code, word) in enumerate(zip(codes, words, strict=True)):
        part = centroids[:, b * block : (b + 1) * block]
        different = np.frombuffer(word, dtype=np.int32).reshape(-1, part.shape[1]).astype(np.int64)
        table = np.zeros((len(different), len(centroids)), dtype=np.int64)
        for j in range(part.shape[1]):
            table += (different[:, j, None] - part[None, :, j]) ** 2
        out += table[np.frombuffer(code, dtype=np.uint16)]
    return out


def _sums(chunks: DataFrame, centroids: np.ndarray, params: ClusterParams) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sum of their components for each centroid that has any."""
    dims, block = params.dims, params.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros((len(centroids), dims), dtype=np.int64)
        for batch in batches:
            for codes, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nearest = distances(codes, words, centroids, block).argmin(axis=1)
                number += np.bincount(nearest, minlength=len(centroids))
                for b, (code, word) in enumerate(zip(codes, words, strict=True)):
                    different = np.frombuffer(word, dtype=np.int32).reshape(-1, min(block, dims - b * block))
                    # how often each subvector went to each centroid, then the sums of subvectors times that
                    place = nearest * len(different) + np.frombuffer(code, dtype=np.uint16)
                    times = np.bincount(place, minlength=len(centroids) * len(different))
                    times = times.reshape(len(centroids), len(different))
                    total[:, b * block : (b + 1) * block] += times @ different.astype(np.int64)
        used = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(number[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    parts = chunks.select("codes", "words").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    exact = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()  # one row a centroid
    return {r["cluster"]: (r["n"], [int(r[f"s{j}"]) for j in range(dims)]) for r in rows}


def first_centroids(vectors: DataFrame, id_col: str, vec_col: str, params: ClusterParams) -> np.ndarray:
    """The vectors whose seed and id have the smallest SHA-256, in that order."""
    scaled = F.transform(vec_col, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    bounded = F.transform(scaled, lambda x: F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    digest = F.sha2(F.concat(F.lit(params.seed), F.col(id_col).cast("string")), 256)
    chosen = vectors.where(finite(vec_col, params.dims) & F.col(id_col).isNotNull())
    rows = chosen.select(digest.alias("digest"), bounded.alias("v")).orderBy("digest", "v").limit(params.k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), params.dims)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", params: ClusterParams = ClusterParams()
) -> DataFrame:
    """One row per vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` (a list of integers).

    Each of the rounds takes every vector to the nearest centroid (of equal ones the smaller number) and moves every centroid
    that has vectors to the floor of their mean; then vectors are taken once more.
    """
    spark = vectors.sparkSession
    schema = f"{id_col} bigint, cluster int, distance bigint"
    centroids = first_centroids(vectors, id_col, vec_col, params)
    if not len(centroids):
        empty = f"{schema}, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        return spark.createDataFrame([], empty)
    chunks = written(encode(vectors, id_col, vec_col, params), "chunks")
    for _ in range(params.rounds):
        for c, (n, total) in _sums(chunks, centroids, params).items():
            centroids[c] = [t // n for t in total]
    block = params.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = distances(batch.column(1)[at].as_py(), batch.column(2)[at].as_py(), centroids, block)
                nearest = found.argmin(axis=1)
                least = found[np.arange(len(found)), nearest]
                ids = batch.column(0)[at].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(least)], [id_col, "cluster", "distance"])

    assigned = written(chunks.mapInArrow(run, schema), "assigned")
    drop_written(chunks)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    within = {r["cluster"]: int(r["s"]) for r in sums}  # one row a centroid
    told = [(c, within[c], sum(within.values()), centroids[c].tolist()) for c in within]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(column: str) -> Column:
    """SHA-256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.col(column).cast("array<string>"), ","), 256)
