"""Hard negatives: rows of another label whose score lies in a window below that of an anchor's positives.

The score is the exact inner product of vectors of integers. Rows lie in the exact leaves of a ``SplitTree`` whose split points come from a bounded
sample of ``SAMPLE`` rows; every row is in a leaf. Leaves are written as blocks of at most ``BLOCK`` rows in the shared folder, with the block's
own distance ranges; anchors, a set that grows with the input, are blocks, too. A block of anchors goes to the leaves it cannot eliminate, by an equi-join
on the leaf, and a task multiplies two blocks at a time. Rows are dealt by range of (leaf, row), so a leaf or a vector with a third of all rows is many
blocks in many tasks; no task holds a whole leaf.

First the positives are searched: at least as many rows of the anchor's label in the sample bound the score from below, which is the radius to start
with. Then the windows of an anchor's positives make one annulus, again tightened by the sample. The best rows of each pair of blocks are ranked by a window
that cuts each task's part before the shuffle.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; missing components of shorter vectors are 0;
whole components beyond 2^26 count as 2^26, with their sign; a row without id is last among equal scores; rows of one id
are rows of their own, a copy of an anchor's row can be its positive, and equal score and id are ranked by a row number; windows of negative
scores are empty, that of score 0 holds score 0; an anchor without positives gives no row; an empty table gives an empty result; only the three columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traffic_risk.functions.skew import attach
from traffic_risk.llm.common import drop_written, written
from traffic_risk.llm.split_tree import FAN, SplitTree, grow, products
from traffic_risk.llm.vectors import LIMIT, SCALE, finite
from traffic_risk.session import ship_package

SAMPLE = 2048
"""Rows that split points are taken from and first bounds are found in."""
BLOCK = 1024
"""Rows of a block of a leaf."""
ANCHORS = 256
"""Anchors of a block."""
NO_ID = (1 << 63) - 1
"""Stands for a missing id where ids are ordered."""
OUTPUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
LONGS = pa.list_(pa.int64())


@dataclass(frozen=True)
class MiningParams:
    positives: int = 5
    negatives: int = 10
    low: int = 30
    """Least score of a negative, in hundredths of the positive's score."""
    high: int = 90
    """Largest one."""


@dataclass
class _Search:
    """What tasks get: the tree and the sample, both of bounded size."""

    tree: SplitTree
    dims: int
    vectors: np.ndarray
    labels: np.ndarray
    rids: np.ndarray


@dataclass
class _Anchors:
    rids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    more: list
    """For each anchor its positives as (score, id), best first; empty in the first search."""


def _rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column) -> DataFrame:
    scaled = F.transform(vec_col, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    whole = F.transform(scaled, lambda x: F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.where(finite(vec_col) & F.col(label_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("rid"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        whole.alias("v"),
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def _prepare(rows: DataFrame) -> _Search | None:
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    facts = rows.agg(F.max(F.size("v")).alias("dims"), F.max(size).alias("top"), F.count("*").alias("n")).first()
    if facts["dims"] is None:
        return None
    dims = max(1, facts["dims"])
    # a share of about four samples first: tasks then send few rows, whatever their number
    place = F.pmod(F.xxhash64("rid"), F.lit(1 << 60))
    share = rows.where(place < int(min(1.0, 4 * SAMPLE / facts["n"]) * (1 << 60)))
    drawn = share.orderBy(place, "rid").limit(SAMPLE).select("rid", "label", "v").toArrow().combine_chunks()
    vectors = np.concatenate([_matrix(c, dims) for c in drawn.column("v").chunks])
    tree = grow(vectors, facts["top"])
    return _Search(tree, dims, vectors.astype(np.int32), drawn.column("label").to_numpy(), drawn.column("rid").to_numpy())


def _with_leaf(rows: DataFrame, search: _Search) -> DataFrame:
    tree, dims = search.tree, search.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = tree.cells(_matrix(batch.column(3), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[4:])
    return rows.mapInArrow(run, f"rid bigint, id bigint, label bigint, v array<int>{more}, leaf int")


def _runs(batches: Iterator[pa.RecordBatch], most: int, split: bool) -> Iterator[pa.Table]:
    """Consecutive rows, at most ``most``, of one leaf each if ``split``."""
    held: list[pa.RecordBatch] = []

    def full() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    n, last = 0, None
    for batch in batches:
        leaf = batch.column(batch.schema.get_field_index("leaf")).to_numpy()
        cuts = np.flatnonzero(np.diff(leaf)) + 1 if split else np.zeros(0, dtype=np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaf)], strict=True):
            if b > a and held and split and leaf[a] != last:
                yield full()
                held, n = [], 0
            while a < b:
                take = min(b - a, most - n)
                held.append(batch.slice(a, take))
                a, n, last = a + take, n + take, leaf[b - 1]
                if n == most:
                    yield full()
                    held, n = [], 0
    if held:
        yield full()


def _leaf_blocks(rows: DataFrame, search: _Search) -> DataFrame:
    """The rows of every leaf in blocks, with the least and largest distances to the split points."""
    tree, dims = search.tree, search.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, BLOCK, True):
            vectors = np.concatenate([_matrix(c, dims) for c in part.column("v").chunks])
            _, told = tree.cells(vectors)
            low, high = told.min(axis=0), told.max(axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("leaf")[0].as_py()], pa.int32()),
                    *[pa.array([part.column(c).to_pylist()], LONGS) for c in ("rid", "id", "label")],
                    pa.array([vectors.astype(np.int32).tobytes()]),
                    *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in (low, high)],
                ],
                ["leaf", "rids", "ids", "labels", "vectors", "low", "high"],
            )

    dealt = rows.repartitionByRange("leaf", "rid").sortWithinPartitions("leaf", "rid")
    lists = "rids array<bigint>, ids array<bigint>, labels array<bigint>, vectors binary, low array<double>, high array<double>"
    return dealt.mapInArrow(run, f"leaf int, {lists}")


def _set_ranges(blocks: DataFrame, tree: SplitTree) -> None:
    """Ranges of every cell, from its blocks: at most one row for each of the 256 cells."""
    lows = [F.min(F.get("low", F.lit(i))).alias(f"l{i}") for i in range(2 * FAN)]
    highs = [F.max(F.get("high", F.lit(i))).alias(f"h{i}") for i in range(2 * FAN)]
    tree.low, tree.high = np.full((FAN * FAN, 2 * FAN), np.nan), np.full((FAN * FAN, 2 * FAN), np.nan)
    for r in blocks.groupBy("leaf").agg(*lows, *highs).collect():
        tree.low[r["leaf"]] = [r[f"l{i}"] for i in range(2 * FAN)]
        tree.high[r["leaf"]] = [r[f"h{i}"] for i in range(2 * FAN)]


def _route(anchors: DataFrame, search: _Search, aim: Callable) -> DataFrame:
    """Blocks of anchors, once for each leaf that is open for any of them; ``aim`` gives each anchor's least and largest scores."""
    dims, tree = search.dims, search.tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ANCHORS, False):
            vectors = np.concatenate([_matrix(c, dims) for c in part.column("v").chunks])
            more = part.column("positives").to_pylist() if "positives" in part.column_names else [[] for _ in range(len(vectors))]
            more = [[(p["score"], p["id"]) for p in ps] for ps in more]
            rids, ids, labels = (part.column(c).to_numpy() for c in ("rid", "id", "label"))
            least, most = aim(_Anchors(rids, ids, labels, vectors, more), search)
            for leaf in tree.open_cells(vectors, tree.radius(vectors, most[:, None])[:, 0], tree.radius(vectors, least[:, None])[:, 0]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([leaf], pa.int32()),
                        *[pa.array([x.tolist()], LONGS) for x in (rids, ids, labels, least.astype(np.int64), most.astype(np.int64))],
                        pa.array([vectors.astype(np.int32).tobytes()]),
                        *[pa.array([[[p[k] for p in ps] for ps in more]], pa.list_(LONGS)) for k in (0, 1)],
                    ],
                    ["leaf", "a_rids", "a_ids", "a_labels", "a_least", "a_most", "a_vectors", "a_scores", "a_positives"],
                )

    lists = ", ".join(f"a_{c} array<bigint>" for c in ("rids", "ids", "labels", "least", "most"))
    schema = f"leaf int, {lists}, a_vectors binary, a_scores array<array<bigint>>, a_positives array<array<bigint>>"
    dealt = anchors.repartitionByRange("leaf", "rid").sortWithinPartitions("leaf", "rid")
    return dealt.mapInArrow(run, schema)


def _search(routed: DataFrame, blocks: DataFrame, search: _Search, pick: Callable, names: list[str]) -> DataFrame:
    """``pick`` on every pair of a block of anchors and a block of an open leaf, without the anchors the block is out of reach for."""
    dims, tree = search.dims, search.tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                vectors = np.frombuffer(r["a_vectors"], dtype=np.int32).reshape(-1, dims)
                least, most = np.array(r["a_least"]), np.array(r["a_most"])
                reach = tree.reach(vectors, r["leaf"] // FAN)
                low, high = (np.array(r[c], dtype=np.float64) for c in ("low", "high"))
                inner, outer = (tree.radius(vectors, x[:, None])[:, 0] for x in (most, least))
                near = np.flatnonzero(tree.open(reach, low, high, inner, outer))
                if not len(near):
                    continue
                more = [list(zip(r["a_scores"][i], r["a_positives"][i], strict=True)) for i in near]
                anchors = _Anchors(np.array(r["a_rids"])[near], np.array(r["a_ids"])[near], np.array(r["a_labels"])[near], vectors[near], more)
                rids, ids, labels = (np.array(r[c]) for c in ("rids", "ids", "labels"))
                scores = products(anchors.vectors, np.frombuffer(r["vectors"], dtype=np.int32).reshape(-1, dims))
                found = pick(anchors, scores, rids, ids, labels, least[near])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    # merged by key: the routed side is far larger than the anchors it is made of, from which a broadcast would be decided
    both = routed.join(blocks.hint("merge"), "leaf")
    return both.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _first(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the places ``which`` by falling score, id and row number."""
    if len(which) > k:
        held = scores[which]
        which = which[held >= np.partition(held, len(held) - k)[len(held) - k]]
    return which[np.lexsort((rids[which], ids[which], -scores[which]))[:k]]


def _window(score: int, params: MiningParams) -> tuple[int, int]:
    return -((-params.low * score) // 100), params.high * score // 100


def _kth(scores: np.ndarray, which: np.ndarray, k: int) -> int | None:
    return int(np.partition(scores[which], len(which) - k)[len(which) - k]) if len(which) >= k else None


def mine(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    params: MiningParams = MiningParams(),
) -> DataFrame:
    """Rows of ``OUTPUT``: for each anchor row and each of its positives the first negatives in the window, ranked from 1.

    ``anchor`` tells which rows are anchors. An anchor's positives are its first other rows of the same label by falling score, ties by smaller id; negatives
    have another label and a score of ``low`` to ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = written(_rows(vectors, id_col, vec_col, label_col, anchor), "rows")
    search = _prepare(rows)
    if search is None:
        drop_written(rows)
        return spark.createDataFrame([], OUTPUT)
    blocks = written(_leaf_blocks(_with_leaf(rows.select("rid", "id", "label", "v"), search), search), "leaves")
    _set_ranges(blocks, search.tree)
    anchors = _with_leaf(rows.where("anchor").select("rid", "id", "label", "v"), search)

    def aim_positives(block: _Anchors, s: _Search) -> tuple[np.ndarray, np.ndarray]:
        scores = products(block.vectors, s.vectors)
        top = np.sqrt((block.vectors.astype(np.float64) ** 2).sum(axis=1) * s.tree.top)
        least, most = -np.ceil(top) - 1, np.ceil(top) + 1
        for i, (rid, label) in enumerate(zip(block.rids, block.labels, strict=True)):
            kth = _kth(scores[i], np.flatnonzero((s.labels == label) & (s.rids != rid)), params.positives)
            least[i] = least[i] if kth is None else kth
        return least, most

    def pick_positives(block: _Anchors, scores: np.ndarray, rids, ids, labels, least) -> list[tuple]:
        found = []
        for i, (rid, label) in enumerate(zip(block.rids, block.labels, strict=True)):
            which = np.flatnonzero((labels == label) & (rids != rid) & (scores[i] >= least[i]))
            found += [(int(rid), int(scores[i, j]), int(ids[j]), int(rids[j])) for j in _first(scores[i], ids, rids, which, params.positives)]
        return found

    met = _search(_route(anchors, search, aim_positives), blocks, search, pick_positives, ["a_rid", "score", "id", "rid"])
    by_anchor = Window.partitionBy("a_rid").orderBy(F.desc("score"), "id", "rid")
    best = met.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= params.positives)
    listed = best.groupBy("a_rid").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("p"))
    pairs = written(listed.select(F.col("a_rid").alias("rid"), F.transform("p", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives")), "positives")

    def windows(block: _Anchors, scores: np.ndarray, labels: np.ndarray, i: int) -> Iterator[tuple]:
        for place, (score, positive) in enumerate(block.more[i]):
            low, high = _window(score, params)
            if low <= high:
                inside = np.flatnonzero((labels != block.labels[i]) & (scores[i] >= low) & (scores[i] <= high))
                yield place, score, positive, low, high, inside

    def aim_negatives(block: _Anchors, s: _Search) -> tuple[np.ndarray, np.ndarray]:
        scores = products(block.vectors, s.vectors)
        least, most = np.full(len(block.rids), float(1 << 61)), np.full(len(block.rids), -float(1 << 61))
        for i in range(len(block.rids)):
            for _, _, _, low, high, inside in windows(block, scores, s.labels, i):
                kth = _kth(scores[i], inside, params.negatives)
                least[i], most[i] = min(least[i], low if kth is None else kth), max(most[i], high)
        return least, most

    def pick_negatives(block: _Anchors, scores: np.ndarray, rids, ids, labels, least) -> list[tuple]:
        found = []
        for i, (rid, anchor_id) in enumerate(zip(block.rids, block.ids, strict=True)):
            for place, score, positive, _, _, inside in windows(block, scores, labels, i):
                inside = inside[scores[i, inside] >= least[i]]
                for j in _first(scores[i], ids, rids, inside, params.negatives):
                    found.append((int(rid), place, int(anchor_id), positive, score, int(scores[i, j]), int(ids[j]), int(rids[j])))
        return found

    aimed = attach(rows.where("anchor").select("rid", "id", "label", "v"), pairs, ["rid"], ["rid"], how="inner")
    names = ["a_rid", "place", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id", "rid"]
    met = _search(_route(_with_leaf(aimed, search), search, aim_negatives), blocks, search, pick_negatives, names)
    by_pair = Window.partitionBy("a_rid", "place").orderBy(F.desc("negative_score"), "negative_id", "rid")
    ranked = met.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= params.negatives)
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return ranked.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
