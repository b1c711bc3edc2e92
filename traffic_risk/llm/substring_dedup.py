"""Byte strings of a fixed length that occur more than once in a corpus, and the texts without them.

Every string of ``length`` bytes is assigned to one anchor: of the ``GRAM``-byte grams inside it, the one of smallest
hash, the leftmost of equals. Equal strings have equal anchors at equal places, so they meet in the same
group. The strings of one anchor occurrence are neighbours and make up one segment of the text.

1. Segments are counted by anchor and content. Where a segment occurs more than once, all of its strings
   do; copies of documents and passages end here, whatever their number, without their bytes being moved.
2. Anchors with one segment are done: nothing else can hold its strings. For anchors with several different ones, one
   occurrence of each is cut from the texts and sent to the anchor's task, which sorts them by a suffix array
   (``suffixes``) and finds the strings that occur twice.
3. A group of more than ``most`` different segments is never sorted as a whole. Its strings are split by their distance
   from the anchor into ranges; the strings of a range share a core of bytes, which becomes part of the key; then the
   group is counted again as in 1. Ranges shrink until groups fit; at width one the core is the string itself.

The results are ranges of string starts by document; together they cover what is removed.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; exact repeats of a row, id
included, are copies of each other; rows with a null or equal id but other texts are told apart; an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traffic_risk.functions.skew import attach
from traffic_risk.llm.common import written
from traffic_risk.llm.suffixes import repeated_starts
from traffic_risk.session import ship_package

GRAM = 32
PLACE_BITS = 20
FLUSH = 1 << 20
"""Bytes of segments that are sorted together."""
WIDTHS = (96, 32, 8, 1)
"""Ranges of distances from the anchor that hot groups are split by, one after the other."""
ANCHOR = "doc bigint, anchor bigint, content bigint, gram int, start int, n int"
PIECE = f"{ANCHOR}, copies bigint, data binary"
SEGMENT = "doc bigint, anchor bigint, gram int, start int, n int, copies bigint, data binary, m bigint"


@dataclass(frozen=True)
class DedupParams:
    length: int = 400
    most: int = 4096
    """Different segments that a task sorts at once for one key."""


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes that begin at every place."""
    table = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)
    out, span, factor = table[data], 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        out = out[:-span] * np.uint64(factor) + out[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def anchors_of(text: bytes, length: int) -> list[tuple[np.ndarray, ...]]:
    """Segments as arrays: anchor hash, content hash, place of the anchor, first start, number of starts.

    Long texts come in several parts; the strings at a seam are in one of them each.
    """
    out = []
    step = (1 << PLACE_BITS) - length
    for first in range(0, len(text) - length + 1, step):
        part = np.frombuffer(text, dtype=np.uint8, count=min(step + length - 1, len(text) - first), offset=first)
        hashes = _gram_hashes(part)
        low = np.uint64((1 << PLACE_BITS) - 1)
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        grams = length - GRAM + 1
        least, span = keyed, 1
        while 2 * span <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < grams:
            least = np.minimum(least[: len(keyed) - grams + 1], least[grams - span :])
        place = (least & low).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sizes = np.diff(np.append(cuts, len(place)))
        places = place[cuts]
        digest = xxhash.xxh64_intdigest
        contents = [
            digest(text[first + a : first + a + n + length - 1], p - a)
            for a, n, p in zip(cuts.tolist(), sizes.tolist(), places.tolist(), strict=True)
        ]
        out.append((hashes[places].view(np.int64), np.array(contents, dtype=np.uint64).view(np.int64), places + first, cuts + first, sizes))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc``, a 64-bit name of id and text, and ``text`` as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.xxhash64(F.col(id_col), text)
    return docs.select(doc.alias("doc"), F.col(id_col).alias("id"), text.cast("binary").alias("text"))


def find_anchors(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for anchor, content, gram, start, n in anchors_of(text, length) if len(text) >= length else ():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(n), doc, dtype=np.int64)),
                            pa.array(anchor),
                            pa.array(content),
                            *[pa.array(c.astype(np.int32)) for c in (gram, start, n)],
                        ],
                        ["doc", "anchor", "content", "gram", "start", "n"],
                    )

    def joined(batches):
        """One batch per MB or so; a batch per text would be slow to read."""
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 15:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return texts.select("doc", "text").mapInArrow(joined, ANCHOR)


def _different(rows: DataFrame, *more: str) -> DataFrame:
    """One row per anchor and content: how often it occurs (``copies``) and where it occurs first."""
    first = F.min(F.struct("doc", "gram", "start", "n", *more)).alias("first")
    return rows.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), first).select(
        "anchor", "content", "copies", "first.*"
    )


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments."""
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "gram", "start", "n", "copies", "m")).alias("wanted"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    data = text[w["start"] : w["start"] + w["n"] + length - 1]
                    rows.append((doc, w["anchor"], w["gram"], w["start"], w["n"], w["copies"], data, w["m"]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            names = ["doc", "anchor", "gram", "start", "n", "copies", "data", "m"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

    # a repeated row gives its segments twice; all of them have copies, and are only compared with
    return texts.select("doc", "text").join(by_doc, "doc").mapInArrow(run, SEGMENT)


def _sorted_ranges(segments: DataFrame, length: int) -> DataFrame:
    """Ranges of starts that occur twice, of segments that occur once; groups stay together."""

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= FLUSH and row[1] != last:
                    yield ranges(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
                last = row[1]
        if held:
            yield ranges(held)

    def ranges(rows: list) -> pa.RecordBatch:
        found = repeated_starts([(data, gram - start, n) for _, _, gram, start, n, _, data in rows], length)
        docs, starts, stops = [], [], []
        for (doc, _, _, start, _, copies, _), hits in zip(rows, found, strict=True):
            if copies == 1 and hits.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hits.astype(np.int8), [0]))))
                docs += [doc] * (len(edges) // 2)
                starts += (start + edges[::2]).tolist()
                stops += (start + edges[1::2]).tolist()
        kinds = (pa.int64(), pa.int32(), pa.int32())
        columns = [pa.array(c, k) for c, k in zip((docs, starts, stops), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "start", "stop"])

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc bigint, start int, stop int")


def _split(segments: DataFrame, width: int, length: int) -> DataFrame:
    """Segments of hot groups by ranges of ``width`` distances from the anchor; the bytes that all strings of a range share join the key."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            rows = []
            for doc, anchor, gram, start, n, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                far = gram - start  # distance of the first start; the last one's is far - n + 1
                for part in range((far - n + 1) // width, far // width + 1):
                    near, last = part * width, part * width + width - 1
                    core = data[far - near : far - last + length]
                    key = digest(core, digest(f"{anchor} {width} {part}"))
                    a, b = max(far - n + 1, near), min(far, last)
                    piece = data[far - b : far - a + length]
                    rows.append((doc, key, digest(piece, b), gram, gram - b, b - a + 1, copies, piece))
            names = ["doc", "anchor", "content", "gram", "start", "n", "copies", "data"]
            kinds = (pa.int64(), None, None, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            columns = [
                pa.array(np.array(c, dtype=np.uint64).view(np.int64)) if kind is None else pa.array(c, kind)
                for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return segments.mapInArrow(run, PIECE)


def _whole(rows: DataFrame, different: DataFrame) -> DataFrame:
    """Ranges of segments that occur more than once."""
    repeated = different.where("copies > 1").select("anchor", "content")
    found = attach(rows, repeated.withColumn("found", F.lit(True)), ["anchor", "content"], ["doc", "start"], how="inner")
    return found.select("doc", "start", (F.col("start") + F.col("n")).alias("stop"))


def _mixed(different: DataFrame) -> DataFrame:
    """Segments of anchors with several different ones, and how many those are (``m``)."""
    groups = different.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    return attach(different, groups, ["anchor"], ["content"], how="inner")


def repeated_ranges(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: DedupParams = DedupParams()
) -> DataFrame:
    """``doc``, ``start``, ``stop``: starts of strings that begin elsewhere, too; ``doc`` names id and text."""
    ship_package(docs.sparkSession)
    length = params.length
    texts = _texts(docs, id_col, text_col)
    anchors = written(find_anchors(texts, length), "anchors").withColumn("copies", F.lit(1).cast("bigint"))
    different = written(_different(anchors), "segments")
    ranges = _whole(anchors, different)
    segments = written(_cut(texts, _mixed(different), length), "mixed")
    for width in (*WIDTHS, None):
        small = segments.where(F.col("m") <= params.most).drop("m")
        ranges = ranges.unionByName(_sorted_ranges(small, length))
        hot = segments.where(F.col("m") > params.most).drop("m")
        if width is None or hot.isEmpty():
            return ranges
        pieces = written(_split(hot, width, length), "pieces")
        different = _different(pieces, "data")
        ranges = ranges.unionByName(_whole(pieces, different))
        segments = written(_mixed(different).drop("content").select(*segments.columns), "mixed")


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: DedupParams = DedupParams()
) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (the remaining bytes)."""
    length = params.length
    found = written(repeated_ranges(docs, id_col, text_col, params).distinct(), "ranges")
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    texts = _texts(docs, id_col, text_col).join(by_doc, "doc", "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ranges = batch.column(2)
            offsets, flat = ranges.offsets.to_numpy(), ranges.values
            starts, stops = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = slice(offsets[k], offsets[k + 1])
                rows.append(cut_out(text, starts[own], stops[own] + (length - 1)))
            sizes, removed, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)],
                    pa.array([hashlib.sha256(t).hexdigest() for t in kept]),
                    pa.array(kept, pa.binary()),
                ],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    chosen = texts.select("id", "text", F.coalesce("ranges", none).alias("ranges"))
    schema = f"{id_col} {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return chosen.mapInArrow(run, schema)


def cut_out(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, int, bytes]:
    """Length, bytes in any of the ranges, number of runs they make up, and the rest of the text."""
    if not len(starts):
        return len(text), 0, 0, text
    depth = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    inside = np.cumsum(depth[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(np.concatenate(([0], inside.astype(np.int8)))) == 1))
    kept = np.frombuffer(text, dtype=np.uint8)[~inside].tobytes()
    return len(text), len(text) - len(kept), spans, kept
