"""Log-probabilities of texts under a smoothed n-gram model, walked as a weighted backoff automaton.

Tokens are words and one end per text. Unigrams are add-one estimates over all training tokens. Longer n-grams are kept from a small
count on, so their number grows with the corpus; they are smoothed by interpolated absolute discounting: an n-gram of count c after a
context of count C has (c - d) / C, and what the kept ones of a context leave is its backoff weight, by which the shorter context's probabilities count. All
counts are exact and cover all training texts.

The automaton has a state for each word and for each kept n-gram short of the order. An arc reads a word, adds the word's log-probability after the state's
context, and leads to the state of the longest suffix read. Where a state has no arc for a word, its failure arc adds the backoff weight and leads to the state of
the context without its first word, down to the root, which reads every word by its unigram. Texts are walked once, from left to right, carrying
the state; a state tells no more than the last words, so long texts are walked in stretches that begin a context's length earlier, all at once.

Neither words nor n-grams ever meet in one place. Texts are packed into blocks, where they lie, as word numbers, in a table in buckets by block, which
is never shuffled. What blocks ask goes to parts by ranges of hashes, and one answer comes back, in two rounds:

1. Which n-grams can occur often enough at all: blocks send the hashes' first bits, some four more than it takes to number all n-grams, as gaps; parts
   answer a bit for each. What does not pass occurs once.
2. Counts: the rest go by their context's hash with the block's counts, and with them all contexts of the block that passed, as other blocks may
   continue them. A part has all continuations of its contexts, so counts and backoff weights come from the same place.

N-grams are known by 64-bit hashes.

Defined cases: a null text is empty: one token, the end; a row without id belongs to the training rows; with nothing to
learn from, every token has probability one over one; repeated rows each get a row (and count each); texts of any length are walked whole; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.llm.common import as_bytes, written
from traffic_risk.session import scratch_dir, ship_package

END = b" "
"""The end of a text; no word has a blank. Also what stands before the first word."""
STRETCH = 512
"""Tokens of a walk."""
SPARE_BITS = 4
KEY_BYTES = 6
PART_KEYS = 4_000_000
"""N-grams that a part gets, about."""


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    least: int = 2
    """Least count of a kept n-gram."""
    share: float = 0.0
    """Share of all training tokens that a kept n-gram makes up at least; above 0 it bounds the model."""
    discount: float = 0.5
    block_bytes: int = 12 << 20
    """Text of a block; all its n-grams are in memory at once."""


def tokens(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    words.append(END)
    return words


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpack(data: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=dtype)
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), dtype=dtype)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as gaps, byte by byte: the first bytes of gaps are nearly all zero."""
    gaps = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    return _pack(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    planes = _unpack(data, 8 * n, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(n), dtype=np.uint64)


def _pack_planes(values: np.ndarray, size: int) -> bytes:
    """The last ``size`` bytes of numbers, byte by byte."""
    width = values.dtype.itemsize
    return _pack(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width)[:, :size].T))


def _unpack_planes(data: bytes, n: int, size: int, dtype) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), dtype=np.uint8)
    out[:, :size] = _unpack(data, size * n, np.uint8).reshape(size, n).T
    return out.view(dtype).reshape(n)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (Steele, Lea and Flood 2014), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# ------------------------------------------------------------------ blocks


BLOCK = "held array<boolean>, sizes array<bigint>, words binary, codes binary, n bigint, train bigint"


def packed(docs: DataFrame, id_col: str, text_col: str, held: Column, params: LmParams) -> DataFrame:
    """One row for each block of texts: ids, whether held out, tokens of each text, hashes of the different words and the words' numbers in them."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, flags = (pa.concat_arrays([r.column(k) for r in rows]) for k in (0, 1))
        words, codes, sizes = _numbered(pa.concat_arrays([r.column(2).cast(pa.large_string()) for r in rows]))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        learned = int((sizes - 1)[~flags.to_numpy(zero_copy_only=False)].sum())
        columns = [
            *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, flags, pa.array(sizes, pa.int64()))],
            pa.array([hashes.tobytes()]),
            pa.array([_pack_planes(codes, 4)]),
            pa.array([len(codes)], pa.int64()),
            pa.array([learned], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "held", "sizes", "words", "codes", "n", "train"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64))
            first = 0
            while first < batch.num_rows:
                full = int(np.searchsorted(ends[1:], params.block_bytes - size + ends[first])) + 1
                stop = min(max(full, first + 1), batch.num_rows)
                rows.append(batch.slice(first, stop - first))
                size += int(ends[stop] - ends[first])
                first = stop
                if size >= params.block_bytes:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    chosen = docs.select(F.col(id_col), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = chosen.mapInArrow(run, f"ids array<{kind}>, {BLOCK}").withColumn("block", F.monotonically_increasing_id())
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"blocks_{uuid.uuid4().hex}"
    writer = made.write.format("parquet").option("compression", "zstd").option("path", scratch_dir(spark, "blocks"))
    writer.bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def _numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different ``tokens`` of many texts, their numbers text after text, each led by an end, and how many each text has then.

    Words are found in the bytes of all texts at once; none is a Python object but the different ones.
    """
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = (data != ord(" ")) & (data - np.uint8(9) > 4)  # below 9 it wraps around
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = ends[(ends > 0) & (ends < len(data))]
    first[borders], last[borders - 1] = inside[borders], inside[borders - 1]
    starts = np.flatnonzero(first)
    word_ends = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts, dtype=np.int64))
    sizes = np.diff(np.searchsorted(starts, ends)) + 2
    spelled = data[inside]
    spelled |= (spelled - np.uint8(ord("A")) < 26).view(np.uint8) << np.uint8(5)
    buffers = [None, pa.py_buffer(word_ends), pa.py_buffer(spelled)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    stops = np.cumsum(sizes)
    codes, word = np.zeros(int(sizes.sum()), dtype=np.int32), np.ones(int(sizes.sum()), dtype=bool)
    word[stops - 1] = word[stops - sizes] = False
    codes[word] = words.indices.to_numpy() + 1
    return [END, *as_bytes(words.dictionary)], codes, sizes


def _order(values: np.ndarray) -> np.ndarray:
    """A stable order of 64-bit hashes: their first bits are sorted with the places in the last ones, which is faster than an order of numbers."""
    low = np.uint64(len(values).bit_length())
    mask = (np.uint64(1) << low) - np.uint64(1)
    held = values & ~mask
    held |= np.arange(len(values), dtype=np.uint64)
    held.sort()
    held &= mask
    by = held.view(np.int64)
    found = values[by]
    if (found[1:] < found[:-1]).any():  # hashes that differ in the last bits only
        by = by[np.argsort(found, kind="stable")]
    return by


class Keys:
    """Hashes of the n-grams that end at every place, by order less one; made when they are asked for, as each takes as much as the texts."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray):
        self.hashes, self.codes = hashes, codes

    def __getitem__(self, more: int) -> np.ndarray:
        words = self.hashes[self.codes]
        keys = words
        for _ in range(more):
            following = np.empty_like(words)
            following[:1], following[1:] = words[:1], keys[:-1]
            following *= np.uint64(0x9E3779B97F4A7C15)
            following += words
            keys = _mixed(following)
        return keys

    def at(self, more: int, places: np.ndarray) -> np.ndarray:
        """Those of some places, each of which has as many words before it."""
        keys = self.hashes[self.codes[places - more]]
        for k in range(more - 1, -1, -1):
            keys *= np.uint64(0x9E3779B97F4A7C15)
            keys += self.hashes[self.codes[places - k]]
            keys = _mixed(keys)
        return keys


class Grams:
    """All n-grams of a block's texts, which are led by an end that is no token of theirs."""

    def __init__(self, row: dict, order: int):
        self.codes = _unpack_planes(row["codes"], row["n"], 4, np.int32)
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.held = np.array(row["held"], dtype=bool)
        self.hashes = np.frombuffer(row["words"], dtype=np.uint64)
        self.at = np.arange(len(self.codes), dtype=np.int32)
        self.at -= np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
        self.keys = Keys(self.hashes, self.codes)
        self.train = ~np.repeat(self.held, self.sizes)

    def different(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted different n-grams of an order, a place where each ends, and their training counts."""
        ends = np.flatnonzero(self.at >= max(k - 1, 1)).astype(np.int32)
        if k == 1:  # words have numbers: only the different ones need an order
            where = np.full(len(self.hashes), -1, dtype=np.int32)
            where[self.codes[ends]] = ends
            counts = np.bincount(self.codes[ends], weights=self.train[ends], minlength=len(self.hashes)).astype(np.int64)
            by = np.argsort(self.hashes)
            by = by[where[by] >= 0]
            return self.hashes[by], where[by], counts[by]
        every = self.keys[k - 1][ends]
        by = _order(every)
        every = every[by]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else by
        counts = np.add.reduceat(self.train[ends][by], first, dtype=np.int64) if len(every) else by
        return every[first], ends[by[first]], counts


def _rows_of(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _cut(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each part begin, and their end; parts are equal ranges of the keys' first 32 bits."""
    marks = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_keys, marks), len(sorted_keys))


# ------------------------------------------------------------------ round 1: what can be frequent


ASKED1 = "block bigint, k int, part int, n bigint, wide boolean, gaps binary, seen binary"
TOLD1 = "block bigint, k int, part int, n bigint, passed binary"


def ask_frequent(blocks: DataFrame, parts: int, bits: int, params: LmParams) -> DataFrame:
    """For each block, order above one and part: the first ``bits`` of its n-grams' hashes as gaps, and 0, 1 or 2 (or more) training occurrences."""
    order = params.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                grams, out = Grams(row, order), []
                for k in range(2, order + 1):
                    keys, _, counts = grams.different(k)
                    slots, cuts = keys >> np.uint64(64 - bits), _cut(keys, parts)
                    for part in range(parts):
                        a, b = cuts[part], cuts[part + 1]
                        if a < b:
                            gaps = np.diff(slots[a:b], prepend=np.uint64(0))
                            wide = bool(gaps[1:].max(initial=0) > 0xFFFF)
                            told = np.concatenate((slots[a : a + 1], gaps[1:])).astype(np.uint64)
                            head, rest = told[:1], told[1:].astype(np.uint64 if wide else np.uint16)
                            out.append((row["block"], k, part, int(b - a), wide, head.tobytes() + _pack(rest), _pack(np.minimum(counts[a:b], 2).astype(np.uint8))))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "k", "part", "n", "wide", "gaps", "seen"])

    return blocks.mapInArrow(run, ASKED1)


def tell_frequent(asked: DataFrame, params: LmParams) -> DataFrame:
    """A bit for each n-gram asked about: whether the first bits occur often enough in all training texts."""
    least = min(params.least, 2)

    def run(table: pa.Table) -> pa.Table:
        rows, out = _rows_of(table), []
        for k in sorted({r["k"] for r in rows}):
            mine = [r for r in rows if r["k"] == k]
            slots = [
                np.cumsum(np.concatenate((np.frombuffer(r["gaps"][:8], np.uint64), _unpack(r["gaps"][8:], r["n"] - 1, np.uint64 if r["wide"] else np.uint16).astype(np.uint64))), dtype=np.uint64)
                for r in mine
            ]
            _, which = np.unique(np.concatenate(slots), return_inverse=True)
            seen = np.concatenate([_unpack(r["seen"], r["n"], np.uint8) for r in mine])
            passed = np.bincount(which, weights=seen)[which] >= least
            ends = np.cumsum([r["n"] for r in mine])
            out += [(r["block"], k, r["part"], r["n"], np.packbits(passed[e - r["n"] : e]).tobytes()) for r, e in zip(mine, ends.tolist(), strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "k", "part", "n", "passed"])

    return asked.groupBy("part").applyInArrow(run, TOLD1)


def _passed(grams: Grams, told: list[dict], k: int, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Context, hash, a place and training count of an order's n-grams that passed, by (context, hash)."""
    keys, where, counts = grams.different(k)
    if k == 1:
        return keys, keys, where, counts
    bits = [np.unpackbits(np.frombuffer(r["passed"], np.uint8), count=r["n"]) for r in sorted((r for r in told if r["k"] == k), key=lambda r: r["part"])]
    passed = np.flatnonzero(np.concatenate(bits)) if bits else np.zeros(0, np.int64)
    keys, where, counts = keys[passed], where[passed], counts[passed]
    context = grams.keys.at(k - 2, where - 1)
    by = _order(context)  # the hashes are in order
    context = context[by]
    if k > 2:  # one that is frequent has a frequent context; others passed by chance
        frequent = np.sort(before)
        good = frequent[np.minimum(np.searchsorted(frequent, context), len(frequent) - 1)] == context if len(frequent) else np.zeros(len(by), dtype=bool)
        context, by = context[good], by[good]
    return context, keys[by], where[by], counts[by]


def _passing(grams: Grams, told: list[dict], order: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``_passed`` order by order; only the hashes of the order below stay."""
    before = None
    for k in range(1, order + 1):
        found = [_passed(grams, told, k, before)]
        before = found[0][1]
        yield found.pop()


# ------------------------------------------------------------------ round 2: counts and backoff weights


ASKED2 = "block bigint, k int, part int, n bigint, m bigint, contexts binary, members binary, keys binary, counts binary"
TOLD2 = "block bigint, k int, part int, n bigint, m bigint, kept binary, counts binary, given binary, v bigint"


def _contexts(passing: list[tuple[np.ndarray, ...]], k: int) -> np.ndarray:
    """Sorted hashes of the contexts of order-``k`` n-grams: all that passed, as other blocks may hold their continuations."""
    return np.sort(passing[k - 2][1])


def ask_counts(blocks: DataFrame, told: DataFrame, parts: int, params: LmParams) -> DataFrame:
    """What passed, by context: each context's hash and number of n-grams, and these with the block's counts.

    The contexts of order two are the words, which go to the same parts as words.
    """
    order = params.order

    def run(texts: pa.Table, bits: pa.Table) -> pa.Table:
        out = []
        for row in _rows_of(texts):
            done = []
            for k, (context, keys, _, counts) in enumerate(_passing(Grams(row, order), _rows_of(bits), order), 1):
                cuts = _cut(context, parts)
                holders = _contexts(done, k) if k > 1 else context[:0]
                done.append((None, keys))
                members = np.diff(np.searchsorted(context, holders), append=len(context)).astype(np.uint32)
                bounds = _cut(holders, parts)
                for part in range(parts):
                    a, b, c, d = cuts[part], cuts[part + 1], bounds[part], bounds[part + 1]
                    if a < b or c < d:
                        spelled = _pack_sorted(holders[c:d]) if k > 2 else b""
                        # within its context an n-gram is told by 48 bits
                        members_of = _pack_planes(keys[a:b] >> np.uint64(16), KEY_BYTES) if k > 1 else _pack_sorted(keys[a:b])
                        out.append((row["block"], k, part, int(b - a), int(d - c), spelled, _pack(members[c:d]), members_of, _pack(counts[a:b].astype(np.uint32))))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)]
        return pa.Table.from_arrays(columns, ["block", "k", "part", "n", "m", "contexts", "members", "keys", "counts"])

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, ASKED2)


def tell_counts(asked: DataFrame, total: int, params: LmParams) -> DataFrame:
    """Counts over all blocks, which n-grams are kept, and how much of its count a context gives to kept ones (``given``)."""
    least = max(params.least, params.share * total)

    def run(table: pa.Table) -> pa.Table:
        rows, out, words = _rows_of(table), [], {}
        for k in sorted({r["k"] for r in rows}):
            mine = [r for r in rows if r["k"] == k]
            if k == 1:
                words = {r["block"]: _unpack_sorted(r["keys"], r["n"]) for r in mine}
                every = np.concatenate([words[r["block"]] for r in mine])
            else:
                contexts = [words[r["block"]] if k == 2 else _unpack_sorted(r["contexts"], r["m"]) for r in mine]
                owners = np.concatenate([np.repeat(c, _unpack(r["members"], r["m"], np.uint32)) for r, c in zip(mine, contexts, strict=True)])
                told = np.concatenate([_unpack_planes(r["keys"], r["n"], KEY_BYTES, np.uint64) for r in mine])
                every = _mixed(owners * np.uint64(0x9E3779B97F4A7C15) + told)
            different, first, which = np.unique(every, return_index=True, return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([_unpack(r["counts"], r["n"], np.uint32) for r in mine]), minlength=len(different)).astype(np.int64)
            ends = np.cumsum([r["n"] for r in mine]).tolist()
            if k == 1:
                v = int((counts > 0).sum())
                for i, (r, e) in enumerate(zip(mine, ends, strict=True)):
                    out.append((r["block"], k, r["part"], r["n"], 0, b"", _pack(counts[which[e - r["n"] : e]]), b"", v if i == 0 else 0))
                continue
            owner = owners[first]
            kept = counts >= least
            holders, of = np.unique(owner, return_inverse=True)
            given = np.bincount(of, weights=np.where(kept, counts - params.discount, 0.0), minlength=len(holders))
            for r, c, e in zip(mine, contexts, ends, strict=True):
                own = which[e - r["n"] : e]
                good = kept[own]
                at = np.minimum(np.searchsorted(holders, c), max(len(holders) - 1, 0))
                share = np.where(holders[at] == c, given[at], 0.0) if len(holders) else np.zeros(len(c))
                out.append((r["block"], k, r["part"], r["n"], r["m"], np.packbits(good).tobytes(), _pack(counts[own[good]]), _pack(share), 0))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        names = ["block", "k", "part", "n", "m", "kept", "counts", "given", "v"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return asked.groupBy("part").applyInArrow(run, TOLD2)


# ------------------------------------------------------------------ the automaton


@dataclass
class Automaton:
    """States: 0 the root, then the block's words, then the kept n-grams of two words, of three and so on short of the order."""

    arcs: np.ndarray
    """State and word of every arc but the root's, as one sorted number."""
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    """State a failure arc leads to."""
    fail_weight: np.ndarray
    root_weight: np.ndarray
    """Of the root's arc for each word."""
    root_target: np.ndarray
    """State that arc leads to."""

    def read(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and added log-probabilities of many walkers that read a word each."""
        states, added, out = states.copy(), np.zeros(len(states)), np.zeros(len(states), dtype=np.int64)
        todo = np.arange(len(states))
        while len(todo):
            now, word = states[todo], words[todo]
            root = now == 0
            if root.any():
                at_root, read = todo[root], word[root]
                added[at_root] += self.root_weight[read]
                out[at_root] = self.root_target[read]
                inner = ~root
                todo, now, word = todo[inner], now[inner], word[inner]
            if not len(self.arcs):
                arc = np.zeros(len(todo), dtype=bool)
            else:
                wanted = now * len(self.root_weight) + word
                at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
                arc = self.arcs[at] == wanted
                met, at = todo[arc], at[arc]
                added[met] += self.weight[at]
                out[met] = self.target[at]
            lost = ~arc
            todo, now = todo[lost], now[lost]
            added[todo] += self.fail_weight[now]
            states[todo] = self.fail[now]
        return out, added


def automaton(grams: Grams, passing: Iterable[tuple[np.ndarray, ...]], told: list[dict], n: int, v: int, params: LmParams) -> tuple[Automaton, np.ndarray]:
    """The automaton over a block's n-grams, and the training counts of its words."""
    order, words = params.order, len(grams.hashes)
    answers = {k: sorted((r for r in told if r["k"] == k), key=lambda r: r["part"]) for k in range(1, order + 1)}
    passing = iter(passing)
    _, keys, where = next(passing)[:3]
    counts = np.zeros(words, dtype=np.int64)
    counts[grams.codes[where]] = np.concatenate([_unpack(r["counts"], r["n"], np.int64) for r in answers[1]])
    root_weight = np.log(counts + 1) - math.log(n + v + 1)

    # probability, count and state of kept n-grams by (sorted) hash, order by order
    by_hash = np.argsort(keys)
    own = grams.codes[where][by_hash]
    known = keys[by_hash], np.exp(root_weight)[own], counts[own], 1 + own.astype(np.int64)
    states = 1 + words
    fail, fail_weight = [np.zeros(states, dtype=np.int32)], [np.zeros(states)]
    arcs, weight, target, done = [], [], [], []
    for k in range(2, order + 1):
        done.append((None, keys))
        holders = _contexts(done, k)
        context, keys, where = next(passing)[:3]
        if not answers[k]:
            break
        kept = np.concatenate([np.unpackbits(np.frombuffer(r["kept"], np.uint8), count=r["n"]) for r in answers[k]]).astype(bool)
        c = np.concatenate([_unpack(r["counts"], int(np.unpackbits(np.frombuffer(r["kept"], np.uint8), count=r["n"]).sum()), np.int64) for r in answers[k]])
        given = np.concatenate([_unpack(r["given"], r["m"], np.float64) for r in answers[k]])
        lower_keys, lower_p, lower_c, lower_state = known

        def find(wanted: np.ndarray, lower_keys=lower_keys) -> np.ndarray:
            """Places of hashes among the kept n-grams of the order below, -1 for others."""
            if not len(lower_keys):
                return np.full(len(wanted), -1)
            at = np.minimum(np.searchsorted(lower_keys, wanted), len(lower_keys) - 1)
            return np.where(lower_keys[at] == wanted, at, -1)

        # backoff weights of the contexts that have kept continuations
        held = np.flatnonzero(given > 0)
        at = find(holders[held])
        left = np.maximum(1.0 - given[held] / lower_c[at], 1e-12)
        every = np.concatenate(fail_weight)
        every[lower_state[at]] = np.log(left)
        fail_weight = [every]
        back = np.zeros(len(lower_keys))
        back[at] = left

        up = find(context[kept])
        passed, keys, where = keys, keys[kept], where[kept]
        suffix = find(grams.keys.at(k - 2, where))
        p = (c - params.discount) / lower_c[up] + back[up] * lower_p[suffix]
        if k < order:
            own = states + np.arange(len(keys))
            fail.append(lower_state[suffix].astype(np.int32))
            fail_weight.append(np.zeros(len(keys)))
            states += len(keys)
        else:
            own = lower_state[suffix]
        # states are numbered order by order, so the arcs of an order come after those of the orders below
        mine = lower_state[up] * words + grams.codes[where]
        by = np.argsort(mine, kind="stable")
        arcs.append(mine[by])
        weight.append(np.log(p)[by])
        target.append(own[by].astype(np.int32))
        del up, suffix, mine, by, context, where, kept, back, given
        if k < order:
            by_hash = np.argsort(keys)
            known = keys[by_hash], p[by_hash], c[by_hash], own[by_hash]
        keys = passed
    arcs = np.concatenate(arcs) if arcs else np.zeros(0, dtype=np.int64)
    weight = np.concatenate(weight) if weight else np.zeros(0)
    target = np.concatenate(target) if target else np.zeros(0, dtype=np.int32)
    fail, fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
    # a state without arcs whose failure arc adds nothing is never stopped at
    idle = fail_weight == 0
    idle[arcs // words] = False
    to = np.where(idle, fail, np.arange(len(fail), dtype=np.int32))
    for _ in range(order - 2):
        to = to[to]
    return Automaton(arcs, weight, to[target], to[fail], fail_weight, root_weight, to[1 : 1 + words]), counts


def walk(grams: Grams, machine: Automaton, order: int) -> np.ndarray:
    """The log-probability that each place of the texts adds, 0 at the leading ends."""
    lead = np.cumsum(grams.sizes) - grams.sizes
    cuts = [np.arange(1, s, STRETCH) for s in grams.sizes.tolist()]
    text = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    first = np.concatenate(cuts) if cuts else np.zeros(0, dtype=np.int64)
    last = np.minimum(first + STRETCH, grams.sizes[text])
    # a stretch begins at the text's leading end, or with the words that its first state can tell
    begin = np.maximum(first - max(order - 1, 1), 0)
    added = np.zeros(len(grams.codes))
    at, states = lead[text] + begin, np.zeros(len(first), dtype=np.int64)
    stop, count_from = lead[text] + last, lead[text] + first
    active = np.arange(len(first))
    while len(active):
        place = at[active]
        word = grams.codes[place]
        states[active], more = machine.read(states[active], word)
        counted = place >= count_from[active]
        added[place[counted]] = more[counted]
        at[active] = place + 1
        active = active[at[active] < stop[active]]
    return added


def score_texts(
    docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", params: LmParams = LmParams()
) -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows for which ``held`` is true are scored but not learned from.
    """
    spark, order = docs.sparkSession, params.order
    blocks = packed(docs, id_col, text_col, held, params)
    facts = blocks.agg(F.sum("n").alias("n"), F.sum("train").alias("train")).first()
    size, n = facts["n"] or 0, facts["train"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * max(order - 1, 1) / PART_KEYS))
    bits = min(60, max(32, math.ceil(math.log2(max(size * order, 2))) + SPARE_BITS))
    told1 = written(tell_frequent(ask_frequent(blocks, parts, bits, params), params), "frequent")
    told2 = written(tell_counts(ask_counts(blocks, told1, parts, params), n, params), "counts")
    v = told2.agg(F.sum("v")).first()[0] or 0
    id_type = docs.schema[id_col].dataType
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    none = {c: F.lit(None).cast(t) for c, t in (("m", "bigint"), ("kept", "binary"), ("counts", "binary"), ("given", "binary"), ("v", "bigint"))}
    told = told1.withColumns(none).unionByName(told2.withColumn("passed", F.lit(None).cast("binary")))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        rows = _rows_of(answers)
        for at, row in enumerate(_rows_of(texts.drop_columns(["ids"]))):
            grams = Grams(row, order)
            first = [r for r in rows if r["passed"] is not None]
            machine, counts = automaton(grams, _passing(grams, first, order), [r for r in rows if r["passed"] is None], n, v, params)
            added = walk(grams, machine, order)
            text = np.repeat(np.arange(len(grams.sizes)), grams.sizes)
            model = np.bincount(text, weights=added, minlength=len(grams.sizes))
            del added
            lead = grams.at == 0
            known = np.bincount(text, weights=(counts > 0)[grams.codes] & ~lead, minlength=len(grams.sizes)).astype(np.int64)
            base = machine.root_weight[grams.codes]
            base[lead] = 0.0
            plain = np.bincount(text, weights=base, minlength=len(grams.sizes))
            columns = [grams.held, grams.sizes - 1, known, np.full(len(grams.sizes), n, dtype=np.int64), plain / math.log(10), model / math.log(10)]
            ids = texts.column("ids").slice(at, 1).combine_chunks()
            ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
            out.append(pa.Table.from_arrays([ids, *map(pa.array, columns)], names))
        return pa.concat_tables(out) if out else pa.table({c: [] for c in names})

    schema = f"{id_col} {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)
