"""Near-duplicate texts by SimHash fingerprints and multi-index hashing.

Charikar: Similarity estimation techniques from rounding algorithms (2002); Norouzi, Punjani and
Fleet: Fast exact search in Hamming space with multi-index hashing (2014).

A fingerprint has two segments of 32 bits, each with a table from the segment's value to fingerprints. Two fingerprints that differ in at
most two bits either differ in at most one bit of the first segment, or in none of the second. So the ball of radius one around
the first segment's value (33 values) and the second segment's value alone are looked up, and complete distances of what is
found are verified.

A value that is shared by many fingerprints would make candidates by the square of their number. A table's entry lists at most ``SHARED``
fingerprints; fingerprints that look up a fuller one are searched by the ball of radius one around the whole fingerprint instead, on both
sides: each of two fingerprints turns one of the differing bits. Such a whole value is reached by at most 65
fingerprints, however many share a segment, and linking all of them to the smallest keeps every component.

Defined cases: a null text is empty; a text without words has fingerprint zero; fewer words than a
shingle make one shingle; repeated rows each get a row; a null id never becomes a component's
name while its component has another id; an empty table gives an empty result; texts of any length are hashed whole, some
100,000 shingles at a time; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from traffic_risk.functions.skew import attach
from traffic_risk.llm.common import fresh, map_texts, written
from traffic_risk.llm.components import components

SEGMENT = 32
"""Bits of a segment."""
SHARED = 64
"""Fingerprints that an entry of a segment's table lists; fuller ones are searched by whole fingerprints."""
DISTANCE = 2
CHUNK = 1 << 17
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = text.lower().split()  # on bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    ends = ends[size - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        a, b = starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist()
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], dtype="<u8")
        for k, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            ones[8 * k : 8 * k + 8] += np.bincount(column, minlength=256) @ _BITS
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fp`` (64 bits as a signed long) of every row."""

    def run(keys: pa.RecordBatch, texts: list) -> list:
        found = [fingerprint(t.encode("utf-8", "surrogatepass"), shingle, seed) for t in texts]
        return [keys.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col], text_col, run, f"{id_col} {kind}, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """Links ``fp``, ``hub`` between different fingerprints of at most two differing bits that keep all components."""
    mask = F.lit((1 << SEGMENT) - 1)
    first, second = F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", SEGMENT)
    near = [first, *[first.bitwiseXOR(F.lit(1 << i)) for i in range(SEGMENT)]]

    def entry(number: int, value: Column) -> Column:
        return F.struct(F.lit(number).alias("segment"), value.alias("value"))

    fps = distinct.select("fp")
    table = fps.select("fp", F.inline(F.array(entry(0, first), entry(1, second))))
    place = F.row_number().over(Window.partitionBy("segment", "value").orderBy("fp"))
    listed = table.withColumn("place", place).where(F.col("place") <= SHARED + 1)
    entries = listed.groupBy("segment", "value").agg(F.collect_list("fp").alias("members"))
    entries = entries.where(F.size("members") > 0)
    asked = fps.select("fp", F.inline(F.array(*[entry(0, v) for v in near], entry(1, second))))
    found = written(attach(asked, entries, ["segment", "value"], ["fp"], how="inner").where("size(members) > 1 OR members[0] <> fp"), "found")

    full = F.size("members") > SHARED
    pairs = found.where(~full).select("fp", F.explode("members").alias("hub")).where(_near("fp", "hub"))
    crowded = found.where(full).select("fp").distinct()
    return pairs.unionByName(ball_links(crowded)).distinct()


def ball_links(fps: DataFrame) -> DataFrame:
    """The links among these fingerprints by the ball of radius one around each of them."""
    turned = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]]
    reached = fps.select("fp", F.explode(F.array(*turned)).alias("value"))
    hub = F.min("fp").over(Window.partitionBy("value"))
    return reached.select("fp", hub.alias("hub")).where(_near("fp", "hub"))


def _near(a: str, b: str) -> Column:
    return (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE)


def roots(distinct: DataFrame) -> DataFrame:
    """``fp`` and ``root``, the smallest fingerprint reachable by links, of every fingerprint."""
    stars = components(links(distinct), "fp", "hub")
    return distinct.select("fp").join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` and ``component_id``, the smallest id reachable by links."""
    marked = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    rooted = distinct.join(roots(distinct), "fp")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = attach(rooted, names, ["root"], ["fp"], how="inner").select("fp", "component_id")
    return attach(marked, named, ["fp"], [id_col], how="inner")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``docs`` with one document of each component of ``simhash_groups``: the one with the smallest id, rows without id last.

    Of several rows with that id the one whose text has the smallest hash stays, of equal ones any. A component is all that is reachable, so in a
    chain a document goes that is linked to the next one only, not to the one that stays. All columns stay as they are.
    """
    fp, root, place = fresh("fp", docs), fresh("root", docs), fresh("place", docs)
    schema = StructType([*docs.schema.fields]).add(fp, LongType())

    def run(keys: pa.RecordBatch, texts: list) -> list:
        found = [fingerprint(t.encode("utf-8", "surrogatepass"), shingle, seed) for t in texts]
        return [*keys.columns[:-1], pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

    marked = written(map_texts(docs, list(docs.columns), text_col, run, schema), "fingerprints")
    named = roots(marked.select(F.col(fp).alias("fp")).distinct()).select(F.col("fp").alias(fp), F.col("root").alias(root))
    rooted = attach(marked, named, [fp], [text_col], how="inner")
    best = Window.partitionBy(root).orderBy(F.asc_nulls_last(id_col), F.xxhash64(text_col), F.asc_nulls_last(text_col))
    return rooted.withColumn(place, F.row_number().over(best)).where(F.col(place) == 1).select(*docs.columns)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n
