"""Documents that hold passages of a benchmark, also paraphrased ones, by latent semantic retrieval.

Halko, Martinsson and Tropp: Finding structure with randomness (2011); Deerwester et al.: Indexing by latent
semantic analysis (1990).

Passages are windows of 32 words, 16 apart, of whole documents, and pieces of 32 words of the benchmark's items, the last one
counted from the item's end. The terms are the
items' words (others add nothing to a cosine with an item), weighted by inverse document frequency over all
documents. Words in more than ``common_share`` of them weigh nothing, except for pieces of which they are all but ``rare_share``: those
have an index of their own, in which every word weighs ``least_weight`` at least, so an item of frequent words is found too. A randomised SVD of the passages' TF-IDF matrix gives the latent space: the products with the random
test matrix are sums over passages, made on the executors and added up by term. It is fitted on all passages of all
documents, whose terms are written once as numbers, and on all items, which weigh as much as the
documents; every window of every document is then searched. A window and an item are candidates if the window's cosine with any of the item's pieces
in the latent space reaches ``least_cosine``; a window that is much shorter there than the piece counts as
``least_length`` of the piece's length, so a few rare words alone are no match. A candidate is a leak if the longest common subsequence of words,
in the document around the window, covers ``least_lcs`` of the item, or ``answer_lcs`` of it while the item's answer, its
last words, stands there word for word.

Items are the queries, searched in blocks of ``block_items``; only a block's model is broadcast, whose
size that number bounds.

Defined cases: null and empty texts and items have no passages and no leaks; words are runs of characters other
than ASCII white space and punctuation, lower case; items of fewer than ``least_words`` words must occur whole and in order (cosine as for others);
repeated items and rows each count (equal items are searched once); texts of any length are searched whole, some 2,000 windows at a time; of several windows of a document with one item the best is told; an empty
table on either side gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traffic_risk.llm.common import drop_written, fresh, map_texts, written
from traffic_risk.session import ship_package

_BLANKED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


@dataclass(frozen=True)
class LeakParams:
    cell: int = 16
    """Words between windows; a window has two cells."""
    rank: int = 64
    extra: int = 8
    """Columns of the test matrix beyond the rank."""
    common_share: float = 0.05
    rare_share: float = 0.25
    """Of a piece's words that are not common; with fewer of them all its words count."""
    least_weight: float = 0.1
    """Of the most frequent words; a word in a share s of the documents weighs -log(s)."""
    least_cosine: float = 0.55
    least_length: float = 0.6
    least_lcs: float = 0.75
    answer_lcs: float = 0.55
    answer_words: int = 5
    least_words: int = 8
    block_items: int = 4096
    seed: int = 7


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split()


@dataclass(frozen=True)
class Index:
    """A block's model: per term its place, and its row of the latent space times its weight; the items in it."""

    terms: dict[bytes, int]
    latent: np.ndarray
    ids: list
    items: list[list[bytes]]
    owners: np.ndarray
    """Number of the item of every piece."""
    vectors: np.ndarray
    """Unit vectors of the pieces."""
    lengths: np.ndarray


PASSAGES = "ids binary, lengths binary"


def passages_of(docs: DataFrame, text_col: str, terms: dict[bytes, int], size: int) -> DataFrame:
    """Every document's terms, as 32-bit numbers, and how many of them each of its passages of ``size`` words has."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            # a batch has a number of rows, not of bytes: give some of it at a time
            for first in range(0, len(texts), 64):
                rows = [_terms_of(words_of(text), terms, size) for text in texts[first : first + 64]]
                columns = [pa.array([r[k].astype(np.int32).tobytes() for r in rows], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "lengths"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PASSAGES)


def _terms_of(words: list[bytes], terms: dict[bytes, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([terms.get(w, -1) for w in words], dtype=np.int64)
    at = np.flatnonzero(ids >= 0)
    return ids[at], np.bincount(at // size, minlength=-(-len(ids) // size))


def count_terms(passages: DataFrame, n_terms: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents, of those with each term, and of each term's occurrences. Two numbers per term reach the driver."""

    def count(batches):
        found = np.zeros((2, n_terms + 1), dtype=np.int64)
        for batch in batches:
            found[0, -1] += batch.num_rows
            for ids in batch.column(0).to_pylist():
                held, times = np.unique(np.frombuffer(ids, dtype=np.int32), return_counts=True)
                found[0, held] += 1
                found[1, held] += times
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(f[at]) for f in found]], ["term", "n", "all"])

    counted = passages.select("ids").mapInArrow(count, "term bigint, n bigint, all bigint")
    rows = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).toArrow()
    out = np.zeros((2, n_terms + 1), dtype=np.int64)
    out[:, rows.column("term").to_numpy()] = [rows.column("n").to_numpy(), rows.column("all").to_numpy()]
    return int(out[0, -1]), out[0, :-1], out[1, :-1]


CHUNK = 1 << 12
"""Terms that are multiplied at once; more would leave the processor's cache."""


def _chunks(batches, place: np.ndarray):
    """Terms of passages, numbered by ``place`` (negative: left out), and where each passage starts, some passages at a time."""
    for batch in (b for b in batches if b.num_rows):
        ids, lengths = ([np.frombuffer(b, dtype=np.int32) for b in c.to_pylist()] for c in batch.columns)
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        told = place[ids]
        kept = np.append(0, np.cumsum(told >= 0))
        told, cuts = told[told >= 0], np.unique(kept[np.append(0, np.cumsum(lengths))])
        starts = cuts[:-1]
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + CHUNK, side="right")) - 1)
            yield told[cuts[first] : cuts[last]], starts[first:last] - cuts[first]
            first = last


def _rows(texts: list[list[bytes]], terms: dict[bytes, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all passages of ``size`` words, one after the other, and where each passage starts."""
    found = []
    for words in texts:
        ids = np.array([terms.get(w, -1) for w in words], dtype=np.int64)
        cut = [ids[at : at + size] for at in range(0, len(ids), size)]
        found += [held for held in (part[part >= 0] for part in cut) if len(held)]
    starts = np.cumsum([0, *map(len, found)])[:-1]
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), starts


def _times(ids: np.ndarray, starts: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The passages' rows of term counts times a matrix."""
    return np.add.reduceat(right[ids], starts, axis=0) if len(starts) else right[:0]


def _back(ids: np.ndarray, starts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transposed rows times a matrix: terms that occur, and their rows."""
    passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    if not len(first):
        return first, left[:0]
    return sorted_ids[first], np.add.reduceat(left[passage[order]], first, axis=0)


def _added(passages: DataFrame, place: np.ndarray, product, n: int, width: int) -> np.ndarray:
    """Sum over all passages of the rows (numbers, values) that ``product`` makes of some; they are added up by partition first."""
    names = [f"y{i}" for i in range(width)]

    def run(batches):
        total = np.zeros((n, width))
        for ids, starts in _chunks(batches, place):
            at, rows = product(ids, starts)
            total[at] += rows
        at = np.flatnonzero(total.any(axis=1))
        if len(at):
            columns = [pa.array(at), *[pa.array(np.ascontiguousarray(total[at, i])) for i in range(width)]]
            yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    schema = "row bigint, " + ", ".join(f"{c} double" for c in names)
    summed = passages.mapInArrow(run, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    table = summed.toArrow()
    out = np.zeros((n, width))
    out[table.column("row").to_numpy()] = np.column_stack([table.column(c).to_numpy() for c in names])
    return out


def fit(docs: DataFrame, items: list[list[bytes]], terms: dict[bytes, int], weights: np.ndarray, params: LeakParams) -> np.ndarray:
    """``fit_passages`` of texts."""
    passages = written(passages_of(docs, "text", terms, 2 * params.cell), "passages")
    _, _, total = count_terms(passages, len(terms))
    return fit_passages(passages, np.arange(len(terms)), total, items, terms, weights, params)


def fit_passages(
    passages: DataFrame, place: np.ndarray, total: np.ndarray, items: list[list[bytes]], terms: dict[bytes, int], weights: np.ndarray, params: LeakParams
) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the dominant right singular vectors of all passages and items.

    ``place`` gives the number of each of the passages' terms among ``terms`` (negative: not there), ``total`` the occurrences of ``terms``.
    """
    size = 2 * params.cell
    width = min(params.rank + params.extra, len(terms))
    own = _rows(items, terms, size)
    mass = float((weights[own[0]] ** 2).sum())
    boost = max(float((total * weights**2).sum()), mass) / mass if mass else 1.0

    by_term = weights[:, None]

    def scatter(ids: np.ndarray, starts: np.ndarray, right: np.ndarray):
        return _back(ids, starts, _times(ids, starts, right))

    basis = np.random.default_rng(params.seed).standard_normal((len(terms), width))
    for _ in range(2):
        right = basis * by_term
        summed = _added(passages, place, lambda ids, starts, right=right: scatter(ids, starts, right), len(terms), width)
        at, rows = scatter(*own, right)
        summed[at] += boost * rows
        basis = np.linalg.qr(summed * by_term)[0]
    right = basis * by_term

    def gram(ids: np.ndarray, starts: np.ndarray):
        seen = _times(ids, starts, right)
        return np.arange(width), seen.T @ seen

    small = _added(passages, place, gram, width, width)
    seen = _times(*own, right)
    values, vectors = np.linalg.eigh(small + boost * (seen.T @ seen))
    return basis @ vectors[:, np.argsort(values)[::-1][: params.rank]]


def build(docs: DataFrame, rows: list, text_col: str, params: LeakParams) -> list[Index]:
    """The models of one block of items, given as (id, text): of pieces with enough rare words, and of the others."""
    kept = [(i, words_of(t or "")) for i, t in rows]
    kept = [(i, w) for i, w in kept if w]
    if not kept:
        return []
    terms = {t: k for k, t in enumerate(sorted({t for _, words in kept for t in words}))}
    passages = written(passages_of(docs, text_col, terms, 2 * params.cell), "passages")
    n, df, total = count_terms(passages, len(terms))
    if not n:
        return []
    weights = np.maximum(np.log((n + 1) / (df + 0.5)), params.least_weight)
    rare = df <= params.common_share * n
    ids, items = [i for i, _ in kept], [w for _, w in kept]
    told: list[list[tuple[int, list[bytes]]]] = [[], []]
    for k, words in enumerate(items):
        for piece in pieces_of(words, 2 * params.cell):
            told[int(sum(rare[terms[w]] for w in piece) < params.rare_share * len(piece))].append((k, piece))
    out = []
    for common, cut in enumerate(told):
        if not cut:
            continue
        used = sorted({w for _, piece in cut for w in piece if common or rare[terms[w]]})
        mine, places = {w: k for k, w in enumerate(used)}, [terms[w] for w in used]
        pieces = [[w for w in piece if w in mine] for _, piece in cut]
        place = np.full(len(terms), -1)
        place[places] = np.arange(len(places))
        basis = fit_passages(passages, place, total[places], pieces, mine, weights[places], params)
        latent = (basis * weights[places][:, None]).astype(np.float32)
        vectors = np.array([latent[[mine[w] for w in piece]].sum(axis=0) for piece in pieces], dtype=np.float32)
        lengths = np.linalg.norm(vectors, axis=1)
        vectors /= np.maximum(lengths[:, None], 1e-9)
        lengths[lengths < 1e-6] = np.inf  # no direction to compare with
        out.append(Index(mine, latent, ids, items, np.array([k for k, _ in cut]), vectors, lengths))
    drop_written(passages)
    return out


def pieces_of(words: list[bytes], size: int) -> list[list[bytes]]:
    """Pieces of ``size`` words that cover all words; the last one ends with them."""
    starts = [*range(0, len(words) - size, size), max(0, len(words) - size)]
    return [words[at : at + size] for at in starts]


STRETCH = 2048
"""Windows that are compared with the pieces at once."""


def candidates(words: list[bytes], index: Index, params: LeakParams) -> list[tuple[int, int, float]]:
    """Window (number of its first cell), item and cosine of every pair that reaches ``least_cosine``.

    Long texts are taken a stretch of windows at a time, which overlap by a cell, so memory does not grow with the text.
    """
    get, cell = index.terms.get, params.cell
    ids = np.array([get(w, -1) for w in words], dtype=np.int64)
    least = params.least_cosine * params.least_length * index.lengths.min() * 0.999
    found: dict[tuple[int, int], float] = {}
    for begin in range(0, len(ids) // cell + 1, STRETCH):
        part = ids[begin * cell : (begin + STRETCH + 1) * cell]
        at = np.flatnonzero(part >= 0)
        if not len(at):
            continue
        of_cell = at // cell
        first = np.flatnonzero(np.append(True, of_cell[1:] != of_cell[:-1]))
        cells = np.zeros((min(STRETCH, len(ids) // cell + 1 - begin) + 1, index.latent.shape[1]), dtype=np.float32)
        cells[of_cell[first]] = np.add.reduceat(index.latent[part[at]], first, axis=0)
        windows = cells[:-1] + cells[1:]
        length = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        # shorter windows reach the cosine with no item
        long_ = np.flatnonzero(length >= least)
        if not len(long_):
            continue
        by = np.maximum(length[long_, None], params.least_length * index.lengths[None, :])
        similar = (windows[long_] @ index.vectors.T) / by
        window, piece = np.nonzero(similar >= params.least_cosine)
        for w, i, cosine in zip((begin + long_[window]).tolist(), index.owners[piece].tolist(), similar[window, piece].tolist(), strict=True):
            found[w, i] = max(found.get((w, i), cosine), cosine)
    return [(w, i, cosine) for (w, i), cosine in found.items()]


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence; bits of a number stand for the words of ``a`` (Hyyro 2004)."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hits = places.get(w)
        if hits:
            met = row & hits
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _holds(region: list[bytes], words: list[bytes]) -> bool:
    return b" " + b" ".join(words) + b" " in b" " + b" ".join(region) + b" "


def leaks_of(text: str, indexes: list[Index], params: LeakParams) -> list[tuple[int, float, float, bool]]:
    """Item number, cosine, share of the item in the common subsequence, answer found: the best window of each item."""
    words = words_of(text)
    best: dict[int, tuple[float, float, bool]] = {}
    met = [c for index in indexes for c in candidates(words, index, params)]
    for window, item, cosine in met:
        asked = indexes[0].items[item]
        first = window * params.cell
        region = words[max(0, first - len(asked)) : first + 2 * params.cell + len(asked)]
        common = set(asked)
        if sum(w in common for w in region) < params.answer_lcs * len(asked):
            continue
        share = lcs(asked, region) / len(asked)
        answer = _holds(region, asked[-params.answer_words :])
        if len(asked) < params.least_words:
            leaked = _holds(region, asked)
        else:
            leaked = share >= params.least_lcs or share >= params.answer_lcs and answer
        if leaked:
            found = (share, cosine, answer)
            best[item] = max(best.get(item, found), found)
    return [(item, cosine, share, answer) for item, (share, cosine, answer) in sorted(best.items())]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    params: LeakParams = LeakParams(),
) -> DataFrame:
    """One row per document and item that it leaks: ``id_col``, ``item_col``, ``cosine``, ``lcs``, ``answer``."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, _asked string, cosine double, lcs double, answer boolean"
    text = F.coalesce(F.col("text"), F.lit(""))
    items = benchmark.select(F.col(item_col).alias("_item"), F.sha2(text, 256).alias("_asked"), text.alias("text"))
    questions = items.dropDuplicates(["_asked"]).select("_asked", "text")  # equal items are searched once
    out = spark.createDataFrame([], schema)
    blocks = math.ceil(questions.count() / params.block_items)
    for block in range(blocks):
        rows = questions.where(F.pmod(F.xxhash64("_asked"), F.lit(blocks)) == block) if blocks > 1 else questions
        indexes = build(docs, [tuple(r) for r in rows.collect()], text_col, params)
        if indexes:
            out = out.unionAll(_search(docs, indexes, id_col, text_col, schema, params))
    named = out.withColumnRenamed(id_col, "_doc").join(items.select("_asked", "_item"), "_asked")
    return named.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "cosine", "lcs", "answer")


def _search(docs: DataFrame, indexes: list[Index], id_col: str, text_col: str, schema: str, params: LeakParams) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(indexes)
    item_type = schema.split(", ")[1].split(" ", 1)[1]

    def run(keys: pa.RecordBatch, texts: list) -> list:
        found = []
        for t in texts:
            found.append(
                [
                    {"item": model.value[0].ids[i], "cosine": c, "lcs": s, "answer": a}
                    for i, c, s, a in leaks_of(t, model.value, params)
                ]
            )
        return [keys.column(0), pa.array(found, kind)]

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    leak = f"array<struct<item:{item_type},cosine:double,lcs:double,answer:boolean>>"
    kind = to_arrow_type(_parse_datatype_string(leak))
    id_type = docs.schema[id_col].dataType.simpleString()
    found = map_texts(docs, [id_col], text_col, run, f"{id_col} {id_type}, leaks {leak}")
    names = [part.split(" ")[0] for part in schema.split(", ")]
    return found.select(id_col, F.explode("leaks").alias("leak")).select(
        F.col(id_col), F.col("leak.item").alias(names[1]), "leak.cosine", "leak.lcs", "leak.answer"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without documents that leak an item. That depends on the text alone, so rows are told apart by it, not by ids."""
    blob = fresh("blob", docs)
    content = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(blob)
    leaky = find_leaks(docs.select(content, text_col), benchmark, blob, text_col).select(blob).distinct()
    return docs.select("*", content).join(leaky, blob, "left_anti").select(*docs.columns)
