"""Encoding texts into the pieces of a SentencePiece vocabulary, N best segmentations, and decoding.

A text, with one blank put in front, is cut before every run of blanks, and around line ends; no piece of the
vocabulary crosses such a cut, so the lattice of a text is a chain of small lattices. In each of them Viterbi
runs forward over the pieces, and its scores are exact heuristics for A* from the end to the front, which gives
segmentations best first. The N best of a text combine those of its parts: only the N - 1 parts that lose least by
their second segmentation can differ from their best one, so A* runs in these alone; Viterbi carries the second
best score along with the best. All parts of a batch that are not remembered run forward together, see ``piece_lattice``.

Scores are the model's for unigram vocabularies. Merge vocabularies have ranks, not probabilities; there a piece's
score is -log(2 + rank), so frequent pieces are cheap and fewer pieces are better.

Characters without a piece become byte pieces; so does U+2581, which stands for the blank in pieces. Decoding is
therefore exact for every text.

Defined cases: a null text is empty and has no pieces, score 0 and one segmentation; of equal scores any segmentation
may come first, always the same one; very long texts and parts are encoded whole; repeated rows each get a row; an empty table gives an empty result; only the
id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from array import array
from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.llm.common import as_bytes, map_texts, remembered
from traffic_risk.llm.piece_lattice import Paths, Tree, ends_of, segment_together, stretches

MARK = "▁"
PART = re.compile(rf" +[^ \n{MARK}]*|[^ \n{MARK}]+|\n|{MARK}")
SLICE = 4 << 20
"""Bytes of rows whose parts are segmented together."""
CACHED = 3 << 16
"""Parts of texts whose segmentations a Python worker remembers, besides those of the batch at hand."""


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model: what it takes to encode and decode, small enough to send along."""

    pieces: dict[str, tuple[int, float]]
    """Id and score of every piece, and (-1, 0) for every other beginning of one."""
    scores: list[float]
    bytes_: list[int]
    """Id of every byte's piece."""
    text: list[bytes]
    """What an id stands for."""

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        raw = [model.get_score(i) for i in range(size)]
        merges = all(s == int(s) for s in raw)
        ids, bytes_, text = {}, [-1] * 256, [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                bytes_[value], text[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(MARK, " ")
                if PART.fullmatch(piece):  # a piece that crosses a cut is never used
                    ids[piece] = i
                text[i] = piece.encode()
        scores = [-math.log(2 - s) if merges else s for s in raw]
        if merges:
            rarest = min(scores)
            for i in bytes_:
                scores[i] = rarest
        pieces = {piece[:n]: (-1, 0.0) for piece in ids for n in range(1, len(piece))}
        pieces |= {piece: (i, scores[i]) for piece, i in ids.items()}
        return Vocabulary(pieces, scores, bytes_, text)


Edge = tuple[int, int, float, tuple[int, ...]]
"""Start, end, score and ids of a piece in a lattice."""


def forward(part: str, vocab: Vocabulary) -> tuple[list[Edge], list[float]]:
    """All pieces by start, and the best score up to every place."""
    n, get = len(part), vocab.pieces.get
    edges: list[Edge] = []
    best = [0.0] + [-math.inf] * n
    for i in range(n):
        here = best[i]
        first = len(edges)
        for j in range(i + 1, n + 1):
            found = get(part[i:j])
            if found is None:
                break
            piece, score = found
            if piece >= 0:
                best[j] = max(best[j], here + score)
                edges.append((i, j, score, (piece,)))
        if first == len(edges) or edges[first][1] > i + 1:
            spelled = tuple([vocab.bytes_[b] for b in part[i].encode("utf-8", "surrogatepass")])
            score = sum([vocab.scores[b] for b in spelled])
            best[i + 1] = max(best[i + 1], here + score)
            edges.append((i, i + 1, score, spelled))
    return edges, best


def viterbi(part: str, vocab: Vocabulary) -> tuple[tuple[int, ...], float, float]:
    """Ids and score of the best segmentation, and how much less the second one has.

    Forward, with the two best scores up to every place; different pieces on the way make different segmentations.
    """
    n, get = len(part), vocab.pieces.get
    lowest = -math.inf
    best, second = [0.0] + [lowest] * n, [lowest] * (n + 1)
    came: list = [None] * (n + 1)
    for i in range(n):
        here, below = best[i], second[i]
        spelled = True
        for j in range(i + 1, n + 1):
            found = get(part[i:j])
            if found is None:
                break
            if found[0] >= 0:
                if j == i + 1:
                    spelled = False
                score = here + found[1]
                top = best[j]
                if score > top:
                    other = below + found[1]
                    second[j] = top if top > other else other
                    best[j] = score
                    came[j] = i, found[0]
                elif score > second[j]:
                    second[j] = score
        if spelled:
            ids = tuple([vocab.bytes_[b] for b in part[i].encode("utf-8", "surrogatepass")])
            worth = sum([vocab.scores[b] for b in ids])
            score, top = here + worth, best[i + 1]
            if score > top:
                other = below + worth
                second[i + 1] = top if top > other else other
                best[i + 1] = score
                came[i + 1] = i, ids
            elif score > second[i + 1]:
                second[i + 1] = score
    path, at = [], n
    while at:
        at, piece = came[at]
        path.append(piece)
    path.reverse()
    if any([type(p) is tuple for p in path]):
        path = [i for p in path for i in (p if type(p) is tuple else (p,))]
    return tuple(path), best[n], best[n] - second[n]


def n_best(part: str, vocab: Vocabulary, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """Up to ``n`` segmentations of one part, best first, as (score, ids)."""
    edges, best = forward(part, vocab)
    ends: list[list] = [[] for _ in range(len(part) + 1)]
    for i, j, score, ids in edges:
        ends[j].append((i, ids, score))
    heap = [(-best[-1], 0, len(part), 0.0, None)]
    count, found = 0, []
    visits = [0] * (len(part) + 1)
    while heap and len(found) < n:
        _, _, at, so_far, chain = heapq.heappop(heap)
        visits[at] += 1
        if visits[at] > n:  # the n best through a place end in the n best ends from there
            continue
        if at == 0:
            ids = []
            while chain:
                ids.extend(chain[0])
                chain = chain[1]
            found.append((so_far, tuple(ids)))
            continue
        for start, piece, score in ends[at]:
            count += 1
            heapq.heappush(heap, (-(so_far + score + best[start]), count, start, so_far + score, (piece, chain)))
    return found


def cut_all(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different parts of many texts, which of them each text has, text after text, and how many each has.

    The cuts are those of ``PART``, found in the bytes of all texts at once, so no part is a Python object but the different ones.
    """
    texts = texts.cast(pa.large_string())
    led = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
    begins = np.frombuffer(led.buffers()[1], dtype=np.int64, count=len(led) + 1)
    data = np.frombuffer(led.buffers()[2], dtype=np.uint8, count=int(begins[-1]))
    blank, line = data == ord(" "), data == ord("\n")
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut |= line
    cut[1:] |= line[:-1]
    first, *others_ = MARK.encode()
    marks = np.flatnonzero(data[: len(data) - len(others_)] == first)
    for k, byte in enumerate(others_, 1):
        marks = marks[data[marks + k] == byte]
    after = marks + 1 + len(others_)
    cut[marks] = True
    cut[after[after < len(data)]] = True
    cut[begins[:-1]] = True
    places = np.flatnonzero(cut)
    sizes = np.diff(np.searchsorted(places, begins))
    parts = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(data))), led.buffers()[2]).dictionary_encode()
    which = parts.indices.to_numpy()
    empty = np.flatnonzero(np.diff(begins) == 1)  # the blank in front alone is no part
    if len(empty):
        which = np.delete(which, np.searchsorted(places, begins[empty]))
        sizes[empty] = 0
    return [b.decode() for b in as_bytes(parts.dictionary)], which, sizes


class Encoder:
    """Segmentations of whole texts; remembers a bounded number of parts."""

    def __init__(self, vocab: Vocabulary, n: int):
        self.n, self.vocab = n, vocab
        self.tree = Tree.of(vocab.pieces)
        self.known: dict[str, int] = {}
        """Row of a part in ``paths``."""
        self.paths = Paths.of([])
        self.inexact = np.zeros(0, dtype=bool)
        """By row: whether the pieces are not spelled like the part; none has been seen."""
        self.spelled = np.frombuffer(b"".join(vocab.text), dtype=np.uint8)
        self.spelled_ends = ends_of(np.array([len(t) for t in vocab.text], dtype=np.int64))
        self.several = lru_cache(CACHED >> 4)(lambda part: n_best(part, vocab, n))

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Segment all parts of texts that are not known yet, together; of the texts only their different parts are held."""
        asked: set[str] = set()
        for parts in texts:
            asked.update(parts)
        self.remember(asked)

    def remember(self, asked: Collection[str]) -> None:
        """Segment different parts that are not known yet, together."""
        if len(self.known) + len(asked) > CACHED:
            kept = [p for p in asked if p in self.known]
            rows = np.array([self.known[p] for p in kept], dtype=np.int64)
            self.known = {p: k for k, p in enumerate(kept)}
            self.paths, self.inexact = self.paths.take(rows), self.inexact[rows]
        known = self.known
        new, found, rest = segment_together([p for p in asked if p not in known], self.tree)
        new += rest
        if new:
            found = Paths.joined([found, Paths.of([viterbi(part, self.vocab) for part in rest])])
            self.inexact = np.append(self.inexact, self.misspelled(new, found))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.paths = Paths.joined([self.paths, found])

    def misspelled(self, parts: list[str], found: Paths) -> np.ndarray:
        """For which parts the pieces are not spelled like them."""
        raw = [p.encode("utf-8", "surrogatepass") for p in parts]
        want_ends = ends_of(np.fromiter(map(len, raw), np.int64, len(raw)))
        want = np.frombuffer(b"".join(raw), dtype=np.uint8)
        starts = self.spelled_ends[found.ids]
        sizes = self.spelled_ends[found.ids + 1] - starts
        got = self.spelled[stretches(starts, sizes)]
        got_ends = ends_of(sizes)[found.ends]
        wrong = np.diff(got_ends) != np.diff(want_ends)
        if wrong.any():
            for k in np.flatnonzero(~wrong).tolist():
                wrong[k] = not np.array_equal(got[got_ends[k] : got_ends[k + 1]], want[want_ends[k] : want_ends[k + 1]])
        else:
            wrong[np.searchsorted(want_ends, np.flatnonzero(got != want), side="right") - 1] = True
        return wrong

    def best(self, part: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of a part's best segmentation, and how much less the second one has."""
        if part not in self.known:
            self.learn([[part]])
        return self.paths.take(np.array([self.known[part]])).rows()[0]

    def cut(self, text: str) -> list[str]:
        return PART.findall(" " + text) if text else []

    def n_best(self, text: str) -> list[tuple[float, list[int]]]:
        """Segmentations of a whole text, best first, as (score, ids)."""
        parts = self.cut(text)
        best = [self.best(p) for p in parts]
        out = []
        for score, choice in self.choices(parts, range(len(parts)), np.array([b[1] for b in best]), np.array([b[2] for b in best])):
            ids = [i for k, p in enumerate(parts) for i in (self.several(p)[choice[k]][1] if k in choice else best[k][0])]
            out.append((score, ids))
        return out

    def choices(self, words: Sequence[str], parts: Sequence[int], scores: np.ndarray, losses: np.ndarray) -> list[tuple[float, dict[int, int]]]:
        """The N best combinations, as (score, the number of the segmentation of every part that is not at its best).

        A text's parts are numbers of ``words``; ``scores`` and ``losses`` are theirs.
        """
        found = [(math.fsum(scores.tolist()), {})]
        wanted = min(self.n - 1, len(losses))
        if not wanted:
            return found
        near = np.flatnonzero(losses <= np.partition(losses, wanted - 1)[wanted - 1])
        for k in near[np.argsort(losses[near], kind="stable")[:wanted]].tolist():
            if losses[k] == math.inf:
                break
            several = self.several(words[parts[k]])
            grown = [
                (score + alternative - several[0][0], {**choice, k: j} if j else choice)
                for score, choice in found
                for j, (alternative, _) in enumerate(several)
            ]
            found = heapq.nlargest(self.n, grown, key=lambda x: x[0])
        return found


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text that ``ids`` encode."""
    return b"".join([vocab.text[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


EDITS = "array<struct<score: double, edits: array<struct<start: int, stop: int, ids: array<int>>>>>"


class Others:
    """The segmentations after the best one of text after text, as the stretches of its ids that are others in them."""

    def __init__(self) -> None:
        self.texts, self.edits, self.ids = [0], [0], [0]
        """Where the segmentations of texts end, the edits of segmentations and the ids of edits."""
        self.scores, self.start, self.stop, self.spelled = array("d"), array("i"), array("i"), array("i")

    def add(self, found: list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]) -> None:
        """A text's: each with its score and edits, as (start, stop, ids)."""
        for score, edits in found:
            for start, stop, ids in edits:
                self.start.append(start)
                self.stop.append(stop)
                self.spelled.extend(ids)
                self.ids.append(len(self.spelled))
            self.scores.append(score)
            self.edits.append(len(self.start))
        self.texts.append(len(self.scores))

    def column(self) -> pa.Array:
        def numbers(values: array) -> pa.Array:
            return pa.array(np.frombuffer(values, dtype=np.dtype(values.typecode)) if len(values) else np.zeros(0, dtype=values.typecode))

        def lists(ends: list[int], values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        edits = pa.StructArray.from_arrays([numbers(self.start), numbers(self.stop), lists(self.ids, numbers(self.spelled))], ["start", "stop", "ids"])
        return lists(self.texts, pa.StructArray.from_arrays([numbers(self.scores), lists(self.edits, edits)], ["score", "edits"]))


def segmentation(ids: Column, edits: Column) -> Column:
    """The ids of another segmentation, from the best one's and its edits."""
    whole = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, e: Column) -> Column:
        gap = F.slice(ids, acc["at"] + 1, e["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], gap, e["ids"]).alias("out"), e["stop"].alias("at"))

    return F.aggregate(edits, whole, step, lambda acc: F.concat(acc["out"], F.slice(ids, acc["at"] + 1, F.size(ids))))


def all_segmentations(encoded: DataFrame) -> DataFrame:
    """The rows of ``encode_texts`` with ``segmentations``: all of them as lists of ids, best first."""
    every = F.concat(F.array("ids"), F.transform("others", lambda o: segmentation(F.col("ids"), o["edits"])))
    return encoded.withColumn("segmentations", every)


def encode_texts(
    docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col``, the best segmentation's ``ids``, ``n_pieces``, the ``scores`` of the ``n`` best, whether decoding gives the text back
    (``exact``), and ``others``: the segmentations after the best, by what differs from it; ``all_segmentations`` writes them out."""
    vocab = Vocabulary.load(model_path)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)  # the size of a vocabulary
    key = uuid.uuid4().hex

    def run(keys: pa.RecordBatch, _: list) -> list:
        # what the one encoder of this Python worker remembers serves all its tasks
        encoder = remembered(key, lambda: Encoder(sent.value, n))
        words, parts, sizes = cut_all(keys.column(keys.num_columns - 1))
        encoder.remember(words)
        rows = np.fromiter(map(encoder.known.__getitem__, words), np.int64, len(words))[parts]
        paths, ends = encoder.paths, ends_of(sizes)
        lengths = paths.ends[rows + 1] - paths.ends[rows]
        ids, at = paths.ids[stretches(paths.ends[rows], lengths)], ends_of(lengths)
        own_scores, losses, where = paths.scores[rows], paths.losses[rows], ends.tolist()
        scores, rest = [], Others()
        for a, b in zip(where, where[1:], strict=False):
            found = encoder.choices(words, parts[a:b], own_scores[a:b], losses[a:b])
            scores.append([score for score, _ in found])
            rest.add([
                (score, [(int(at[a + k] - at[a]), int(at[a + k + 1] - at[a]), encoder.several(words[parts[a + k]])[j][1]) for k, j in sorted(choice.items())])
                for score, choice in found[1:]
            ])
        # pieces of all parts were decoded when they were learned, and a text's bytes are its parts' bytes
        exact = np.diff(ends_of(encoder.inexact[rows])[ends]) == 0
        every = pa.ListArray.from_arrays(pa.array(at[ends], pa.int32()), pa.array(ids, pa.int32()))
        return [keys.column(0), every, pa.array(np.diff(at[ends]), pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(exact), rest.column()]

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, ids array<int>, n_pieces bigint, scores array<double>, exact boolean, others {EDITS}"
    return map_texts(docs, [id_col], text_col, run, schema, SLICE, key)
