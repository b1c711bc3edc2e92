"""Toxicity scores of texts whose disguises are undone by a noisy channel.

The writer's word is seen through a channel that swaps letters for look-alike signs, puts signs or blanks between letters and repeats letters. A
disguised stretch of a text becomes a lattice: every character may stand for itself, for one of the letters it looks like, for nothing, or for
the end of a word, each at a cost. The best path under a character model of order three (Viterbi over its last two letters) is the restored text. The character
model counts all texts. Undisguised stretches, nearly all, stay as they are.

The restored text's words and their beginnings are the features of a logistic regression. It is fitted on at most ``sample`` labelled rows;
the features are those of the highest rank by how far their share differs between the labels there.

Defined cases: a null text is empty; a text without known features has the score of the intercept, also an empty one; a row without id is scored
but its label is not learned; of several labels of an id the toxic one counts; equal texts in the sample are one row, toxic if one is;
without labels, or with one kind of them only, every score is the share of toxic ones, 0.5 of none at all; very long
texts are scored whole, and a disguised stretch of over ``STRETCH`` characters is restored in parts of that length; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traffic_risk.llm.common import drop_written, map_texts, written
from traffic_risk.session import ship_package

# Letters that signs are written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou",
}
STRETCH = 2000
"""Characters of a lattice."""

END, OTHER, SLOTS = 0, 60, 64
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
_SLOT = {c: i + 1 for i, c in enumerate(_LETTERS)}
_TABLE = np.zeros(0x10000, dtype=np.int64)
for _c in range(0x10000):
    if chr(_c).isalpha():
        _TABLE[_c] = _SLOT.get(chr(_c), OTHER)
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_ENDS = ".,;:!?\"()[]{}<>"
_SIGNS = "".join(re.escape(c) for c in LOOKS_LIKE)
_UNIT = rf"(?:[^\W\d_]|[{_SIGNS}])"
_SPACED = re.compile(rf"(?<!\S){_UNIT}(?: {{1,2}}{_UNIT}){{2,}}(?!\S)")
"""Characters of which each stands alone between blanks."""
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_MARKED = re.compile(
    rf"(?:[{_SIGNS}]{{0,2}}[^\W\d_]+[{_SIGNS}.\-_~'’]{{1,3}})+[^\W\d_]+[$@]{{0,2}}"
    rf"|[{_SIGNS}]{{1,2}}[^\W\d_]{{2,}}|[^\W\d_]+[$@0134578]{{1,2}}(?![\w$@])"
)
"""Signs before, between or after letters; matched inside one word of the text."""


@dataclass(frozen=True)
class ChannelParams:
    swap: float = 1.0
    """Cost of a letter written as a sign; shared among the letters of the sign."""
    gap: float = 0.5
    """Cost of a dash, dot or blank put between letters; twice that of another sign."""
    end: float = 1.5
    """Cost of the end of a word at a dash, dot or blank; twice that at another sign."""
    figure: float = 6.0
    """Cost of a digit that stands for itself, a word's end here."""
    drawn: float = 0.5
    """Cost of each repeated letter beyond the second that is left out."""
    twice: float = 2.5
    """Cost of leaving out the second of two equal letters."""


@dataclass(frozen=True)
class ToxicityParams:
    sample: int = 20_000
    """Labelled rows that the regression and its features are fitted on, at most."""
    features: int = 4096
    shortest: int = 3
    longest: int = 8
    """Letters of a word's beginning that is a feature; whole words are, too."""
    least: int = 3
    """Rows a feature must occur in."""
    ridge: float = 0.5
    steps: int = 1000


class CharacterModel:
    """Log probabilities of a letter or word end after two others, from counts."""

    def __init__(self, counts: np.ndarray, weight: float = 8.0):
        three = counts.astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1.0) / (one.sum() + SLOTS)
        p2 = (two + weight * p1) / (two.sum(axis=1, keepdims=True) + weight)
        p3 = (three + weight * p2) / (three.sum(axis=2, keepdims=True) + weight)
        self.log = np.log(p3)
        self._rows: dict[tuple[int, int], list[float]] = {}

    def after(self, a: int, b: int) -> list[float]:
        row = self._rows.get((a, b))
        if row is None:
            row = self._rows[a, b] = self.log[a, b].tolist()
        return row


def count_characters(texts: list[str]) -> np.ndarray:
    """How often each three slots follow each other; everything but letters is a word's end, and ends in a row are one."""
    points = np.frombuffer(("  " + "  ".join(texts) + "  ").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    slots = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], OTHER)
    slots = slots[np.concatenate(([True], (slots[1:] != END) | (slots[:-1] != END)))]
    # the letter before last of a word's first letters is an end as well
    starts = np.flatnonzero(slots == END)
    slots = np.insert(slots, starts, END)
    codes = (slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:]
    return np.bincount(codes, minlength=SLOTS**3)


def fit_characters(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """The character model of all texts. Tasks send the counts that are not zero."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS**3, dtype=np.int64)
        for batch in batches:
            rows = max(1, batch.num_rows * (4 << 20) // max(batch.nbytes, 1))
            for first in range(0, batch.num_rows, rows):
                total += count_characters([t or "" for t in batch.column(0).slice(first, rows).to_pylist()])
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    found = docs.select(text_col).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS**3, dtype=np.int64)
    table = found.toArrow()  # at most SLOTS^3 rows
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return CharacterModel(counts.reshape(SLOTS, SLOTS, SLOTS))


def arcs(chunk: str, params: ChannelParams) -> list[list[tuple[str, float]]]:
    """The lattice of a stretch: for each character what it may stand for ("": nothing, " ": a word's end) and the cost."""
    out = []
    run = 0
    for i, ch in enumerate(chunk):
        run = run + 1 if i and chunk[i - 1] == ch else 1
        if ch.isalpha():
            ways = [(ch, 0.0)]
            if run > 1:
                drawn = run > 2 or chunk[i + 1 : i + 2] == ch
                ways.append(("", params.drawn if drawn else params.twice))
        elif ch in LOOKS_LIKE:
            cost = params.swap + math.log(len(LOOKS_LIKE[ch]))
            ways = [(letter, cost) for letter in LOOKS_LIKE[ch]]
            ways.append((" ", params.figure if ch.isdigit() else 2 * params.end))
            if not ch.isdigit():
                ways.append(("", 2 * params.gap))
        else:
            ways = [(" ", params.end), ("", params.gap)]
        out.append(ways)
    return out


def decode(chunk: str, model: CharacterModel, params: ChannelParams = ChannelParams()) -> str:
    """The best reading of a stretch, a word or several with blanks between them; of equal ones the first found."""
    states: dict[tuple[int, int], tuple[float, object]] = {(END, END): (0.0, None)}
    for ways in arcs(chunk, params):
        after: dict[tuple[int, int], tuple[float, object]] = {}
        for (a, b), (score, path) in states.items():
            row = model.after(a, b)
            for letter, cost in ways:
                if letter == "":
                    key, value, now = (a, b), score - cost, path
                elif letter == " ":
                    if b == END:  # ends in a row are one
                        key, value, now = (a, b), score - cost, path
                    else:
                        key, value, now = (END, END), score - cost + row[END], (path, " ")
                else:
                    slot = _SLOT.get(letter, OTHER)
                    key, value, now = (b, slot), score - cost + row[slot], (path, letter)
                if key not in after or value > after[key][0]:
                    after[key] = (value, now)
        states = after
    best, path = -math.inf, None
    for (a, b), (score, now) in states.items():
        score += 0.0 if b == END else model.after(a, b)[END]
        if score > best:
            best, path = score, now
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


class Reader:
    """Restores texts; keeps the readings of words it has seen, up to a number."""

    KEPT = 200_000

    def __init__(self, model: CharacterModel, params: ChannelParams = ChannelParams()):
        self.model, self.params = model, params
        self.known: dict[str, str] = {}

    def decoded(self, chunk: str) -> str:
        told = (decode(chunk[i : i + STRETCH], self.model, self.params) for i in range(0, len(chunk), STRETCH))
        return f" {' '.join(told)} "

    def word(self, word: str) -> str:
        """A word of the text (no blanks, lower case), restored."""
        bare = word.strip(_ENDS)
        if bare.isalpha() and not _DRAWN.search(bare):
            return bare
        told = self.known.get(word)
        if told is None:
            told = _MARKED.sub(lambda m: self.decoded(m[0]), word)
            if _DRAWN.search(told):
                told = _WORD.sub(lambda m: decode(m[0][:STRETCH], self.model, self.params) + m[0][STRETCH:] if _DRAWN.search(m[0]) else m[0], told)
            if len(self.known) < self.KEPT:
                self.known[word] = told
        return told

    def unspaced(self, text: str) -> str:
        """The text in lower case, letters that stand alone read as words."""
        return _SPACED.sub(lambda m: self.decoded(m[0]), text.lower())

    def restore(self, text: str) -> str:
        """The text in lower case, every disguised stretch replaced by its best reading."""
        return _TOKEN.sub(lambda m: m[0] if m[0].isalpha() and not _DRAWN.search(m[0]) else self._kept(m[0]), self.unspaced(text))

    def _kept(self, word: str) -> str:
        told = self.word(word)
        return word if told == word.strip(_ENDS) else told


def restored_texts(
    docs: DataFrame, model: CharacterModel, id_col: str = "doc_id", text_col: str = "text", params: ChannelParams = ChannelParams()
) -> DataFrame:
    """``id_col`` and ``restored``, the text in lower case without disguises, of every row."""
    reader = Reader(model, params)

    def run(keys: pa.RecordBatch, texts: list) -> list:
        return [keys.column(0), pa.array([reader.restore(t) for t in texts], pa.string())]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col], text_col, run, f"{id_col} {kind}, restored string")


def parts(word: str, shortest: int, longest: int) -> list[str]:
    """Features of a word: itself with a mark at its end, and its beginnings."""
    return [word[:k] for k in range(shortest, min(longest, len(word)) + 1)] + [word + "|"]


def words_of(text: str, reader: Reader) -> set[str]:
    """The different words of the restored text."""
    found: set[str] = set()
    for token in set(reader.unspaced(text).split()):
        told = reader.word(token)
        if told.isalpha():
            found.add(told)
        else:
            found.update(_WORD.findall(told))
    return found


class ToxicityModel:
    """What scoring needs: the channel, and weights of features. Readings and features of words are kept, up to a number."""

    KEPT = 200_000

    def __init__(self, channel: CharacterModel, weights: dict[str, float], intercept: float, params: ToxicityParams, noise: ChannelParams):
        self.channel, self.weights, self.intercept = channel, weights, intercept
        self.params = params
        self.reader = Reader(channel, noise)
        self._heads = {f[: params.shortest] for f in weights}
        self._tokens: dict[str, tuple] = {}

    def _of_token(self, token: str) -> tuple:
        told = self.reader.word(token)
        params, out = self.params, []
        for word in [told] if told.isalpha() else _WORD.findall(told):
            head = word[: params.shortest] if len(word) >= params.shortest else word + "|"
            if head[: params.shortest] in self._heads:
                out += [f for f in parts(word, params.shortest, params.longest) if f in self.weights]
        return tuple(out)

    def features(self, text: str) -> set[str]:
        """The known features of the restored text."""
        found: set[str] = set()
        tokens = self._tokens
        for token in set(self.reader.unspaced(text).split()):
            own = tokens.get(token)
            if own is None:
                own = self._of_token(token)
                if len(tokens) < self.KEPT:
                    tokens[token] = own
            if own:
                found.update(own)
        return found

    def score(self, text: str) -> float:
        at = self.intercept + math.fsum(self.weights[f] for f in self.features(text))
        return 1.0 / (1.0 + math.exp(-min(max(at, -700.0), 700.0)))


def _sampled(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """``text`` and ``toxic`` of at most about ``most`` labelled rows that may be learned from, one for each text."""
    ids = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    drawn = ids.orderBy(F.xxhash64(id_col), id_col).limit(most).withColumnRenamed(id_col, "_id")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "_id")
    rows = rows.groupBy(F.xxhash64("text").alias("_h")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    out = written(rows, "labelled")
    n = out.count()
    if n <= 2 * most:
        return out
    share = F.pmod(F.xxhash64("_h"), F.lit(1 << 60)) < int((1 << 60) * most / n)
    return out.where(share)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    params: ToxicityParams = ToxicityParams(),
    noise: ChannelParams = ChannelParams(),
) -> ToxicityModel:
    """A model from the labels whose id satisfies ``learn``, and the characters of all texts."""
    channel = fit_characters(docs, text_col)
    rows = _sampled(docs, labels, learn, id_col, text_col, label_col, params.sample)

    def features_of(text: str, reader: Reader) -> set[str]:
        return {f for w in words_of(text, reader) for f in parts(w, params.shortest, params.longest)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(channel, noise)
        tallies: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features_of(text, reader):
                    tallies.setdefault(f, [0, 0])[toxic > 0] += 1
                if len(tallies) > 1_000_000:
                    yield _tally(tallies)
                    tallies = {}
        yield _tally(tallies)

    totals = {bool(r["bad"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    clean, bad = totals.get(False, 0), totals.get(True, 0)
    if not clean or not bad:
        share = bad / (clean + bad) if clean + bad else 0.5
        return ToxicityModel(channel, {}, math.log(max(share, 1e-9) / max(1 - share, 1e-9)), params, noise)
    found = rows.select("text", "toxic").mapInArrow(count, "feature string, n0 bigint, n1 bigint")
    n0, n1 = F.sum("n0"), F.sum("n1")
    p0, p1 = (n0 + 0.5) / (clean + 1.0), (n1 + 0.5) / (bad + 1.0)
    gap = F.abs(F.log(p1 / p0)) / F.sqrt(1 / (n0 + 0.5) + 1 / (n1 + 0.5))
    ranked = found.groupBy("feature").agg(gap.alias("gap"), (n0 + n1).alias("n")).where(F.col("n") >= params.least)
    names = [r["feature"] for r in ranked.orderBy(F.desc("gap"), "feature").limit(params.features).collect()]
    number = {f: i for i, f in enumerate(names)}

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(channel, noise)
        for batch in batches:
            told = [sorted(number[f] for f in features_of(t, reader) if f in number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.list_(pa.int32())), batch.column(1)], ["features", "toxic"])

    sample = rows.select("text", "toxic").mapInArrow(matrix, "features array<int>, toxic int").orderBy("toxic", "features").toArrow()
    weights, intercept = regress(sample.column("features").to_pylist(), [t > 0 for t in sample.column("toxic").to_pylist()], len(names), params)
    return ToxicityModel(channel, dict(zip(names, weights, strict=True)), intercept, params, noise)


def _tally(tallies: dict[str, list[int]]) -> pa.RecordBatch:
    values = list(tallies.values())
    columns = [pa.array(list(tallies), pa.string()), *[pa.array([v[k] for v in values], pa.int64()) for k in (0, 1)]]
    return pa.RecordBatch.from_arrays(columns, ["feature", "n0", "n1"])


def regress(features: list[list[int]], toxic: list[bool], width: int, params: ToxicityParams) -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression with a ridge on the weights, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.array([c for f in features for c in f], dtype=np.int64)
    y = np.array(toxic, dtype=np.float64)
    w, v, b, c = np.zeros(width), np.zeros(width), 0.0, 0.0
    b = c = math.log(y.mean() / (1 - y.mean()))
    # the steps' length: a bound on the curvature, the largest column sum of |X'X| / 4
    sizes = np.bincount(row, minlength=len(y))
    most = np.bincount(col, weights=sizes[row] + 1.0, minlength=max(width, 1)).max() if len(col) else 0.0
    step = 1.0 / (0.25 * max(most, sizes.sum() + len(y)) + params.ridge)
    for i in range(params.steps):
        at = np.bincount(row, weights=v[col], minlength=len(y)) + c
        off = 1.0 / (1.0 + np.exp(-np.clip(at, -700, 700))) - y
        w_next = v - step * (np.bincount(col, weights=off[row], minlength=width) + params.ridge * v)
        b_next = c - step * off.sum()
        push = i / (i + 3.0)
        v, c = w_next + push * (w_next - w), b_next + push * (b_next - b)
        w, b = w_next, b_next
    return w.tolist(), float(b)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, keys: list[str | Column], schema: str, text_col: str = "text"
) -> DataFrame:
    """The key columns of every row (``schema`` has their types), ``score`` and ``predicted`` (1 from 0.5 on)."""

    def run(batch: pa.RecordBatch, texts: list) -> list:
        scores = [model.score(t) for t in texts]
        return [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    return map_texts(docs, keys, text_col, run, f"{schema}, score double, predicted int")
