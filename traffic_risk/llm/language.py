"""Languages of texts: scripts narrow the candidates, Viterbi labels spans.

A word's score for a language is the sum of log ratios of its character trigrams (the word between blanks, lower
case), hashed into buckets: one vector of scores per bucket, smoothed, learned from labelled texts. A language is
a candidate for a word if the script of the word's letters makes up a fixed share of the language's
training letters. The best path of languages over a text's words pays a penalty per switch; the language
with most letters on the path is the prediction, its share of the letters the score.

As long as no other language gains more than the penalty on the best one over any stretch of words, the
recursion has only one possible outcome; it starts at the stretch where one first does.

Defined cases: a null text or one without letters is ``und`` with score 0, and so is every text when nothing
was learned; ties go to the language that sorts first; repeated rows each get a row; an empty table gives
an empty result; letters are those of all planes; texts of any length are labelled whole; only the id, text and language columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from traffic_risk.llm.common import fresh, map_texts

# First and last code points of scripts; letters outside of them count as "other".
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
NAMES = (*SCRIPTS, "other")
FLUSH = 1 << 20
"""Letters that are counted at once."""
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    buckets: int = 1 << 16
    penalty: float = 15.0
    smoothing: float = 0.5
    script_share: float = 0.01
    """A language is a candidate for a script that makes up this share of its letters."""
    cap: float = 4.0
    """Largest log ratio that one trigram may add."""


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    scores: np.ndarray
    """Per bucket and language."""
    scripts: np.ndarray
    """Per script and language: whether the language is a candidate."""
    penalty: float


def _letter_table() -> np.ndarray:
    """Script number of every code point, -1 if it is no letter."""
    out = np.full(0x110000, -1, dtype=np.int8)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
            out[point] = len(NAMES) - 1
    for number, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            part = out[first : last + 1]
            part[part >= 0] = number
    return out


LETTERS: np.ndarray | None = None


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the lower-cased text with single blanks between words, in front and at the end.

    Gives code points (blank 32), script per place (-1 for blanks), and first place of every word.
    """
    global LETTERS
    if LETTERS is None:
        LETTERS = _letter_table()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    script = LETTERS[points]
    letter = script >= 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    # a blank stands before every word and after the last one
    n_letters, n_words = int(letter.sum()), int(first.sum())
    if not n_words:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    place = np.cumsum(letter) + np.cumsum(first) - 1
    out = np.full(n_letters + n_words + 1, 32, dtype=np.uint32)
    kinds = np.full(len(out), -1, dtype=np.int8)
    out[place[letter]] = points[letter]
    kinds[place[letter]] = script[letter]
    return out, kinds, place[first]


def _trigrams(points: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the trigram around every place that has two neighbours."""
    p = points.astype(np.uint64)
    mixed = (p[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= p[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text has this remainder; false without an id."""
    text = F.col(id_col).cast("string").cast("binary")
    return F.coalesce(F.pmod(F.crc32(text), F.lit(folds)) == fold, F.lit(False))


def fit(train: DataFrame, text_col: str, lang_col: str, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from all rows with a language. The model has a fixed size per language."""
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    names = tuple(sorted(r.lang for r in rows.select("lang").distinct().collect()))
    if not names:
        return LanguageModel((), np.zeros((params.buckets, 0)), np.zeros((len(NAMES), 0), bool), params.penalty)
    number = {name: i for i, name in enumerate(names)}
    buckets = params.buckets

    def count(batches):
        # letters by script, then trigrams by bucket
        both = np.zeros((len(names), len(NAMES) + buckets), dtype=np.int64)
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def add():
            for lang, slots in held.items():
                both[lang] += np.bincount(np.concatenate(slots), minlength=both.shape[1])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, kinds, _ = _words(text)
                if len(points):
                    own = held.setdefault(number[lang], [])
                    own += [kinds[kinds >= 0].astype(np.int64), _trigrams(points, buckets) + len(NAMES)]
                    size += len(points)
                if size >= FLUSH:
                    add()
                    size = 0
        add()
        lang, row = np.nonzero(both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row), pa.array(lang), pa.array(both[lang, row])], ["slot", "lang", "n"]
        )

    from traffic_risk.session import ship_package

    ship_package(train.sparkSession)
    parts = rows.mapInArrow(count, "slot long, lang long, n long").groupBy("slot", "lang").agg(F.sum("n").alias("n"))
    table = np.zeros((len(NAMES) + buckets, len(names)))
    for part in parts.toArrow().to_batches():  # at most one row per slot and language
        slot, lang, n = (c.to_numpy() for c in part.columns)
        table[slot, lang] = n
    letters, found = table[: len(NAMES)], table[len(NAMES) :]
    rate = (found + params.smoothing) / (found.sum(0) + params.smoothing * buckets)
    ratio = np.log(rate) - np.log(rate.mean(axis=1, keepdims=True))
    seen = found.sum(axis=1, keepdims=True) > 0
    scores = np.where(seen, np.clip(ratio, -params.cap, params.cap), 0.0)
    candidate = letters >= params.script_share * np.maximum(letters.sum(0), 1)
    return LanguageModel(names, scores.astype(np.float32), candidate, params.penalty)


def label_words(text: str, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Language number per word, letters per word, and the first character of each word."""
    points, kinds, firsts = _words(text)
    if not len(points) or not model.names:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    grams = _trigrams(points, len(model.scores))
    # word i has the trigrams centred on its letters; those centred on blanks stand at its front
    total = np.add.reduceat(model.scores[grams], firsts - 1, axis=0).astype(np.float64)
    bounds = np.append(firsts, len(points))
    lengths = np.diff(bounds) - 1
    if len(model.names) > 1:
        script = kinds[firsts]
        allowed = model.scripts[script]
        narrowed = allowed.any(axis=1)
        total[narrowed[:, None] & ~allowed] -= 1e6
    return best_path(total, model.penalty), lengths, firsts


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The path of largest sum of scores less the penalty per switch."""
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    path = np.full(n, best, dtype=np.int64)
    # lead of every language over the best one since the last word at which it would have started anew
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    before = np.vstack((np.full((1, k), -penalty), gain[:-1]))
    lead = gain - np.minimum.accumulate(before, axis=0)
    lead[:, best] = 0
    most = lead.max(axis=1)
    late = np.flatnonzero(most > penalty)
    if not len(late):
        return path
    calm = np.flatnonzero(most[: late[0]] <= 0)
    start = int(calm[-1]) + 1 if len(calm) else 0
    value = [0.0 if i == best or not start else -penalty for i in range(k)]
    came = []
    for row in scores[start:].tolist():
        top = max(value)
        switch, source = top - penalty, value.index(top)
        came.append([i if v >= switch else source for i, v in enumerate(value)])
        value = [(v if v >= switch else switch) + x for v, x in zip(value, row, strict=True)]
    at = value.index(max(value))
    for t in range(n - 1, start - 1, -1):
        path[t] = at
        at = came[t - start][at]
    return path


def predict(text: str, model: LanguageModel) -> tuple[str, float]:
    """The language of most letters and its share of them."""
    path, letters, _ = label_words(text, model)
    if not len(path):
        return UNKNOWN, 0.0
    share = np.bincount(path, weights=letters, minlength=len(model.names))
    best = int(share.argmax())
    return model.names[best], float(share[best] / share.sum())


def spans(text: str, model: LanguageModel) -> list[tuple[str, int, int]]:
    """Language, first and last word number of every stretch of one language."""
    path, _, _ = label_words(text, model)
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if len(path) else []
    return [(model.names[path[a]], a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def identify(
    docs: DataFrame, model: LanguageModel, keys: list[str | Column], schema: str | StructType, text_col: str = "text"
) -> DataFrame:
    """The key columns of every row, ``lang_pred`` and ``score``.

    ``schema`` has the key columns' types; as a struct type it has the last two columns, too, under any names.
    """

    def run(batch: pa.RecordBatch, texts: list) -> list:
        found = [predict(t, model) for t in texts]
        return [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    if isinstance(schema, str):
        schema = f"{schema}, lang_pred string, score double"
    return map_texts(docs, keys, text_col, run, schema)


def keep_identified(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.4
) -> DataFrame:
    """``docs`` without those in no language, or of which no language labels the share ``least`` of the letters.

    A missing language becomes the predicted one.
    """
    found_lang, found_share = fresh("lang_pred", docs), fresh("lang_share", docs)
    schema = StructType([*docs.schema.fields]).add(found_lang, "string").add(found_share, "double")
    found = identify(docs, model, list(docs.columns), schema, text_col)
    kept = found.where((F.col(found_lang) != UNKNOWN) & (F.col(found_share) >= least))
    return kept.withColumn(lang_col, F.coalesce(lang_col, found_lang)).select(*docs.columns)
