"""Readings against all paths of the lattice, held-out labels, disguised words, odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traffic_risk.llm import language, registry, toxicity
from traffic_risk.llm.toxicity import CharacterModel, ChannelParams, Reader, arcs, count_characters, decode

SF = "/root/testdata/sf0.01"
TEXT = "the stupid idiot told a moron that trash is worthless and the loser had a pathetic clown at the station with them "


@pytest.fixture(scope="module")
def model():
    return CharacterModel(count_characters([TEXT] * 100).reshape(64, 64, 64))


def slot(letter):
    return toxicity._SLOT.get(letter, toxicity.OTHER)


def plain_decode(chunk, model, params):
    """The best of all paths, one after the other."""
    best, told = -math.inf, None
    for path in itertools.product(*arcs(chunk, params)):
        a = b = toxicity.END
        score, out = 0.0, ""
        for letter, cost in path:
            score -= cost
            if letter == " " and b != toxicity.END:
                score, a, b, out = score + model.log[a, b, 0], 0, 0, out + " "
            elif letter not in ("", " "):
                score, a, b, out = score + model.log[a, b, slot(letter)], b, slot(letter), out + letter
        score += 0.0 if b == toxicity.END else model.log[a, b, 0]
        if score > best + 1e-9:
            best, told = score, out.strip()
    return best, told


@pytest.mark.parametrize("chunk", ["1d10t", "m-o r", "l00$e", "t.r.a", "looose", "@*t", "h3-h", "a a a", "ss", "7r45h"])
def test_best_reading_of_all_paths(model, chunk):
    best, want = plain_decode(chunk, model, ChannelParams())
    got = decode(chunk, model)
    assert got == want, best


def test_counts_are_those_of_a_plain_version():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé 1.ЖA") for _ in range(rng.randrange(40))) for _ in range(50)]
    want = np.zeros(64**3, dtype=np.int64)
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in words:
            s = [0, 0, *map(slot, w), 0]
            for x, y, z in zip(s, s[1:], s[2:], strict=False):
                want[(x * 64 + y) * 64 + z] += 1
    first, middle, last = np.indices((64, 64, 64)).reshape(3, -1)
    asked = (middle != 0) | ((first == 0) & (last != 0))  # nothing follows the end of a word but the start of the next
    assert (count_characters(texts)[asked] == want[asked]).all()


@pytest.mark.parametrize(
    "text, want",
    [("an 1d10t", "idiot"), ("s t u p i d", "stupid"), ("m-o-r-o-n", "moron"), ("looooser", "loser"), ("tr@sh", "trash"), ("p4th3t1c!", "pathetic"), ("ID10T", "idiot"), ("w0rthle$$", "worthless")],
)
def test_disguises(model, text, want):
    assert want in Reader(model).restore(text).split()


@pytest.mark.parametrize("text", ["", "the station", "with them, at the trash.", "É: the station 12 34.5", "idiot*** the###"])
def test_plain_texts_stay(model, text):
    assert Reader(model).restore(text) == text.lower()


def test_restored_words_are_those_scored(model):
    reader, other = Reader(model), Reader(model)
    for text in ["an 1d10t, tr@sh!! s t u p i d the### looooser jo.81@mail.example a.b-c", TEXT, "x" * 9000 + " y y y " * 3000]:
        assert toxicity.words_of(text, reader) == set(toxicity._WORD.findall(other.restore(text)))


def test_held_out_labels(spark):
    rows = registry.QUERIES["op12_toxicity"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    held = {r.doc_id for r in docs.where(language.held_out("doc_id", 5, 0)).collect()}
    assert {r.doc_id for r in rows if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    right = sum(a == b for a, b in told)
    assert right >= 0.93 * len(told)


def test_disguised_toxic_texts_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    bad = ["idiot", "stupid", "trash", "moron", "pathetic", "worthless"]
    swap = str.maketrans("ioaest", "10@3$7")

    def hide(word):
        kind = rng.randrange(3)
        if kind == 0:
            k = rng.randrange(1, len(word) - 1)
            return word[:k] + word[k].translate(swap) + word[k + 1 :]
        return " ".join(word) if kind == 1 else word[:2] + word[2] * 4 + word[3:]

    clean = [r.text for r in docs.collect() if r.text and 200 < len(r.text) < 900 and not any(b in r.text.lower() for b in bad)][:60]
    planted = []
    for text in clean[:30]:
        words = text.split()
        for w in bad * 2:
            words.insert(rng.randrange(len(words)), hide(w))
        planted.append(" ".join(words))
    frame = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(planted + clean[30:])], "doc_id long, text string")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~language.held_out("doc_id", 5, 0))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(frame, model, ["doc_id"], "doc_id long").collect()}
    assert sum(got[100_000 + i] for i in range(30)) >= 27
    assert sum(got[100_000 + i] for i in range(30, 60)) <= 3


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "bad bad word", "x"), (1, "bad other", "y"), (2, "good word", None), (3, None, "z"), (4, "", "z"), (None, "bad word", "z"), (5, "good day " * 40_000, "z"), (6, "bad", "q")],
        "doc_id long, text string, toxic string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (9, 1), (5, 0), (6, 1)], "doc_id long, toxic int")
    params = toxicity.ToxicityParams(least=1)
    model = toxicity.fit(docs, labels, F.lit(True), params=params)
    got = toxicity.score_toxicity(docs, model, ["doc_id"], "doc_id long").collect()
    told = {(r.doc_id, round(r.score, 6)) for r in got}
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    scores = dict(sorted((r.doc_id or 0, r.score) for r in got))
    assert scores[6] > scores[4] > scores[2] and scores[3] == scores[4] and len(told) >= 5


@pytest.mark.parametrize("rows, share", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_one_kind_of_labels(spark, rows, share):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert all(abs(r.score - share) < 1e-6 for r in toxicity.score_toxicity(docs, model, ["doc_id"], "doc_id long").collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score_toxicity(docs, model, ["doc_id"], "doc_id long").collect() == []
    assert toxicity.restored_texts(docs, model.channel).collect() == []
