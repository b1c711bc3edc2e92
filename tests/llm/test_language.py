"""The best path against plain Viterbi, held-out accuracy, mixed and odd texts."""

import random
import zlib

import numpy as np
import pytest

from traffic_risk.llm import language, registry

SF = "/root/testdata/sf0.01"


def plain_value(scores, path, penalty):
    return sum(scores[t][k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def plain_best(scores, penalty):
    value = list(scores[0])
    for row in scores[1:]:
        top = max(value) - penalty
        value = [max(v, top) + x for v, x in zip(value, row)]
    return max(value)


@pytest.mark.parametrize("seed", range(60))
def test_best_path(seed):
    rng = random.Random(seed)
    n, k = rng.choice([1, 2, 5, 40, 300]), rng.choice([1, 2, 4])
    scores = np.zeros((n, k))
    now = 0
    for t in range(n):
        if rng.random() < 0.03:
            now = rng.randrange(k)
        for j in range(k):
            scores[t, j] = rng.gauss(1.5 if j == now else 0, 2)
    path = language.best_path(scores, 6.0).tolist()
    assert abs(plain_value(scores.tolist(), path, 6.0) - plain_best(scores.tolist(), 6.0)) < 1e-9


def test_words_of_texts():
    points, kinds, firsts = language._words("Ab, c1d ΩЖ!")
    assert "".join(map(chr, points)) == " ab c d ωж "
    assert [language.NAMES[k] if k >= 0 else " " for k in kinds][-3:] == ["greek", "cyrillic", " "]
    assert firsts.tolist() == [1, 4, 6, 8]
    assert len(language._words("12 .. ")[0]) == 0


def test_letters_of_all_planes():
    points, kinds, firsts = language._words("\U00020000\U00020001 \U00010400 \U0001F600 a")
    assert "".join(map(chr, points)) == " \U00020000\U00020001 \U00010428 a "
    assert [language.NAMES[kinds[i]] for i in firsts] == ["han", "other", "latin"]


def test_very_long_text_is_labelled_whole(spark):
    model = registry.language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 600 and text not like '%!!%'")
    pick = {r.lang: " ".join(r.text.split()[:60]) for r in docs.orderBy("doc_id").collect()}
    long = f"{pick['en']} " * 500 + f"{pick['de']} " * 1500
    assert language.predict(long, model)[0] == "de"
    assert [s[0] for s in language.spans(long, model)] == ["en", "de"]


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op7_language"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_mixed_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = registry.language_model(docs)
    pick = {r.lang: r.text for r in docs.where("length(text) > 600 and text not like '%!!%'").orderBy("doc_id").collect()}
    en, de = (" ".join(pick[k].split()[:60]) for k in ("en", "de"))
    found = language.spans(f"{en} {de}", model)
    assert [s[0] for s in found] == ["en", "de"] and abs(found[1][1] - 60) < 8
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !? \n", "x"), (None, en, None), (4, en, "x"), (4, en, "x"), (5, "Ωμέγα", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = language.identify(odd, model, ["doc_id"], "doc_id bigint").collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got)[:6] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert {r.doc_id: r.lang_pred for r in got}[5] in model.names
    assert language.identify(odd.limit(0), model, ["doc_id"], "doc_id bigint").collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, "text", "lang")
    assert [tuple(r) for r in language.identify(docs, model, ["doc_id"], "doc_id bigint").orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]


def test_learns_from_all_rows(spark):
    """More rows of a language than a sample would hold: every one of them counts."""
    rng = random.Random(4)
    rows = [(lang, " ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(5))) for lang, letters in (("a", "abcdefgh"), ("b", "efghijklmno")) for _ in range(2500)]
    params = language.LanguageParams()
    model = language.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3), "text", "lang")
    found = np.zeros((params.buckets, 2))
    for lang, text in rows:
        found[:, "ab".index(lang)] += np.bincount(language._trigrams(language._words(text)[0], params.buckets), minlength=params.buckets)
    rate = (found + params.smoothing) / (found.sum(axis=0) + params.smoothing * params.buckets)
    ratio = np.clip(np.log(rate) - np.log(rate.mean(axis=1, keepdims=True)), -params.cap, params.cap)
    assert np.allclose(model.scores, np.where(found.sum(axis=1, keepdims=True) > 0, ratio, 0.0), atol=1e-6)
