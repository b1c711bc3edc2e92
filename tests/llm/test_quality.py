"""Base counts against a plain version, ratios against plain sums, verdicts on labelled rows."""

import re
from collections import Counter

from pyspark.sql import functions as F

from traffic_risk.llm import quality, registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed
        assert not (r.kept and failed)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(registry.QUERIES["op10_quality"](spark, SF).collect(), texts)


def test_odd_texts(spark):
    texts = [
        None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l one\n\nl one\n \n l one\nl one",
        "é\x0bü\x0cß \r\n# * $", "a b c d " * 400, " ".join(map(str, range(3000))), "a b a b a b a",
        "p q r s p q r t q r s", "\x1c \x85    ",
    ]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, score int, words string")
    none = spark.createDataFrame([], "doc_id long")
    got = quality.rate_quality(docs, none)
    check(got.collect(), dict(rows))
    assert got.where("NOT base_failed AND NOT kept").count() == 0


def test_ratios_against_plain_sums(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (None, "a"), (4, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    params = quality.QualityParams(buckets=16)
    got = quality.fit_ratios(docs, trusted, "doc_id", "text", params)

    def buckets(words):
        grams = [(w,) for w in words] + list(zip(words, words[1:]))
        if not grams:
            return []
        row = spark.range(1).select(*[F.pmod(F.xxhash64(*map(F.lit, g)), F.lit(16)) for g in grams]).first()
        return list(row)

    raw, target = Counter(), Counter()
    for doc, t in ((1, "a b a"), (2, "b c"), (None, "a")):
        raw.update(buckets(t.split()))
        if doc == 1:
            target.update(buckets(t.split()))
    import math

    r, t = sum(raw.values()) + 16, sum(target.values()) + 16
    want = [math.log((target[b] + 1) / t) - math.log((raw[b] + 1) / r) for b in range(16)]
    assert all(abs(x - y) < 1e-3 for x, y in zip(got, want))


def test_labelled_rows(spark):
    """Trusted rows stay; most rows labelled as poor go."""
    sf = "/root/testdata/sf0.01"
    rated = registry.QUERIES["op10_quality"](spark, sf).where("NOT base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.quality: r for r in rated.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    print(found)
    assert found[1].kept > 0.99
    assert found[0].kept < 0.5


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.rate_quality(docs, docs.select("doc_id")).collect() == []


def test_nearly_all_poor_rows_go(spark):
    sf = "/root/testdata/sf0.01"
    rated = registry.QUERIES["op10_quality"](spark, sf).where("NOT base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = F.avg(F.col("kept").cast("int")).alias("kept")
    found = {r.quality: r.kept for r in rated.join(labels, "doc_id").groupBy("quality").agg(kept).collect()}
    print(found)
    assert found[1] > 0.99
    assert found[0] < 0.05
