"""Every stage of the pipeline against a plain version on its own input; what comes out in the end."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_simhash import plain_fingerprint, plain_groups
from traffic_risk.llm import pieces, registry, secret_scan

SF = "/root/testdata/sf0.001"
LETTER = re.compile(r"[^\W\d_]")


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage, by name."""
    out, docs = {}, registry.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_stages_return_the_columns_of_documents(steps):
    for name in list(steps)[:-1]:
        assert steps[name][3] == steps[name][2], name


def test_language_stage(steps):
    before, after, *_ = steps["language"]
    kept = {r.doc_id for r in after}
    assert kept <= {r.doc_id for r in before}
    assert all(r.doc_id in kept for r in before if len(LETTER.findall(r.text or "")) > 60)
    assert not any(r.doc_id in kept for r in before if not LETTER.search(r.text or ""))


def test_near_copies_stage(steps):
    """Of every group of fingerprints that links of two bits hold together, the smallest id stays."""
    before, after, *_ = steps["near_copies"]
    groups = plain_groups([(r.doc_id, plain_fingerprint(r.text)) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(groups.values()))
    assert len(after) < len(before)


def test_benchmark_stage(spark, steps):
    before, after, *_ = steps["benchmark"]
    items = [r.text for r in registry.table(spark, SF, "benchmark").collect()]
    leaky = {r.doc_id for r in before if any(t in r.text for t in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert leaky and leaky <= gone and len(gone) <= len(leaky) + 2


def test_secrets_stage(steps):
    before, after, *_ = steps["secrets"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        spans, text, end = sorted(s[1:3] for s in secret_scan.scan(r.text)), "", 0
        for a, b in spans:
            text += r.text[end:a] + ("<SECRET>" if a >= end else "")
            end = max(end, b)
        assert texts[r.doc_id] == text + r.text[end:]
    assert all(r.n_chars == len(r.text) for r in after)


def test_pieces_stage(steps):
    before, after, *_ = steps["pieces"]
    vocab = pieces.Vocabulary.load(registry.PIECES)
    assert {r.doc_id: pieces.decode(r.ids, vocab) for r in after} == {r.doc_id: r.text for r in before}


def test_registered_and_repeatable(spark, steps):
    rows = entry.queries()["pipeline"](spark, SF).collect()
    assert sorted(rows) == sorted(steps["pieces"][1])


def test_empty_documents(spark):
    docs = registry.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == [], name


ODD = {"blob": "b", "spans": "s", "_row": "r", "_salt": "t", "fp": "f", "root": "o", "place": "p", "_text": "x", "lang_pred": "l", "lang_share": "h", "item": "i", "Leaks": "k"}


def test_stages_with_odd_rows_and_clashing_columns(spark):
    """Rows without id, repeated rows, empty and null texts, columns of the operators' own names: the stages keep what they should."""
    docs = registry.table(spark, SF, "documents")
    some = {r.doc_id: r for r in docs.where("lang = 'en' AND length(text) BETWEEN 800 AND 4000 AND text NOT LIKE '%!!%'").orderBy("doc_id").limit(12).collect()}
    texts = [r.text for r in some.values()]
    item = registry.table(spark, SF, "benchmark").orderBy("item_id").first().text
    leak = f"{texts[0]} {item} {texts[1]}"
    secret = f"{texts[2]} password = hunter2hunter2 {texts[3]}"
    rows = [(None, leak), (None, texts[4]), (None, secret), (1, texts[5]), (1, texts[5]), (1, texts[6]), (2, None), (3, ""), (4, texts[5]), (5, leak)]
    full = [(i, t, "en", None, len(t or ""), *ODD.values()) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(full, ", ".join([names, *[f"`{c}` string" for c in ODD]]))
    for c in ("lang", "n_chars", "source"):
        frame = frame.withColumn(c, frame[c].cast(docs.schema[c].dataType))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, frame, SF), name)
        assert out.columns == frame.columns, name
        assert all(r[c] == v for r in out.collect() for c, v in ODD.items()), name
        frame = out
    found = [(r.doc_id, r.text) for r in frame.collect()]
    masked = secret.replace("password = hunter2hunter2", "<SECRET>")
    assert sorted(found, key=repr) == sorted([(None, texts[4]), (None, masked), (1, texts[5]), (1, texts[6])], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == 4
