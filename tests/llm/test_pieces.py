"""Segmentations against enumeration of all of them; exact round trips."""

import pytest

from traffic_risk.llm import pieces, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary.load(registry.PIECES)


def every(part, vocab):
    """All segmentations of a text without cuts, with their scores."""
    if not part:
        return [(0.0, ())]
    out = []
    for n in range(1, len(part) + 1):
        found = vocab.pieces.get(part[:n], (-1, 0))
        heads = [(found[1], (found[0],))] if found[0] >= 0 else []
        if n == 1 and not heads:
            ids = tuple(vocab.bytes_[b] for b in part[0].encode())
            heads = [(sum(vocab.scores[i] for i in ids), ids)]
        for score, ids in heads:
            out += [(score + s, ids + i) for s, i in every(part[n:], vocab)]
    return out


@pytest.mark.parametrize("part", [" worthless", " the", "a", "ﷺb", "  x", " été", " öffnen.$$", "\n", "▁", "日本語", "zzzzzzz"])
def test_parts(vocab, part):
    want = sorted(every(part, vocab), reverse=True)
    got = pieces.n_best(part, vocab, 6)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]])
    assert len({ids for _, ids in got}) == len(got)
    assert {ids for _, ids in got} <= {ids for _, ids in want}
    ids, score, loss = pieces.viterbi(part, vocab)
    assert score == pytest.approx(want[0][0])
    assert loss == pytest.approx(want[0][0] - want[1][0] if len(want) > 1 else float("inf"))


@pytest.mark.parametrize("text", ["of it", "a b a", "we of\nus", "on on on", "x  y"])
def test_texts(vocab, text):
    encoder = pieces.Encoder(vocab, 5)
    combined = [(0.0, ())]
    for part in encoder.cut(text):
        combined = [(a + b, x + y) for a, x in combined for b, y in every(part, vocab)]
    want = sorted((s for s, _ in combined), reverse=True)[:5]
    got = encoder.n_best(text)
    assert [s for s, _ in got] == pytest.approx(want)
    assert len({tuple(i) for _, i in got}) == len(got)
    assert all(pieces.decode(ids, vocab) == text for _, ids in got)


def test_no_piece_crosses_a_cut(vocab):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=registry.PIECES)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    assert {i for i, _ in vocab.pieces.values() if i >= 0} == set(usable)


def test_words_together_are_words_one_by_one(vocab):
    import random

    from traffic_risk.llm.piece_lattice import Tree, segment_all

    rng = random.Random(2)
    syllables = ["tion", "er", "éa", "ou", "x", "ß", "the", "日", "ing", "$$", "7", "q", "😀", "."]
    words = {" " * rng.randrange(3) + "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) for _ in range(4000)}
    got = segment_all(sorted(words), Tree.of(vocab.pieces))
    assert len(got) > 0.4 * len(words)
    for word, found in got.items():
        assert found == pieces.viterbi(word, vocab), word  # to the last bit: results do not depend on the batch
    without = {w for w in words if any(vocab.pieces.get(c, (-1,))[0] < 0 for c in w)}
    assert not without & set(got)
    small = Tree.of({"a": (0, -1.0), "ab": (1, -1.5), "b": (2, -1.0)})
    assert segment_all(["ab"] * 20 + ["zz"] * 20, small) == {"ab": ((1,), -1.5, 0.5)}


def test_all_segmentations_are_those_of_the_encoder(spark, vocab):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pieces.all_segmentations(pieces.encode_texts(docs, registry.PIECES, n=5)).collect()
    encoder = pieces.Encoder(vocab, 5)
    for r in rows:
        want = encoder.n_best(texts[r.doc_id]) if texts[r.doc_id] else [(0.0, [])]
        assert [list(s) for s in r.segmentations] == [ids for _, ids in want]
        assert [r.scores[0], *[o.score for o in r.others]] == list(r.scores) == pytest.approx([s for s, _ in want])
        assert all(pieces.decode(list(s), vocab) == texts[r.doc_id] for s in r.segmentations)


def test_memory_of_parts_is_bounded(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 50)
    encoder = pieces.Encoder(vocab, 3)
    for k in range(20):
        encoder.learn([[f" w{k}x{j}" for j in range(30)]])
        assert len(encoder.known) <= 80
        assert all(f" w{k}x{j}" in encoder.known for j in range(30))


def test_whole_table(spark, vocab):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op9_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.exact and r.n_pieces == len(r.ids)
        assert pieces.decode(r.ids, vocab) == texts[r.doc_id]
        assert list(r.scores) == sorted(r.scores, reverse=True)


def test_odd_rows(spark, vocab):
    texts = [None, "", " ", "\n\n", "▁▁ ▁a", "  two  blanks  ", "\x00\t😀é", "x" * 5000, "a" + " " * 3000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a", "z"), (1, "", "z")], "doc_id long, text string, ids string")
    rows = pieces.encode_texts(docs, registry.PIECES).collect()
    assert len(rows) == len(texts) + 2 and all(r.exact for r in rows)
    by = {r.doc_id: r for r in rows}
    assert list(by[0].ids) == [] and list(by[0].scores) == [0.0]
    assert all(pieces.decode(by[i].ids, vocab) == (t or "") for i, t in enumerate(texts))
    assert pieces.encode_texts(docs.limit(0), registry.PIECES).collect() == []


def test_worker_memory(spark, vocab):
    """Parts of texts are not held all at once, and another operator lets go of what a worker remembers."""
    import tracemalloc

    from traffic_risk.llm import common

    texts = [" ".join(f"t{i % 50}" for i in range(1000)) for _ in range(200)]
    encoder = common.remembered("one", lambda: pieces.Encoder(vocab, 3))
    assert common.remembered("one", list) is encoder
    encoder.learn([encoder.cut(texts[0])])
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)

    def count(key):
        """How many operators a worker remembers something for, in a task of one that does so, too."""

        def run(batch, texts):
            common.remembered(key, list)
            return [[len(common._REMEMBERED)] * len(texts)]

        return common.map_texts(docs, ["doc_id"], "text", run, "n long", remembers=key).head()[0]

    assert count("two") == count("three") == count("four") == 1
    tracemalloc.start()
    try:
        encoder.learn(map(encoder.cut, texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1 << 20  # the parts of all texts take over ten times that
    common.forget("one")
    assert common.remembered("one", list) is encoder
    common.forget()
    assert "one" not in common._REMEMBERED


def test_texts_are_cut_together(vocab):
    import random

    import pyarrow as pa

    rng = random.Random(3)
    signs = [" ", " ", "\n", "▁", "a", "b", "é", "■", "–", "日", "😀", "\t", "\r"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(8))) for _ in range(3000)] + ["", " ", "▁", "\n", "a▁"]
    encoder = pieces.Encoder(vocab, 2)
    for some in (texts, texts[5:90], [""], ["", "", "▁"], ["x"], []):
        for kind in (pa.string(), pa.large_string()):
            words, which, sizes = pieces.cut_all(pa.array(["left out", *some], kind).slice(1))
            ends = [sum(sizes[:k]) for k in range(len(sizes) + 1)] if len(some) < 100 else [0, *sizes.cumsum().tolist()]
            assert [[words[w] for w in which[a:b]] for a, b in zip(ends, ends[1:], strict=False)] == [encoder.cut(t) for t in some]


def test_misspelled_parts_are_found(vocab):
    encoder = pieces.Encoder(vocab, 2)
    ids = {p: encoder.best(p)[0] for p in [" the", " off", "日本", "\n"]}
    right = list(ids.values())
    for found, want in (
        (right, [False] * 4),
        ([right[0], right[0], right[2], right[3]], [False, True, False, False]),
        ([right[0], right[1], right[0], right[3]], [False, False, True, False]),
        ([right[0], right[1], (), right[3] * 2], [False, False, True, True]),
    ):
        paths = pieces.Paths.of([(i, 0.0, 0.0) for i in found])
        assert encoder.misspelled(list(ids), paths).tolist() == want


def test_work_in_python_grows_with_different_parts(spark, vocab):
    """Parts that occur again cost no Python calls of their own."""
    import cProfile
    import pstats

    def calls(times, monkeypatch):
        caught = []
        monkeypatch.setattr(pieces, "map_texts", lambda docs, keys, text, fn, *_: caught.append(fn))
        docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
        pieces.encode_texts(docs, registry.PIECES, n=3)
        texts = [" ".join([*words] * times) + near for _ in range(20)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], ["doc_id", "text"])
        profile = cProfile.Profile()
        out = profile.runcall(caught[0], batch, texts)
        assert [len(i) for i in out[1].to_pylist()] == [n.as_py() for n in out[2]]
        return pstats.Stats(profile).total_calls

    import pyarrow as pa

    # the parts whose second segmentation loses least come last
    encoder = pieces.Encoder(vocab, 3)
    words = sorted([f"w{i}" for i in range(40)], key=lambda w: -encoder.best(f" {w}")[2])
    near = " " + " ".join(words[-2:] * 2)
    words = words[:20] * 5
    with pytest.MonkeyPatch.context() as m:
        calls(1, m)
        few, many = calls(1, m), calls(20, m)
    assert many < few + 20 * 19 * len(words) / 10
