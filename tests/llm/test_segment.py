"""Plain encoding and decoding, the lattices they share with sampling, and the query over a whole table."""

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from snapledger.llm import queries, segment

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def v():
    return segment.vocabulary(MODEL)


def paths(v, word):
    """All segmentations of a word with their log-probabilities, of characters that have pieces."""
    cost = {v.pieces[i]: (int(i), float(c)) for i, c in _plain(v)}

    def rest(at):
        if at == len(word):
            yield 0.0, []
        for n in range(1, min(v.longest, len(word) - at) + 1):
            if (own := cost.get(word[at : at + n])) is not None:
                for lp, ids in rest(at + n):
                    yield own[1] + lp, [own[0], *ids]

    return list(rest(0))


def _plain(v):
    s = v.spellings
    return [(i, c) for i, c in zip(s.piece, s.cost, strict=True) if i >= 0]


def test_best_path_and_sums(v):
    words = ["▁the", "▁cab", "▁a", "▁▁on", "▁tener", "▁niño"]
    ids, logp = v.best(words)
    v.reset()
    base = v.look_up(words)
    for w, own, lp, state in zip(words, ids, logp, base.tolist(), strict=True):
        every = paths(v, w)
        best = max(x for x, _ in every)
        assert lp == pytest.approx(best) and any(x == pytest.approx(best) and y == own.tolist() for x, y in every)
        # The first node's edges have the chances that all segmentations give them.
        total = sum(math.exp(x) for x, _ in every)
        for e in range(v.first[state], v.first[state + 1]):
            share = sum(math.exp(x) for x, y in every if y[0] == v.id[e]) / total
            assert math.exp(v.logp[e]) == pytest.approx(share, abs=1e-12)


def test_encoding_comes_back(spark, docs, texts, nothing):
    found = segment.encode(docs, MODEL)
    back = {r.doc: r.text for r in segment.decode(found, MODEL).collect()}
    assert {i: back[i] for i in texts} == texts
    assert found.count() == docs.count() and segment.encode(nothing, MODEL).count() == 0
    likeliest = {r.doc: r.log_prob for r in found.collect()}
    drawn = segment.segmentations(docs, MODEL, k=2).collect()
    assert all(len(r.ids) >= 1 for r in drawn) and all(likeliest[r.doc] <= 0 for r in drawn)


def test_encoding_leaves_the_lattices_of_sampling_alone(v):
    """Both spell characters without a piece in bytes; a worker process serves both."""
    text, keys = "a 😀 b 🚀", np.array([5], np.uint64)
    v.reset()
    want = [x[3].tolist() for x in segment.sample(v, [text], keys, 2)[0]]
    batch = pa.RecordBatch.from_pydict({"doc": [1], "text": ["🐍 other 💧"]})
    (found,) = segment._encode(iter([batch]), MODEL)
    assert v.decode(found.column("ids")[0].as_py()) == "🐍 other 💧"
    again = segment.sample(segment.vocabulary(MODEL), [text], keys, 2)[0]
    assert [x[3].tolist() for x in again] == want and all(v.decode(ids) == text for ids in want)


def test_results_do_not_depend_on_neighbours(v):
    texts = ["one two three", "ein, zwei, drei ö\U0001f600", "x" * 300]
    keys = np.array([5, 6, 7], np.uint64)
    v.reset()
    together = segment.sample(v, texts, keys, 3)
    for i, text in enumerate(texts):
        v.reset()
        alone = segment.sample(v, [text], keys[i : i + 1], 3)[0]
        assert [x[3].tolist() for x in alone] == [x[3].tolist() for x in together[i]]
        assert [x[0] for x in alone] == pytest.approx([x[0] for x in together[i]])


def test_memory_is_bounded_by_bytes(v, monkeypatch):
    monkeypatch.setattr(segment, "CACHE", 5000)
    v.reset()
    for lo in range(0, 20_000, 500):
        segment.sample(v, [" ".join(f"word{i}" for i in range(lo, lo + 500))], np.array([1], np.uint64), 1)
        assert v._edges < 5000 + 500 * 60
    monkeypatch.undo()
    v.reset()


def test_query(spark, testdata):
    rows = queries.QUERIES["op10_sentencepiece_sampling"](spark, f"{testdata}/sf0.001").collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{testdata}/sf0.001/documents.parquet").select("doc_id").collect()]
    assert {r.doc_id for r in rows} == set(ids) and all(r.decoded for r in rows)
    assert {(r.doc_id, r["sample"]) for r in rows} >= {(i, 0) for i in ids}


def test_words_of_a_batch_are_numbered_once(v, monkeypatch):
    """No object a word: ordinary texts' words reach the lattices as the distinct ones, and others as ``words_of`` cuts them."""
    rng = np.random.default_rng(2)
    texts = ["", " ", "a", " a", "a ", "a  b", "▁", "a ▁ b", "a▁b c", "tab\tand\nline", "ü 😀 ü", "  x", "x\x00y x\x00y"]
    texts += ["".join(rng.choice(list("ab é▁\n"), 30)) for _ in range(60)] + ["same words same words " * 50 + "end"]
    asked, look_up = [], v.look_up
    monkeypatch.setattr(v, "look_up", lambda words: (asked.extend(words), look_up(words))[1], raising=False)
    v.reset()
    split = [segment.words_of(t) for t in texts]
    n, nodes = segment._nodes(v, texts)
    assert n.tolist() == [len(ws) for ws in split]
    assert nodes.tolist() == [v.known[w] for ws in split for w in ws]
    assert asked.count("▁same") == 1 and set(asked) == {w for ws in split for w in ws}
    assert [x.tolist() for x in segment._nodes(v, [])] == [[], []]


def test_pieces_and_texts_of_many_at_once(v):
    texts = ["plain words", "😀", "", "a 🚀 b �", "▁x", "last"]
    v.reset()
    found = segment.sample(v, texts, np.arange(len(texts), dtype=np.uint64), 3)
    paths = [x[3] for own in found for x in own]
    assert all(v.decode(p.tolist()) == t for t, own in zip(texts, found, strict=True) for *_, p in own)
    cuts = np.cumsum([0, *map(len, paths)])
    assert v.decodes(np.concatenate(paths), cuts) == [t for t, own in zip(texts, found, strict=True) for _ in own]
    assert v.decodes(np.array([], np.int32), np.array([0])) == []
    batch = pa.RecordBatch.from_arrays([pa.array([3, None, 3, 4]), pa.array(["a 😀", None, "a 😀", "▁ b"])], names=["doc", "text"])
    (out,) = segment._segment(iter([batch]), MODEL, 2, 0, True)
    rows = out.to_pylist()
    assert all(r["decoded"] and r["n_pieces"] == len(r["ids"]) for r in rows) and [r["doc"] for r in rows] == [3, 3, None, 3, 3, 4, 4]
    (bare,) = segment._segment(iter([batch]), MODEL, 2, 0, False)
    assert bare.column("decoded").null_count == len(rows) and bare.column("ids") == out.column("ids")
