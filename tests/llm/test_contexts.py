"""Contexts of repeated windows: equal ones of a batch collapse, in little memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from snapledger.llm import substrings


def _batch(texts, ids):
    names = []
    for t in texts:
        data = np.frombuffer(t.encode() + bytes(8), np.uint8)
        names.append(np.unique(substrings.runs(data, np.array([0, len(data) - 8]))[0]).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(names, pa.list_(pa.int64()))], names=["doc", "text", "names"])


@pytest.mark.parametrize("held", [1 << 25, 0])
def test_contexts_leave_some_at_a_time(monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD", held)
    monkeypatch.setattr(substrings, "ROWS", 10)
    rng = np.random.default_rng(1)
    passage = "".join(map(chr, rng.integers(97, 123, 400)))
    own = ["".join(map(chr, rng.integers(97, 123, 300))) for _ in range(6)]
    texts = [a + passage + b for a, b in zip(own, own[1:], strict=False)] + ["zq" * 200 + passage]
    ids = [9, 3, 7, 5, 8, 4]
    parts = list(substrings._contexts(iter([_batch(texts, ids)])))
    assert max(p.num_rows for p in parts) <= 10
    rows = [r for p in parts for r in p.to_pylist()]
    text, least = dict(zip(ids, texts, strict=True)), {}
    # One row per run of windows, none lost, and the bytes are where they are said to be.
    want = 0
    for t in texts:
        data = np.frombuffer(t.encode() + bytes(8), np.uint8)
        want += len(substrings.runs(data, np.array([0, len(data) - 8]))[0])
    assert len(rows) == want
    for r in rows:
        raw = text[r["doc"]][r["place"] : r["place"] + r["n"] - 1 + substrings.LENGTH].encode()
        assert r["bytes"] in (None, raw)
        least[raw] = min(least.get(raw, (99, 0)), (r["doc"], r["place"]))
        assert r["key"] == substrings.runs(np.frombuffer(raw + bytes(8), np.uint8), np.array([0, len(raw)]))[0].astype(np.int64)[0]
    # The earliest of equal ones alone has bytes.
    with_bytes = [(r["bytes"], (r["doc"], r["place"])) for r in rows if r["bytes"] is not None]
    assert len(least) < len(rows) and len(with_bytes) == len(least) and dict(with_bytes) == least


def _rise(make):
    """How much a step adds to what Python holds at most, in bytes; numpy's arrays are counted."""
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    for _ in make():
        pass
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top - before


def test_memory_of_a_batch_is_bounded():
    """Steps over a batch of 10 MB: neither its text is copied nor are its windows named in one go."""
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, 10_000_000).astype(np.uint8).tobytes().decode()
    texts = [letters[i : i + 20_000] for i in range(0, len(letters), 20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])
    names = pa.array([[0]] * len(texts), pa.list_(pa.int64()))  # of none of them
    wanted = pa.RecordBatch.from_arrays([*batch.columns, names], names=["doc", "text", "names"])
    assert _rise(lambda: substrings._contexts(iter([wanted]))) < 60_000_000
    assert _rise(lambda: substrings._names(iter([batch]), 8)) < 120_000_000


def test_names_told_in_parts_are_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    own = ["".join(map(chr, rng.integers(97, 123, 300))) for _ in range(6)]
    texts = [a + b for a in own for b in own] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc", "text"])

    def common():
        told = pa.Table.from_batches(substrings._names(iter([batch]), 4))
        parts = [substrings._common(told.filter(pc.equal(told["bucket"], b))).to_pylist() for b in range(4)]
        known = told.filter(pc.equal(told["bucket"], -1)).select(["names", "docs"]).to_batches()
        return {(r["doc"], r["name"]) for p in parts for r in p} | {(r["doc"], r["name"]) for b in substrings._known(known) for r in b.to_pylist()}

    whole = common()
    monkeypatch.setattr(substrings, "NAMED", 1000)
    monkeypatch.setattr(substrings, "PIECE", 1000)
    assert whole and common() == whole


def test_cut_and_sorted_parts(spark, monkeypatch):
    """Parts of any size give the same rows, and the kept bytes come only where they are asked for."""
    rng = np.random.default_rng(5)
    own = ["".join(map(chr, rng.integers(97, 123, 150))) for _ in range(5)]
    rows = [(i, own[i % 5] + own[i % 3] + str(i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.doc: r for r in substrings.remove_repeats(docs, texts=True).collect()}
    bare = {r.doc: r for r in substrings.remove_repeats(docs).collect()}
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert all(getattr(bare[i], c) == getattr(want[i], c) for i in want for c in columns) and len(bare) == len(want) == 30
    assert sum(r.kept is not None for r in want.values()) > 10
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2], "text": ["a" * 200, "b" * 200], "ranges": [[{"first": 1, "last": 100}], [{"first": 0, "last": 0}]]})
    for texts in (True, False):
        for size in (1, 1000):
            monkeypatch.setattr(substrings, "CUT", size)
            (a, b) = [r for part in substrings._cut(iter([batch]), texts) for r in part.to_pylist()]
            assert (a["n_removed"], b["n_removed"], a["kept"], b["kept"]) == (199, 100, b"a" if texts else None, b"b" * 100 if texts else None)
