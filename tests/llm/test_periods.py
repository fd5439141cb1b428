"""Periodic runs against a search of every period, by themselves and as the query over a whole table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from snapledger.llm import periods, queries


def brute(w, exponent=4, least=6):
    """Stretches that agree with themselves a period on, the smallest period of each."""
    ids = np.unique(np.array([hash(x) for x in w], np.int64), return_inverse=True)[1]
    found = {}
    for q in range(1, len(w) // exponent + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s + q >= max(least, exponent * q):
                found.setdefault((int(s), int(e - s + q)), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plant(doc, w):
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def row(doc, w):
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc, len(runs), *best, milli, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, testdata, sf):
    got = queries.QUERIES["op12_periodic_runs"](spark, f"{testdata}/{sf}")
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    docs = spark.read.parquet(f"{testdata}/{sf}/documents.parquet").collect()
    want = sorted(row(r.doc_id, plant(r.doc_id, words(r.text))) for r in docs)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] for r in want)


def test_awkward_texts(docs, nothing):
    """Ids without a plan too: null texts, no words, one long text, repeated rows, a null id, clashing columns."""
    shown = docs.select("doc_id", periods.planted(docs.doc_id, docs.text).alias("text"))
    got = periods.digest(periods.find_runs(shown.unionAll(shown))).collect()
    want = [row(r.doc_id, plant(r.doc_id, words(r.text))) for r in docs.collect()] * 2
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert periods.digest(periods.find_runs(docs)).count() == docs.count()
    assert periods.digest(periods.find_runs(nothing)).count() == 0


def test_own_columns_and_floors(spark):
    df = spark.createDataFrame([(5, "a b a b a c c", "x")], "key long, body string, runs string")
    found = periods.find_runs(df, "key", "body", exponent=2, least=2).first()
    assert [tuple(r) for r in found.runs] == [(0, 5, 2), (5, 2, 1)] and bytes(found.collapsed) == b"a b c"
    assert periods.find_runs(df, "key", "body", collapse=False).first().collapsed is None
    with pytest.raises(ValueError):
        periods.find_runs(df, "key", "body", exponent=1)


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 5)])
def test_random_words(exponent, least):
    rng = random.Random(exponent)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.randint(0, 60), rng.randint(1, 4)
            w = [b"%d" % rng.randint(0, kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, (n - a) // 3 + 1)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(w)
        ids, ends = periods._numbered(texts)
        size = np.diff(np.append(0, ends))
        got = zip(*(x.tolist() for x in periods.runs(ids, np.repeat(ends, size), exponent, least)), strict=True)
        want = [(s + e - len(w), n, q) for w, e in zip(texts, ends.tolist(), strict=True) for s, n, q in brute(w, exponent, least)]
        assert list(got) == want


def test_a_very_long_text():
    base = [b"w%d" % (i % 1000) for i in range(300_000)]
    ids, ends = periods._numbered([base, [b"x"] * 50_000])
    got = [x.tolist() for x in periods.runs(ids, np.repeat(ends, [300_000, 50_000]))]
    assert got == [[0, 300_000], [300_000, 50_000], [1000, 1]]
