"""Line removal against brute force, and its filters by themselves."""

import collections
import hashlib
import random

import numpy as np
import pytest
from snapledger.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, least=10):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if doc is None or len(key(x)) < least or min(holders[key(x)]) == doc]
        out.append((doc, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in lines.drop_repeated_lines(df, **options).collect()), key=repr)


def test_awkward_texts(docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs) == brute(rows)
    assert lines.drop_repeated_lines(nothing).count() == 0


@pytest.mark.parametrize("held", [4, lines.HELD])
def test_random_lines(spark, held):
    rng = random.Random(held)
    pool = [f"{'É' * rng.randint(0, 9)} shared line {i}" for i in range(40)] + ["kurz", "123456789", "ééééééééé", "1234567890", "éééééééééé"]
    hot = "this line is in every third document"

    def line():
        own = rng.choice(pool) if rng.random() < 0.5 else f"line of its own {rng.random()}"
        return rng.choice(["", " ", "\t"]) + rng.choice([own, own.upper(), own.lower()]) + rng.choice(["", "\r", "  ", "\x0b"])

    rows = [(i, "\n".join([line() for _ in range(rng.randint(0, 8))] + [hot] * (i % 3 == 0))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, "a text under the same id\n" + hot), (None, hot), (None, hot), (301, None), (302, "\n\n"), (-4, hot + "\n" + hot)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), held=held) == brute(rows)


def test_texts_and_long_ones(spark):
    long = "\n".join(f"a line {i} of a very long text" for i in range(40_000))
    df = spark.createDataFrame([(1, long, 1), (2, long + "\nand its own last line", 2)], "id long, body string, doc int")
    got = {r.doc: r for r in lines.drop_repeated_lines(df, id="id", text="body", texts=True).collect()}
    assert (got[1].n_dropped, bytes(got[1].kept).decode()) == (0, long)
    assert (got[2].n_dropped, bytes(got[2].kept).decode()) == (40_000, "and its own last line")


def test_filter_never_forgets():
    raw = np.random.default_rng(0).integers(0, 256, (5000, lines.DIGEST), dtype=np.uint8)
    bloom = lines.Bloom(5000)
    bloom.add(raw[:2500])
    assert bloom.knows(raw[:2500]).all()
    assert bloom.knows(raw[2500:]).mean() < 0.01
