"""Moves, shared content, space and growth, against plain Python."""

import collections
import random

import pytest
import snapledger as sl
from pyspark.sql import functions as F
from snapledger.operators import moves, skew


def snapshot(rng, hashes, n, hot=0.0):
    paths = rng.sample([f"{a}/{b}/{c}" for a in "abcd" for b in "xyz" for c in range(40)] + ["top"], n)
    rows = [(p, "hot" if rng.random() < hot else rng.choice(hashes), rng.randint(0, 9)) for p in paths]
    return rows


def matched(old, new):
    """Removed and added rows, paired in path order within a hash."""
    gone = sorted(r for r in old if r[0] not in {p for p, h, _ in new if h is not None})
    come = sorted(r for r in new if r[0] not in {p for p, h, _ in old if h is not None})
    held = collections.defaultdict(lambda: ([], []))
    out = []
    for side, rows in enumerate((gone, come)):
        for path, h, size in rows:
            if h is None:
                out.append(("added" if side else "removed", None, size, *((None, path) if side else (path, None))))
            else:
                held[h][side].append((path, size))
    for h, (a, b) in held.items():
        n = min(len(a), len(b))
        out += [("moved", h, y[1], x[0], y[0]) for x, y in zip(a[:n], b[:n])]
        out += [("removed", h, s, p, None) for p, s in a[n:]] + [("added", h, s, None, p) for p, s in b[n:]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [3, skew.MAX_HOT_KEYS])
@pytest.mark.parametrize("seed", [1, 2])
def test_moves(frame, monkeypatch, seed, limit):
    """Whether a hash is hot changes the plan, never the rows."""
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", limit)
    rng = random.Random(seed)
    hashes = [str(i) for i in range(12)] + [None]
    old, new = snapshot(rng, hashes, 200, 0.4), snapshot(rng, hashes, 150, 0.4)
    got = sl.moves(frame(*old), frame(*new))
    assert got.columns == ["change", "hash", "file_size_bytes", "from_relative_path", "to_relative_path"]
    assert sorted(map(tuple, got.collect()), key=repr) == matched(old, new)


def test_moves_between_volumes(spark):
    schema = "volume string, relative_path string, hash string, file_size_bytes long"
    old = spark.createDataFrame([("d1", "a", "1", 5), ("d1", "b", "2", 6), ("d2", "c", "3", 7)], schema)
    new = spark.createDataFrame([("d2", "a", "1", 5), ("d1", "b", "2", 6), ("d2", "d", "3", 7), ("d2", "b", "2", 6)], schema)
    got = sl.moves(old, new, within=["volume"]).select("change", "from_volume", "from_relative_path", "to_volume", "to_relative_path")
    assert sorted(map(tuple, got.collect())) == [
        ("added", None, None, "d2", "b"),
        ("moved", "d1", "a", "d2", "a"),
        ("moved", "d2", "c", "d2", "d"),
    ]


def test_moves_of_nothing(frame):
    some, none = frame(("a", "1", 1), (None, "1", 1)), frame()
    assert sl.moves(none, none).collect() == []
    assert {r[0] for r in sl.moves(some, none).collect()} == {"removed"}
    assert {r[0] for r in sl.moves(none, some).collect()} == {"added"}


def test_a_hot_hash_is_numbered_by_all_tasks(spark, conf):
    """A hash that holds all rows: no range of the order has most of them."""
    conf("spark.sql.shuffle.partitions", "8")
    rows = spark.range(4000).select((F.col("id") % 2 == 0).alias("gone"), F.lit("h").alias("hash"), F.col("id").cast("string").alias("relative_path"))
    got = moves._numbered(rows, ["relative_path"])
    want = {(g, p): i + 1 for g in (True, False) for i, p in enumerate(sorted(str(x) for x in range(4000) if (x % 2 == 0) == g))}
    assert {(r.gone, r.relative_path): r.nth for r in got.collect()} == want
    ordered = rows.repartitionByRange(8, "gone", "hash", "relative_path").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ordered.collect()) < 1000


@pytest.mark.parametrize("limit", [3, skew.MAX_HOT_KEYS])
def test_shared_between(frame, monkeypatch, limit):
    from snapledger.operators import shared

    monkeypatch.setattr(shared, "MAX_HOT_KEYS", limit)
    rng = random.Random(5)
    hashes = [str(i) for i in range(60)] + [None]
    old, new = snapshot(rng, hashes, 120, 0.3), snapshot(rng, hashes, 120, 0.3)
    old, new = old + [(None, "n", 1), ("own", "o", 1)], new + [(None, "n", 1), ("own", "o", 1), ("other", "n", 1)]
    links = lambda r, other: sum(x[1] == r[1] and x[0] != r[0] for x in other)
    best = {h: min(p for p, x, _ in old + new if x == h and p is not None) for h in {x[1] for x in old + new} - {None}}
    want = [(side, *r, best[r[1]], 1, links(r, other)) for side, own, other in (("old", old, new), ("new", new, old)) for r in own if r[1] and links(r, other)]
    assert sorted(map(tuple, sl.shared_between(frame(*old), frame(*new)).collect()), key=repr) == sorted(want, key=repr)
    total = {r.hash: r.n_links for r in sl.shared_classes(frame(*old), frame(*new)).collect()}
    assert total == {h: n for h in best if (n := sum(links(r, new) for r in old if r[1] == h))}


def test_space_and_growth(frame, rows):
    rng = random.Random(6)
    old, new = (snapshot(rng, [str(i) for i in range(30)] + [None], 150) for _ in range(2))
    old.append((None, "1", 4))

    def above(path):
        parts = (path or "x").split("/")[:-1]
        return [".", *("/".join(parts[:i]) for i in range(1, len(parts) + 1))]

    files, size = collections.Counter(), collections.Counter()
    lost, copies = collections.Counter(), collections.Counter()
    first = {}
    for p, h, _ in sorted(old, key=lambda r: (r[0] is not None, r[0])):
        first.setdefault(h, p)
    for p, h, s in old:
        for d in above(p):
            files[d] += 1
            size[d] += s
            copies[d] += h is not None and p != first[h]
            lost[d] += s if h is not None and p != first[h] else 0
    got = sl.space_by_directory(frame(*old))
    assert rows(got) == sorted((d, files[d], size[d], copies[d], lost[d]) for d in files)
    top, counters = got.where("directory = '.'").first(), sl.scan_counters(frame(*old)).first()
    assert (top.files, top.bytes) == (counters.files, counters.bytes_total)
    assert sum(r.copies - 1 for r in sl.space_lost(frame(*old)).collect()) == top.copies
    assert sl.space_by_directory(frame()).count() == 0 and sl.space_lost(frame()).count() == 0

    after = {r.directory: r for r in sl.growth_by_directory(frame(*old), frame(*new)).collect()}
    assert set(after) == {d for p, _, _ in old + new for d in above(p)}
    assert (after["."].files_before, after["."].files_after) == (len(old), len(new))
    assert after["a/x"].bytes_grown == sum(s for p, _, s in new if p.startswith("a/x/")) - size["a/x"]
    grown = {r.relative_path: r for r in sl.growth(frame(*old), frame(*new)).collect()}
    assert sum(r.bytes_grown for r in grown.values()) <= after["."].bytes_after  # changed files only
    gone = next(p for p, h, _ in old if p and p not in {x[0] for x in new})
    assert grown[gone].bytes_after is None and grown[gone].bytes_grown == -grown[gone].bytes_before


def test_time_tells_modified_files_apart(spark, rows):
    schema = "relative_path string, hash string, file_size_bytes long, mtime timestamp"
    day = [F.lit(f"2021-03-2{i}").cast("timestamp") for i in range(2)]
    old = spark.createDataFrame([(p, "1", 1, None) for p in "abcd"], schema).withColumn("mtime", day[0])
    new = old.withColumn("hash", F.when(F.col("relative_path") == "d", "1").otherwise("2"))
    new = new.withColumn("mtime", F.when(F.col("relative_path") == "a", day[1]).when(F.col("relative_path") == "c", None).otherwise(day[0]))
    assert rows(sl.modified_by_time(old, new)) == [("a", True), ("b", False), ("c", None)]
    assert rows(sl.modified_by_time(old.drop("mtime"), new)) == [("a", None), ("b", None), ("c", None)]
