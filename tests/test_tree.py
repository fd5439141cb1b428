import hashlib
import io
import os
import sys
import types

import pytest
import snapledger as sl
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from snapledger.sources import tree


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "root"
    files = {
        "a/one.txt": b"same",
        "b/two.txt": b"same",
        "empty": b"",
        ".dot": b"dot",
        ".hidden/inner": b"inner",
        "_u/under": b"under",
        "with space.nfo": b"sp",
        "src1/x": b"x1",
        "src10/y": b"y1",
        "deep/er/and/er/z": b"0123456789" * 300_000,
    }
    for name, data in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    (top / "bare").mkdir()
    os.symlink(top / "a/one.txt", top / "link")
    os.symlink(top / "a", top / "linked_dir")
    os.symlink(top / "nowhere", top / "broken")
    return str(top), files


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_every_file_and_no_link(spark, root, rows):
    top, files = root
    scan = sl.scan_tree(spark, top)
    assert rows(scan.snapshot) == sorted((n, sha(d), len(d)) for n, d in files.items())
    assert rows(scan.skipped, sl.PATH, "kind") == [("broken", "link"), ("link", "link")]
    assert scan.vanished.count() == 0
    total = sum(map(len, files.values()))
    assert scan.counters.drop("volume").first().asDict() == {
        "files": 10, "bytes_total": total, "bytes_read": total, "bytes_avoided": 0, "directories": 12,
    }


def test_partial_reads_only_the_prefix(spark, root, rows):
    top, files = root
    scan = sl.scan_tree(spark, top, sl.PARTIAL)
    assert rows(scan.snapshot) == sorted((n, sha(d[:1_000_000]), len(d)) for n, d in files.items())
    assert scan.counters.first()["bytes_avoided"] == 2_000_000


def test_size_mode_opens_nothing(spark, root, rows):
    top, files = root
    scan = sl.scan_tree(spark, top, sl.SIZE_ONLY)
    assert rows(scan.snapshot) == sorted((n, "not_computed", len(d)) for n, d in files.items())
    assert scan.counters.first()["bytes_read"] == 0


def test_exclusions(spark, root, rows):
    top, files = root
    scan = sl.scan_tree(spark, top, exclude_suffixes=["*.nfo"], exclude_paths=["./src1", "./.hidden/"])
    left = set(files) - {"with space.nfo", "src1/x", "src10/y", ".hidden/inner"}
    assert {r[0] for r in rows(scan.snapshot)} == left
    assert scan.counters.first()["directories"] == 9
    whole = sl.scan_tree(spark, top, exclude_paths=["src1"], boundary=True)
    assert {r[0] for r in rows(whole.snapshot)} == set(files) - {"src1/x"}


def test_paths_are_relative_to_the_base(spark, root, rows):
    top, _ = root
    above = sl.scan_tree(spark, "file://" + top + "/a/", base=os.path.dirname(top))
    assert rows(above.snapshot, sl.PATH) == [("root/a/one.txt",)]
    beside = sl.scan_tree(spark, top + "/a", base=top + "/b")
    assert rows(beside.snapshot, sl.PATH) == [("../a/one.txt",)]


def test_an_excluded_root_has_nothing(spark, root, rows):
    top, _ = root
    scan = sl.scan_tree(spark, top + "/src1", base=top, exclude_paths=["src1"])
    assert rows(scan.snapshot) == rows(scan.skipped) == []


def test_several_volumes_in_one_scan(spark, root, rows):
    top, _ = root
    scan = sl.scan_trees(spark, {"d1": top + "/a", "d2": top + "/b"})
    assert rows(scan.by_volume, "volume", sl.PATH) == [("d1", "one.txt"), ("d2", "two.txt")]
    assert rows(scan.counters, "volume", "files", "directories", "bytes_read") == [("d1", 1, 1, 4), ("d2", 1, 1, 4)]


def test_volumes_scanned_twice_and_compared(spark, root, rows, tmp_path):
    top, _ = root
    history, roots = str(tmp_path / "history"), {"d1": top + "/a", "d2": top + "/b", "d3": top + "/src1"}
    sl.scan_volumes(spark, {v: roots[v] for v in ("d1", "d2")}, history, "2021-03-28")
    with open(top + "/a/one.txt", "ab") as f:
        f.write(b"!")
    os.remove(top + "/b/two.txt")
    sl.scan_volumes(spark, roots, history, "2021-03-29", exclude_suffixes=[".nfo"])
    summary = sl.run_volumes(spark, history, str(tmp_path / "reports"))
    assert rows(summary, "volume", "baseline_run_id", "files", "removed", "modified") == [
        ("d1", "2021-03-28", 1, 0, 1),
        ("d2", "2021-03-28", 0, 1, 0),
        ("d3", None, 1, None, None),
    ]


def test_agrees_with_the_table_route(spark, root, rows):
    top, files = root
    table = spark.createDataFrame([(n, d) for n, d in files.items()], "k string, v binary")
    for mode in sl.MODES:
        assert rows(sl.scan_tree(spark, top, mode).snapshot) == rows(sl.snapshot(table, "k", "v", mode))


def test_a_vanished_file_is_set_aside(spark, root, rows):
    top, files = root
    listing = tree.list_trees(spark, {"d1": top}).where("kind = 'file'")
    os.remove(top + "/a/one.txt")
    hashed = tree.hash_files(listing)
    assert rows(hashed.where("error is not null"), sl.PATH, "error") == [("a/one.txt", "not found")]
    assert hashed.where("error is null").count() == len(files) - 1


def test_a_missing_tree_fails(spark, root, tmp_path):
    with pytest.raises(PySparkException):
        sl.scan_tree(spark, str(tmp_path / "nothing"))
    listing = spark.createDataFrame([("d1", "/nowhere", "/nowhere/x", "x", "file", 1)], tree.LISTING)
    with pytest.raises(PySparkException, match="not visible"):
        tree.hash_files(sl.stored(listing)).collect()


def test_an_empty_tree(spark, tmp_path):
    (tmp_path / "e").mkdir()
    scan = sl.scan_tree(spark, str(tmp_path / "e"))
    assert scan.snapshot.count() == 0 and scan.counters.first()["directories"] == 1


def test_a_single_file_is_not_a_tree(spark, root):
    with pytest.raises(PySparkException):
        sl.scan_tree(spark, root[0] + "/empty")


def test_duplicate_files_reads_little_and_finds_all(spark, tmp_path, rows):
    top = tmp_path / "d"
    top.mkdir()
    contents = {
        "a": b"x" * 50, "b": b"x" * 50, "c": b"x" * 10 + b"y" * 40, "d": b"x" * 10 + b"y" * 40, "e": b"x" * 49 + b"z",
        "f": b"12", "g": b"12", "h": b"13", "i": b"", "j": b"", "k": b"unique",
    }
    for name, data in contents.items():
        (top / name).write_bytes(data)
    found = sl.duplicate_files(spark, str(top), prefix_bytes=10)
    assert rows(found) == rows(sl.duplicates(sl.scan_tree(spark, str(top)).snapshot))
    assert {r[1] for r in rows(found)} == set("abcdfgij")


def test_remote_listing_functions(root, monkeypatch):
    """The pyarrow route, over a local file system reached by URI."""
    top, files = root
    uri = "file://" + top
    kinds = {name: kind for name, kind, _ in tree._entries(uri + "/a")}
    assert kinds == {"one.txt": "file"}
    assert tree._relative(uri + "/a/one.txt", uri) == "a/one.txt" and tree._relative(uri, uri) == "."
    with tree._open(uri + "/a/one.txt") as stream:
        assert tree.digest(stream, None, "sha256") == (sha(b"same"), 4)


def test_digest_in_blocks():
    data = os.urandom(3 * tree.READ_BLOCK + 17)
    assert tree.digest(io.BytesIO(data), None, "sha256") == (sha(data), len(data))
    for limit in (0, 1, tree.READ_BLOCK, tree.READ_BLOCK + 1, 10**9):
        assert tree.digest(io.BytesIO(data), limit, "sha256") == (sha(data[:limit]), min(limit, len(data)))


def test_other_hash_algorithms(monkeypatch):
    monkeypatch.setitem(sys.modules, "blake3", types.SimpleNamespace(blake3=hashlib.blake2s))
    assert tree.digest(io.BytesIO(b"x"), None, "blake3") == (hashlib.blake2s(b"x").hexdigest(), 1)
    monkeypatch.setitem(sys.modules, "blake3", None)
    with pytest.raises(ValueError, match="needs the blake3 package"):
        tree.hasher("blake3")
    with pytest.raises(ValueError, match="unknown hash algorithm"):
        tree.hasher("md5")


def test_tasks_of_equal_bytes(spark):
    """With one file a thousand times the rest, no task has more than its share and one file."""
    sizes = [1000] * 499 + [1_000_000]
    listing = spark.createDataFrame([("d", "/r", f"/r/{i}", str(i), "file", s) for i, s in enumerate(sizes)], tree.LISTING)
    files = sl.stored(listing)
    work = tree.dealt(files, F.col(sl.SIZE), bytes_per_task=50_000)
    tasks = work.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(sl.SIZE).alias("b"), F.max(sl.SIZE).alias("largest"), F.count("*").alias("n")).collect()
    share = -(-sum(sizes) // work.rdd.getNumPartitions())
    assert sum(t.n for t in tasks) == 500 and len(tasks) > 5
    assert all(t.b <= share + t.largest for t in tasks)
    small = [t for t in tasks if t.largest == 1000]
    assert max(t.n for t in small) <= share / 1000 + 1  # not all small files in one task
    assert tree.dealt(files.limit(0), F.col(sl.SIZE)).count() == 0


def test_a_file_that_changes_is_read_again(tmp_path, monkeypatch):
    path = tmp_path / "grows"
    path.write_bytes(b"before")
    digest, grown = tree.digest, []

    def growing(stream, limit, algo):
        out = digest(stream, limit, algo)
        if len(grown) < rounds:
            grown.append(1)
            with open(path, "ab") as f:
                f.write(b"!")
        return out

    monkeypatch.setattr(tree, "digest", growing)
    rounds = 1
    value, seen, size, _ = tree.read_settled(str(path), None, "sha256")
    assert (value, size, seen) == (sha(b"before!"), 7, 6 + 7)
    rounds = 10**9
    assert tree.read_settled(str(path), None, "sha256")[0] is None
    one = next(tree._hashing_task(None, "sha256")(iter([_row_of(str(tmp_path), str(path))]))).to_pylist()[0]
    assert (one["hash"], one["error"]) == (None, tree.CHANGED)


def _row_of(root, path):
    import pyarrow as pa

    columns = {"volume": ["d"], "root": [root], "location": [path], "relative_path": ["grows"], "file_size_bytes": [1]}
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def test_unsettled_files_are_in_no_snapshot(spark, rows):
    files = [("d", "a", "1", 1, 1, None), ("d", "b", None, 5, 15, tree.CHANGED), ("d", "c", None, 1, 0, tree.NOT_FOUND)]
    short = ", ".join(tree.HASHED.split(", ")[:6])
    hashed = spark.createDataFrame(files, short).withColumns({c: F.lit(None).cast("timestamp") for c in (sl.MTIME, sl.HASHED_AT)})
    scan = tree.TreeScan(spark.createDataFrame([], tree.LISTING), hashed, sl.FULL, 10, "sha256")
    assert rows(scan.snapshot) == [("a", "1", 1)]
    assert rows(scan.vanished) == [("d", "c")] and rows(scan.unsettled) == [("d", "b")]


def test_times_and_measured_rates(spark, root, rows):
    top, files = root
    os.utime(top + "/a/one.txt", (1_600_000_000, 1_600_000_000))
    scan = sl.scan_tree(spark, top)
    times = {r.relative_path: r for r in scan.timed.collect()}
    assert times["a/one.txt"].mtime.timestamp() == 1_600_000_000
    assert all(r.hashed_at > r.mtime for r in times.values())
    rate = scan.throughput.first()
    assert scan.seconds > 0 and rate.mb_per_second == pytest.approx(sum(map(len, files.values())) / 1e6 / scan.seconds)
    assert sl.scan_tree(spark, top, sl.SIZE_ONLY).timed.where("mtime is not null").count() == 0


def test_few_directories_are_listed_by_a_task_each(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"d{i}").mkdir()
        for k in range(3):
            (tmp_path / f"d{i}" / f"f{k}").write_text("x")
    found = tree.list_trees(spark, {"v": str(tmp_path)}).where("kind = 'file'")
    parts = found.groupBy(F.input_file_name()).agg(F.countDistinct(F.substring_index("location", "/", -2).substr(1, 2)).alias("n")).collect()
    assert found.count() == 21 and len(parts) == 7 and all(r["n"] == 1 for r in parts)


def test_more_directories_than_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "DIRECTORIES_PER_TASK", 2)
    for i in range(60):
        (tmp_path / f"d{i}" / "sub").mkdir(parents=True)
        (tmp_path / f"d{i}" / "sub" / "f").write_text("x")
    assert tree.list_trees(spark, {"v": str(tmp_path)}).where("kind = 'file'").count() == 60
