import hashlib

import pytest
import snapledger as sl
from pyspark.sql import functions as F
from snapledger.functions import paths
from snapledger.operators.exclude import path_rules, suffix_rules


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def source(spark):
    return spark.createDataFrame(
        [("a", b""), ("b", b"abc"), ("c", "héllo".encode()), ("d", None), ("e", b"\x00\xff" * 600_000)], "k string, v binary"
    )


def test_modes(source, rows):
    contents = {r["k"]: r["v"] for r in source.collect()}
    full = {k: v and (sha(v), len(v)) for k, v in contents.items()}
    full["a"], full["d"] = (sha(b""), 0), (None, None)
    assert {r[0]: r[1:] for r in rows(sl.snapshot(source, "k", "v"))} == full
    # 2 bytes cut the second, two-byte character of "héllo" in half.
    partial = {r[0]: r[1] for r in rows(sl.snapshot(source, "k", "v", sl.PARTIAL, 2))}
    assert partial == {k: None if v is None else sha(bytes(v[:2])) for k, v in contents.items()}
    assert {r[1] for r in rows(sl.snapshot(source, "k", "v", sl.SIZE_ONLY))} == {"not_computed"}


def test_default_prefix_is_decimal(source, rows):
    cut = {r[0]: r[1] for r in rows(sl.snapshot(source, "k", "v", sl.PARTIAL))}
    assert cut["e"] == sha(b"\x00\xff" * 500_000)


def test_size_column_spares_the_content(spark, tmp_path):
    spark.createDataFrame([("a", "text", 4)], "k string, v string, n long").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    snap = sl.snapshot(stored, "k", "v", sl.SIZE_ONLY, size="n")
    assert "struct<k:string,n:bigint>" in snap._jdf.queryExecution().executedPlan().toString()
    assert snap.first()["file_size_bytes"] == 4


def test_bad_arguments(source):
    with pytest.raises(ValueError):
        sl.snapshot(source, "k", "v", "partial")
    with pytest.raises(ValueError):
        sl.snapshot(source, "k")


def test_levels(source, rows):
    found = {r["relative_path"]: r for r in sl.fingerprint_levels(source, "k", "v", prefix_bytes=3).collect()}
    assert found["b"]["fully_hashed"] and found["b"]["partial_hash"] == found["b"]["full_hash"] == sha(b"abc")
    assert not found["e"]["fully_hashed"] and found["e"]["partial_hash"] == sha(b"\x00\xff\x00")


def test_concat_keeps_rows_and_fills_columns(spark, frame, rows):
    narrow = spark.createDataFrame([("1", "b")], "hash string, relative_path string")
    assert rows(sl.concat(frame(("a", "1", 1)), narrow)) == [("a", "1", 1), ("b", "1", None)]
    with pytest.raises(ValueError):
        sl.concat()


def test_paths(spark, rows):
    df = spark.createDataFrame([("top",), ("d/x",), ("d/e/y.z",), (".h/w",)], "p string")
    assert rows(df.select("p", paths.dirname("p"), paths.basename("p"))) == [
        (".h/w", ".h", "w"),
        ("d/e/y.z", "d/e", "y.z"),
        ("d/x", "d", "x"),
        ("top", ".", "top"),
    ]
    assert rows(df.select(paths.relative_to("p", "d/"))) == [(".h/w",), ("e/y.z",), ("top",), ("x",)]


# --- exclusion ------------------------------------------------------------------


def test_rule_normalisation():
    assert suffix_rules(["*.nfo", ".nfo", "nfo", ".DS_Store", "**"]) == [".nfo", "nfo", ".DS_Store", "*"]
    assert path_rules(["./foo/", "foo", ".git", "../x", "./.git"]) == ["foo", "git", "./x", ".git"]
    assert suffix_rules(None) == path_rules(None) == []


@pytest.mark.parametrize("rule", ["", ".", "./", "/", "..", "./."])
def test_path_rules_that_drop_everything_are_refused(rule):
    with pytest.raises(ValueError):
        path_rules([rule])


@pytest.mark.parametrize("rule", ["", "*"])
def test_suffix_rules_that_drop_everything_are_refused(rule):
    with pytest.raises(ValueError):
        suffix_rules([rule])


@pytest.fixture
def tree(frame):
    names = ["src1", "src1/a", "src10/a", "src1/sub/b", "x/src1/a", "top.nfo", "d/x.nfo", "d/xnfo", "d/x.NFO", ".git/c", "src1x"]
    return frame(*((n, "1", 1) for n in names), (None, "1", 1))


def kept(df):
    return {r["relative_path"] for r in df.collect()}


def test_directory_prefix(tree):
    everything = kept(tree)
    # Files named like the rule stay: only directories are tested.
    assert everything - kept(sl.exclude(tree, paths=["src1"])) == {"src1/a", "src10/a", "src1/sub/b"}
    assert everything - kept(sl.exclude(tree, paths=["src1"], boundary=True)) == {"src1/a", "src1/sub/b"}
    assert kept(sl.exclude(tree, paths=["src1/a"])) == everything
    # A leading dot is dropped from a rule, unless a ./ stands before it.
    assert kept(sl.exclude(tree, paths=[".git"])) == everything
    assert everything - kept(sl.exclude(tree, paths=["./.git"])) == {".git/c"}
    assert kept(sl.exclude(tree, paths=["../x"])) == everything


def test_name_suffix(tree):
    everything = kept(tree)
    assert everything - kept(sl.exclude(tree, suffixes=["*.nfo"])) == {"top.nfo", "d/x.nfo"}
    assert everything - kept(sl.exclude(tree, suffixes=["nfo"])) == {"top.nfo", "d/x.nfo", "d/xnfo"}
    assert kept(sl.exclude(tree, suffixes=["d/x.nfo"])) == everything
    assert kept(sl.exclude(tree)) == everything


def test_excluded_content_is_not_hashed(spark, tmp_path):
    spark.createDataFrame([("a.x", "t")], "k string, v string").write.parquet(str(tmp_path / "t"))
    rows = sl.exclude(spark.read.parquet(str(tmp_path / "t")), suffixes=[".x"], key="k")
    text = sl.snapshot(rows, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert text.index("sha2") < text.index("Filter")


# --- counters -----------------------------------------------------------------------


def test_counters(frame):
    df = frame(("a/x", "1", 10), ("a/y", "2", 300), ("z", "3", 0))
    got = sl.scan_counters(df, sl.PARTIAL, 100).first().asDict()
    assert got == {"directories": 2, "files": 3, "bytes_total": 310, "bytes_read": 110, "bytes_avoided": 200}
    assert sl.scan_counters(df, sl.SIZE_ONLY).first()["bytes_read"] == 0
    assert sl.scan_counters(frame()).first()["bytes_total"] == 0
    assert sl.bytes_avoided(df, sl.SIZE_ONLY).first()["mb_avoided"] == 310 / 1e6


def test_counters_observed_while_writing(frame):
    df, seen = sl.observe_counters(frame(("a", "1", 10), ("b", "2", 300)), "t", sl.PARTIAL, 100)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"files": 2, "bytes_total": 310, "bytes_read": 110, "bytes_avoided": 200}


def test_throughput_units(spark):
    counters = spark.createDataFrame([(1200, 3_000_000)], "files long, bytes_read long")
    fast = sl.throughput(counters, 60).first()
    assert (fast["elapsed"], fast["elapsed_unit"], fast["file_rate"], fast["file_rate_unit"]) == (60, "seconds", 20, "second")
    assert fast["mb_per_second"] == pytest.approx(0.05)
    slow = sl.throughput(counters, 600).first()
    assert (slow["elapsed"], slow["elapsed_unit"], slow["file_rate"], slow["file_rate_unit"]) == (10, "minutes", 120, "minute")
