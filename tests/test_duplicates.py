from collections import Counter

import pytest
import snapledger as sl
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from snapledger.operators import skew


def test_only_values_that_repeat(frame, rows):
    df = frame(("a", "1", 1), ("b", "1", 2), ("c", None, 3), ("d", None, 3), ("e", "2", 3))
    assert rows(sl.duplicates(df)) == [("1", "a", 1), ("1", "b", 2)]
    assert rows(sl.duplicates_by_mode(df, sl.SIZE_ONLY)) == [(3, "c"), (3, "d"), (3, "e")]
    assert rows(sl.value_counts(df)) == [("1", 2), ("2", 1)]
    assert rows(sl.duplicate_summary(df)) == [(2, 1)]


def test_report_columns(frame):
    df = frame(("a", "1", 1))
    assert sl.duplicates_by_mode(df, sl.FULL).columns == ["hash", "relative_path", "file_size_bytes"]
    assert sl.duplicates_by_mode(df, sl.PARTIAL).columns == ["hash", "relative_path", "file_size_bytes"]
    assert sl.duplicates_by_mode(df, sl.SIZE_ONLY).columns == ["file_size_bytes", "relative_path"]
    with pytest.raises(ValueError):
        sl.duplicates_by_mode(df, "size")


def test_size_is_not_part_of_the_key_unless_asked(frame, rows):
    df = frame(("a", "1", 1), ("b", "1", 2), ("c", "2", 5), ("d", "2", 5))
    assert len(rows(sl.duplicates(df))) == 4
    assert rows(sl.duplicates(df, with_size=True)) == [("2", "c", 5), ("2", "d", 5)]


def test_a_snapshot_joined_to_itself_is_all_duplicates(frame, rows):
    df = frame(("a", "1", 1), ("b", "2", 2), ("c", None, 3))
    merged = sl.concat(df, df)
    assert rows(sl.duplicates(merged), sl.PATH) == [("a",), ("a",), ("b",), ("b",)]
    assert rows(sl.path_collisions(merged)) == [("a",), ("a",), ("b",), ("b",), ("c",), ("c",)]


def test_empty_content_is_shared(spark, rows):
    source = spark.createDataFrame([("a", ""), ("b", ""), ("c", "x")], "k string, v string")
    assert rows(sl.duplicates(sl.snapshot(source, "k", "v")), sl.PATH) == [("a",), ("b",)]


def test_empty_input(frame, rows):
    assert rows(sl.duplicates(frame())) == []
    assert rows(sl.duplicate_summary(frame())) == [(0, 0)]


def test_within_volumes(spark, rows):
    df = spark.createDataFrame(
        [("d1", "a", "1", 1), ("d1", "b", "1", 1), ("d2", "c", "1", 1)],
        "volume string, relative_path string, hash string, file_size_bytes long",
    )
    assert rows(sl.duplicates_by_mode(df, sl.FULL, ["volume"])) == [("d1", "1", "a", 1), ("d1", "1", "b", 1)]


HASHES = st.lists(st.sampled_from([None, "1", "2", "3", "4", "5"]), max_size=14)


@pytest.mark.parametrize("hot_keys", [1, 3, 20_000])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hashes=HASHES)
def test_hot_and_other_values_together_are_complete(frame, rows, monkeypatch, hot_keys, hashes):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", hot_keys)
    df = frame(*((str(i), h, i % 3) for i, h in enumerate(hashes)))
    times = Counter(hashes)
    want = sorted((h, str(i), i % 3) for i, h in enumerate(hashes) if h is not None and times[h] > 1)
    assert rows(sl.duplicates(df)) == want
    in_groups = {(r["hash"], p) for r in sl.group_paths(df).collect() for p in r["paths"]}
    assert in_groups == {(h, str(i)) for i, h in enumerate(hashes)}


def skewed(spark):
    """A third of all rows share one hash, the rest come in pairs."""
    rows = spark.range(30_000).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") % 3 == 0, "boilerplate").otherwise(F.floor(F.col("id") / 2).cast("string")).alias("v"),
    )
    return sl.stored(sl.snapshot(rows, "k", "v"))


def test_a_hot_value_does_not_shuffle(spark, conf, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 100)
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    snap = skewed(spark)
    found = sl.duplicates(snap)
    times = Counter(r[0] for r in snap.select("hash").collect())
    assert found.count() == sum(n for n in times.values() if n > 1)
    # The rows that meet their key in a shuffle: the hot third is not among them.
    text = found._jdf.queryExecution().executedPlan().toString()
    # Hot keys are found in a stage of their own, before the broadcast starts.
    assert "Exchange SinglePartition, REPARTITION_BY_NUM" in text
    assert text.count("BroadcastHashJoin") == 2 and text.count("SortMergeJoin") == 1
    left_of_merge = text[text.index("SortMergeJoin") :]
    assert left_of_merge.index("LeftAnti") > left_of_merge.index("Exchange")


def test_fewer_hot_values_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 50)
    df = spark.range(1000).select((F.col("id") % 49).cast("string").alias("hash"))
    counts = skew.key_counts(df, ["hash"])
    assert counts.where(skew.is_hot(skew.total_rows(df))).count() < 50


def test_large_groups_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 100)
    snap = skewed(spark)
    groups = sl.group_paths(snap, list_rows=500).collect()
    sizes = [len(g["paths"]) for g in groups]
    assert max(sizes) < 1000 and sum(sizes) == 30_000
    by_hash = Counter()
    for g in groups:
        assert list(g["paths"]) == sorted(g["paths"])
        by_hash[g["hash"]] += len(g["paths"])
    assert by_hash == Counter(r[0] for r in snap.select("hash").collect())
    assert all(g["n_rows"] == by_hash[g["hash"]] for g in groups)
    assert len({p for g in groups for p in g["paths"]}) == 30_000


def test_repeated_paths_stay_in_their_group(frame):
    groups = sl.group_paths(frame(("a", "h", 1), ("a", "h", 1), ("b", "h", 1), (None, "h", 1)))
    assert [(g["n_rows"], g["paths"]) for g in groups.collect()] == [(4, [None, "a", "a", "b"])]


def test_nested_groups_flatten_back(spark, rows):
    source = spark.createDataFrame(
        [("a", "xy"), ("b", "xy"), ("c", "xyz1"), ("d", "xyz2"), ("e", "")], "k string, v string"
    )
    for mode in (sl.FULL, sl.PARTIAL, sl.SIZE_ONLY):
        groups = sl.nested_groups(sl.fingerprint_levels(source, "k", "v", mode, 3))
        assert rows(sl.flatten_groups(groups)) == rows(sl.snapshot(source, "k", "v", mode, 3))
        assert groups.count() == {sl.FULL: 4, sl.PARTIAL: 3, sl.SIZE_ONLY: 3}[mode]


def test_full_duplicates_are_duplicates_in_every_mode(spark, rows):
    source = spark.range(200).select(
        F.col("id").cast("string").alias("k"), F.repeat(F.lit("ab"), (F.col("id") % 17).cast("int")).alias("v")
    )
    found = {
        mode: {r[0] for r in rows(sl.duplicates_by_mode(sl.snapshot(source, "k", "v", mode, 4), mode), sl.PATH)}
        for mode in (sl.FULL, sl.PARTIAL, sl.SIZE_ONLY)
    }
    assert found[sl.FULL] <= found[sl.PARTIAL] and found[sl.FULL] <= found[sl.SIZE_ONLY]
