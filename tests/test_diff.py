import pytest
import snapledger as sl
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from snapledger.operators.diff import repeated_keys

OLD = [("a", "1", 1), (None, "2", 2), ("c", None, 3), ("d", "4", 4), ("gone", "5", 5)]
NEW = [("a", "1", 1), (None, "9", 2), ("c", None, 3), ("d", None, 4), ("new", "6", 6)]


def test_null_paths_and_null_hashes(frame, rows):
    old, new = frame(*OLD), frame(*NEW)
    assert rows(sl.removed(old, new)) == [("c", None, 3), ("d", "4", 4), ("gone", "5", 5)]
    assert rows(sl.added(old, new)) == [("c", None, 3), ("new", "6", 6)]
    assert rows(sl.modified(old, new)) == [(None,), ("c",), ("d",)]


def test_flags_say_the_same(frame, rows):
    flags = sl.diff_flags(frame(*OLD), frame(*NEW))
    assert flags.columns == ["relative_path", "removed", "added", "modified"]
    assert rows(flags) == [
        (None, False, False, True),
        ("a", False, False, False),
        ("c", True, True, True),
        ("d", True, False, True),
        ("gone", True, False, False),
        ("new", False, True, False),
    ]


def test_empty_path_is_not_the_null_path(frame, rows):
    old, new = frame(("", "1", 1)), frame((None, "1", 1))
    assert rows(sl.removed(old, new)) == [("", "1", 1)]
    assert rows(sl.added(old, new)) == [(None, "1", 1)]
    assert rows(sl.modified(old, new)) == []


def test_reports_from_flags(frame, rows):
    old, new = frame(*OLD), frame(*NEW)
    cut = sl.reports_from_flags(sl.diff_flags(old, new, details=True, changed_only=True))
    assert rows(cut["removed"]) == rows(sl.removed(old, new))
    assert rows(cut["added"]) == rows(sl.added(old, new))
    assert rows(cut["modified"]) == rows(sl.modified(old, new))


@pytest.mark.parametrize("keys", [("x", "x"), (None, None)])
@pytest.mark.parametrize("compare", [sl.removed, sl.added, sl.modified, sl.diff_flags])
@pytest.mark.parametrize("side", ["old", "new"])
def test_a_repeated_path_fails(frame, keys, compare, side):
    twice, once = frame(*((k, "1", 1) for k in keys)), frame(("x", "2", 1), (None, "3", 1))
    pair = (twice, once) if side == "old" else (once, twice)
    with pytest.raises(PySparkException, match="a path occurs more than once|USER_RAISED_EXCEPTION"):
        compare(*pair).collect()


def test_repeated_keys(frame, rows):
    assert rows(repeated_keys(frame(("x", "1", 1), ("x", "2", 1), ("y", "1", 1)))) == [("x", 2)]


def test_empty_sides(frame, rows):
    some, none = frame(("a", "1", 1)), frame()
    assert rows(sl.removed(some, none)) == [("a", "1", 1)]
    assert rows(sl.added(some, none)) == rows(sl.modified(some, none)) == []
    assert rows(sl.diff_flags(none, none)) == []


def test_moved_file_is_removed_and_added(frame, rows):
    old, new = frame(("here/x", "1", 1)), frame(("there/x", "1", 1))
    assert rows(sl.removed(old, new), sl.PATH) == [("here/x",)]
    assert rows(sl.added(old, new), sl.PATH) == [("there/x",)]


def test_size_mode_compares_sizes(frame, rows):
    old = frame(("a", "not_computed", 1), ("b", "not_computed", 1))
    new = frame(("a", "not_computed", 1), ("b", "not_computed", 2))
    assert rows(sl.modified(old, new)) == []
    assert rows(sl.modified(old, new, value=sl.SIZE)) == [("b",)]


def test_volumes_are_kept_apart(spark, rows):
    schema = "volume string, relative_path string, hash string, file_size_bytes long"
    old = spark.createDataFrame([("d1", "a", "1", 1), ("d2", "a", "1", 1)], schema)
    new = spark.createDataFrame([("d1", "a", "2", 1)], schema)
    assert rows(sl.modified(old, new, within=["volume"])) == [("d1", "a")]
    assert rows(sl.removed(old, new, within=["volume"])) == [("d2", "a", "1", 1)]


def test_hashes_of_different_kinds_are_refused(spark):
    source = spark.createDataFrame([("a", "text")], "k string, v string")
    full, partial = sl.snapshot(source, "k", "v"), sl.snapshot(source, "k", "v", sl.PARTIAL)
    for compare in (sl.removed, sl.modified, sl.diff_flags, sl.concat):
        with pytest.raises(ValueError, match="different kinds"):
            compare(full, partial)
    other = sl.tagged(full, sl.FULL, algo="blake3")
    with pytest.raises(ValueError, match="different kinds"):
        sl.modified(full, other)


def test_the_kind_of_hash_survives_storage(spark):
    source = spark.createDataFrame([("a", "text")], "k string, v string")
    full, partial = sl.snapshot(source, "k", "v"), sl.stored(sl.snapshot(source, "k", "v", sl.PARTIAL, 3))
    assert partial.schema["hash"].metadata == {"compare_mode": "partial-hash", "hash_algo": "sha256", "prefix_bytes": 3}
    with pytest.raises(ValueError, match="different kinds"):
        sl.removed(full, partial)


SIDE = st.dictionaries(
    st.sampled_from([None, "", "a", "b/c", "d"]), st.tuples(st.sampled_from([None, "1", "2"]), st.integers(0, 3)), max_size=5
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SIDE, SIDE)
def test_properties(frame, rows, a, b):
    old, new = (frame(*((k, h, n) for k, (h, n) in s.items())) for s in (a, b))
    gone = {r[0] for r in rows(sl.removed(old, new))}
    come = {r[0] for r in rows(sl.added(old, new))}
    changed = {r[0] for r in rows(sl.modified(old, new))}
    assert gone == {k for k in a if b.get(k, (None,))[0] is None}
    assert come == {k for k in b if a.get(k, (None,))[0] is None}
    assert changed == {k for k in a if k in b and (a[k][0] != b[k][0] or a[k][0] is None)}
    flags = {r[0]: r[1:] for r in rows(sl.diff_flags(old, new))}
    assert flags == {k: (k in gone, k in come, k in changed) for k in a | b}
    assert rows(sl.added(old, new)) == rows(sl.removed(new, old))


# --- plans -------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_per_side(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    ids = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    old, new = (sl.stored(sl.snapshot(ids, "k", "v")) for _ in range(2))
    for compare in (sl.removed, sl.diff_flags):
        assert plan(compare(old, new)).count("Exchange hashpartitioning") == 2, compare


def test_modified_is_one_aggregate(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    old, new = (sl.stored(sl.snapshot(ids, "k", "v")) for _ in range(2))
    for compare in (sl.modified, sl.modified_by_time):
        text = plan(compare(old, new))
        assert text.count("Exchange") == 1 and "Join" not in text and "rand(" not in text
        assert text.count("partial_max") >= 2  # combined before the shuffle


def test_bucketed_tables_join_without_a_shuffle(spark, conf, tmp_path, rows):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    ids = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    old = sl.write_bucketed(sl.snapshot(ids, "k", "v"), "old_side", str(tmp_path / "old"), 4)
    new = sl.write_bucketed(sl.snapshot(ids.where("id < 90"), "k", "v"), "new_side", str(tmp_path / "new"), 4)
    flags = sl.diff_flags(old, new, null_keys=False)
    assert "Exchange" not in plan(flags)
    assert flags.where("removed").count() == 10
    assert old.schema["hash"].metadata["hash_algo"] == "sha256"


def test_bucketed_tables_refuse_null_paths(spark, tmp_path):
    source = spark.createDataFrame([(None, "x")], "k string, v string")
    with pytest.raises(PySparkException):
        sl.write_bucketed(sl.snapshot(source, "k", "v"), "null_side", str(tmp_path / "null"), 2)
