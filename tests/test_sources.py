import gzip
import os

import pytest
import snapledger as sl
from snapledger.sources import history as sources
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from snapledger.sources import store
from snapledger.sources.tsv import hash_column, rename_column, write_merged

AWKWARD = ['a"b', "c\td", "e\\f", "g\nh", "NA", "null", " lead ", "tail\\", "007", "ü/日"]


@pytest.mark.parametrize("suffix", [".tsv", ".tsv.gz", ".tsv.bz2"])
def test_awkward_paths_come_back(frame, rows, spark, tmp_path, suffix):
    df = frame(*((p, "1", i) for i, p in enumerate(AWKWARD)), ("nohash", None, 1))
    out = str(tmp_path / "s") + suffix
    sl.write_tsv(df, out, sl.FULL)
    assert rows(sl.read_tsv(spark, out, sl.FULL)) == rows(df)
    parts = [n for n in os.listdir(out) if n.startswith("part-")]
    assert all(n.endswith(suffix.removeprefix(".tsv") or ".csv") for n in parts)


@pytest.mark.parametrize("mode", [sl.FULL, sl.PARTIAL, sl.SIZE_ONLY])
def test_every_mode_comes_back(frame, rows, spark, tmp_path, mode):
    df = frame(("a", "x", 1))
    sl.write_tsv(df, str(tmp_path / "s.tsv"), mode)
    back = sl.read_tsv(spark, str(tmp_path / "s.tsv"), mode, tag={})
    assert rows(back) == rows(df) and back.schema["hash"].metadata["compare_mode"] == mode
    assert hash_column(mode) == {sl.FULL: "full_hash", sl.PARTIAL: "partial_hash", sl.SIZE_ONLY: "hash"}[mode]


def test_wrong_mode_is_refused(frame, spark, tmp_path):
    sl.write_tsv(frame(("a", "x", 1)), str(tmp_path / "s.tsv"), sl.FULL)
    sl.write_tsv(frame(("a", "x", 1)).select(sl.PATH), str(tmp_path / "m.tsv"), sl.FULL)
    for name in ("s.tsv", "m.tsv"):
        with pytest.raises(ValueError, match="another mode"):
            sl.read_tsv(spark, str(tmp_path / name), sl.PARTIAL)
    with pytest.raises(ValueError, match="another mode"):
        rename_column(frame(), "partial_hash", "hash")


def test_a_plain_file_with_quoted_text_and_bare_numbers(spark, rows, tmp_path):
    text = '"relative_path"\t"full_hash"\t"file_size_bytes"\n"a\\"b"\t"h1"\t7\n"c\\\\d"\t"h2"\t8\n'
    path = tmp_path / "2021-03-21PT2300-disk1-hashes.tsv.gz"
    path.write_bytes(gzip.compress(text.encode()))
    assert rows(sl.read_tsv(spark, str(path), sl.FULL)) == [('a"b', "h1", 7), ("c\\d", "h2", 8)]


def test_inputs_of_different_column_order_concatenate(frame, rows, spark, tmp_path):
    sl.write_tsv(frame(("a", "x", 1)), str(tmp_path / "1.tsv"), sl.FULL)
    sl.write_tsv(frame(("b", "y", 2)).select(sl.HASH, sl.PATH, sl.SIZE), str(tmp_path / "2.tsv"), sl.FULL)
    merged = sl.read_tsv(spark, [str(tmp_path / "1.tsv"), str(tmp_path / "2.tsv")], sl.FULL)
    assert rows(merged) == [("a", "x", 1), ("b", "y", 2)]


def test_empty_report_has_a_header(frame, tmp_path):
    out = tmp_path / "empty.tsv"
    sl.write_tsv(frame(), str(out), sl.PARTIAL)
    parts = [p.read_text() for p in out.iterdir() if p.name.startswith("part-")]
    assert parts == ['"relative_path"\t"partial_hash"\t"file_size_bytes"\n']


def test_ordered_report(frame, tmp_path):
    out = tmp_path / "o.tsv"
    sl.write_tsv(frame(("b", "2", 1), ("c", "1", 1), ("a", "2", 1)), str(out), sl.FULL, ordered=True)
    lines = [line for p in sorted(out.glob("part-*")) for line in p.read_text().splitlines() if "relative" not in line]
    assert [line.split("\t")[0] for line in lines] == ['"c"', '"a"', '"b"']


def test_single_input_is_not_rewritten(frame, tmp_path):
    assert not write_merged(frame(), ["one"], str(tmp_path / "x.tsv"), sl.FULL)
    assert not (tmp_path / "x.tsv").exists()
    assert write_merged(frame(), ["one", "two"], str(tmp_path / "x.tsv"), sl.FULL)
    assert (tmp_path / "x.tsv").exists()


def test_shared_folder_comes_from_the_session(spark):
    assert store.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


class Session:
    """Just enough of a session to ask it for its folder."""

    def __init__(self, master, named=None, on_context=None):
        self.conf, self.sparkContext, self.master = {"spark.checkpoint.dir": named}, self, master
        self.folder = on_context

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_of_other_sessions():
    assert store.shared_folder(Session("yarn", "hdfs://x/shared/", "hdfs://y")) == "hdfs://x/shared"
    assert store.shared_folder(Session("yarn", None, "hdfs://y")) == "hdfs://y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(Session("yarn"))
    local = Session("local[2]")
    assert store.shared_folder(local) == store.shared_folder(local) == local.folder


def test_snapshot_store(spark, frame, rows, tmp_path):
    df = frame(*((str(i), "1", i) for i in range(100)))
    sl.write_snapshot(df, str(tmp_path / "s"))
    assert rows(sl.read_snapshot(spark, str(tmp_path / "s"))) == rows(df)
    volumes = df.withColumn("volume", F.concat(F.lit("d"), (F.col("file_size_bytes") % 2).cast("string")))
    sl.write_snapshot(volumes, str(tmp_path / "v"), ["volume"])
    assert {p.name for p in (tmp_path / "v").glob("volume=*")} == {"volume=d0", "volume=d1"}


# --- history ----------------------------------------------------------------------

RUNS = ["2021-03-21PT2300", "2021-03-28PT2213", "2021-03-29PT2130"]


@pytest.fixture
def history(frame, spark, tmp_path):
    path = str(tmp_path / "history")
    sl.add_run(frame(("a", "1", 1)), path, "d1", RUNS[0])
    sl.add_run(frame(("a", "1", 1), ("b", "2", 2)), path, "d1", RUNS[1])
    sl.add_run(frame(("a", "9", 1), ("c", "3", 3), ("e", "3", 3)), path, "d1", RUNS[2])
    sl.add_run(frame(("x", "1", 1)), path, "d2", RUNS[2])
    return path


def test_latest_runs(spark, history, rows):
    ranked = sl.ranked_runs(sl.read_history(spark, history))
    assert rows(sl.latest_runs(ranked)) == [("d1", RUNS[2], RUNS[1]), ("d2", RUNS[2], None)]
    earlier = sl.ranked_runs(sl.read_history(spark, history), as_of=RUNS[1])
    assert rows(sl.latest_runs(earlier)) == [("d1", RUNS[1], RUNS[0])]


def test_volume_changes(spark, history, rows):
    volumes = sl.Volumes(sl.read_history(spark, history))
    assert rows(volumes.changes()) == [
        ("d1", "a", False, False, True),
        ("d1", "b", True, False, False),
        ("d1", "c", False, True, False),
        ("d1", "e", False, True, False),
    ]
    assert rows(volumes.summary()) == [
        ("d1", RUNS[2], RUNS[1], 3, 2, 1, 1, 2, 1),
        ("d2", RUNS[2], None, 1, 0, 0, None, None, None),
    ]


def test_repeating_a_run_replaces_it(spark, history, frame, rows):
    sl.add_run(frame(("only", "1", 1)), history, "d2", RUNS[2])
    again = sl.read_history(spark, history).rows
    assert rows(again.where("volume = 'd2'"), sl.PATH) == [("only",)]
    assert again.where("volume = 'd1'").count() == 6


def test_names_that_look_like_numbers_stay_text(spark, frame, rows, tmp_path):
    sl.add_run(frame(("a", "1", 1)), str(tmp_path / "h"), "007", "20210321")
    assert rows(sl.read_history(spark, str(tmp_path / "h")).rows, "volume", "run_id") == [("007", "20210321")]


def test_only_compared_runs_are_listed(spark, history, frame):
    """Of 10,000 registered runs whose folders do not exist, none is looked for but those compared."""
    old = spark.createDataFrame([("d1", f"2020-{i:05d}", "{}", f"{i:020d}-x", 1) for i in range(10_000)], sources.RUNS)
    old.write.mode("append").parquet(f"{history}/runs")
    changes = sl.Volumes(sl.read_history(spark, history)).changes()
    assert changes.count() == 4
    compared = {f.split("/rows/")[1].split("/")[0] for f in changes.inputFiles()}
    assert len(compared) == 2
    assert "SortMergeJoin [volume" not in changes._jdf.queryExecution().executedPlan().toString()


def test_import_of_dated_text_snapshots(spark, rows, tmp_path):
    def text(name, *lines, column="full_hash"):
        body = "".join(f'"{p}"\t"{h}"\t{n}\n' for p, h, n in lines)
        data = f'"relative_path"\t"{column}"\t"file_size_bytes"\n{body}'.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)

    text(f"{RUNS[0]}-disk1-hashes.tsv.gz", ("a", "1", 1), ("b", "2", 2))
    text(f"{RUNS[1]}-disk1-hashes.tsv.gz", ("a", "9", 1))
    text(f"{RUNS[1]}-disk1-removed.tsv.gz", ("b", "2", 2))
    text(f"{RUNS[1]}-disk2-hashes.tsv")
    sl.import_series(spark, str(tmp_path), str(tmp_path / "history"), sl.FULL)
    volumes = sl.Volumes(sl.read_history(spark, str(tmp_path / "history")))
    assert rows(volumes.runs) == [("disk1", RUNS[1], RUNS[0]), ("disk2", RUNS[1], None)]
    assert rows(volumes.changes()) == [("disk1", "a", False, False, True), ("disk1", "b", True, False, False)]
    text(f"{RUNS[2]}-disk1-hashes.tsv", ("a", "1", 1), column="partial_hash")
    with pytest.raises(Exception, match="CSV header does not conform"):
        sl.import_series(spark, str(tmp_path), str(tmp_path / "other"), sl.FULL)


def test_an_emptied_volume_is_compared(spark, history, frame, rows):
    sl.add_run(frame(), history, "d1", "2021-03-30")
    volumes = sl.Volumes(sl.read_history(spark, history))
    assert rows(volumes.changes()) == [("d1", p, True, False, False) for p in ("a", "c", "e")]
    assert rows(volumes.summary().where("volume = 'd1'"), "files", "duplicate_rows", "removed") == [(0, 0, 3)]


def test_runs_of_different_kinds_are_refused(spark, frame, rows, tmp_path):
    path, once = str(tmp_path / "h"), frame(("a", "1", 1))
    sl.add_run(sl.tagged(once, sl.FULL), path, "d1", "1")
    sl.add_run(once, path, "d1", "2")
    assert rows(sl.Volumes(sl.read_history(spark, path)).changes()) == []
    sl.add_run(sl.tagged(once, sl.PARTIAL), path, "d1", "2")
    with pytest.raises(ValueError, match="different kinds"):
        sl.Volumes(sl.read_history(spark, path))


def test_a_history_of_nothing(spark, frame, rows, tmp_path):
    sl.add_run(frame(), str(tmp_path / "h"), "d1", "2021-03-30")
    assert rows(sl.Volumes(sl.read_history(spark, str(tmp_path / "h"))).summary(), "volume", "files") == [("d1", 0)]


def test_run_volumes(spark, history, rows, tmp_path):
    summary = sl.run_volumes(spark, history, str(tmp_path / "out"))
    assert rows(summary, "volume", "removed", "added", "modified") == [("d1", 1, 2, 1), ("d2", None, None, None)]
    assert rows(spark.read.parquet(str(tmp_path / "out/added")), "volume", sl.PATH) == [("d1", "c"), ("d1", "e")]
    assert rows(spark.read.parquet(str(tmp_path / "out/duplicates")), sl.PATH) == [("c",), ("e",)]


# --- a whole run -----------------------------------------------------------------------


def test_run_writes_the_wanted_reports(spark, frame, rows, tmp_path):
    old, new = frame(("a", "1", 1), ("b", "2", 2)), frame(("a", "9", 1), ("c", "9", 1))
    written = sl.run(new, str(tmp_path / "r"), old, suffix=".tsv")
    assert set(written) == {"hashes", "duplicates", "removed", "added", "modified"}
    assert rows(sl.read_tsv(spark, written["hashes"], sl.FULL)) == rows(new)
    assert rows(sl.read_tsv(spark, written["duplicates"], sl.FULL), sl.PATH) == [("a",), ("c",)]
    assert rows(sl.read_tsv(spark, written["removed"], sl.FULL)) == [("b", "2", 2)]
    assert spark.read.option("sep", "\t").option("header", True).csv(written["modified"]).first()[0] == "a"


def test_one_comparison_equals_its_part_of_all(frame, rows):
    old, new = frame(("a", "1", 1), ("b", "2", 2), ("d", None, 1)), frame(("a", "9", 1), ("c", "9", 1), ("d", "1", 1))
    together = sl.reports(new, old)
    for name in ("removed", "added", "modified"):
        assert rows(sl.reports(new, old, wanted=[name])[name]) == rows(together[name])


def test_run_without_baseline_skips_comparisons(frame, tmp_path, caplog):
    written = sl.run(frame(("a", "1", 1)), str(tmp_path / "r"), wanted=["removed", "duplicates"], write_current=False)
    assert set(written) == {"duplicates"}
    assert "no baseline" in caplog.text
    with pytest.raises(ValueError, match="unknown reports"):
        sl.reports(frame(), wanted=["moved"])


def test_run_from_text_files(spark, frame, rows, tmp_path, caplog):
    for name, df in {"1": frame(("a", "1", 1)), "2": frame(("b", "1", 1), ("a", "3", 1))}.items():
        sl.write_tsv(df, str(tmp_path / name), sl.FULL)
    inputs = [str(tmp_path / n) for n in "12"]
    written = sl.run_files(spark, inputs, str(tmp_path / "both"), wanted=["duplicates"])
    assert "2 rows with colliding paths" in caplog.text
    assert rows(sl.read_tsv(spark, written["hashes"], sl.FULL)) == [("a", "1", 1), ("a", "3", 1), ("b", "1", 1)]
    assert rows(sl.read_tsv(spark, written["duplicates"], sl.FULL), sl.PATH) == [("a",), ("b",)]
    single = sl.run_files(spark, inputs[1:], str(tmp_path / "one"), baseline=inputs[0], wanted=["added", "modified"])
    assert set(single) == {"added", "modified"}
    assert rows(sl.read_tsv(spark, single["added"], sl.FULL), sl.PATH) == [("b",)]
    with pytest.raises(PySparkException):
        sl.run_files(spark, inputs, str(tmp_path / "clash"), baseline=inputs[0])


def test_a_failure_before_the_register_changes_nothing(spark, history, frame, rows, monkeypatch):
    """A rerun that dies between its rows and the register: readers still see the old run, and a later rerun replaces it."""
    before = rows(sl.read_history(spark, history).rows)

    def dies(rows):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(sources, "tag_of", dies)
        with pytest.raises(RuntimeError):
            sl.add_run(frame(("other", "7", 7)), history, "d1", RUNS[2])
    assert len(os.listdir(f"{history}/rows")) == 5  # four runs, and the rows that no one registered
    assert rows(sl.read_history(spark, history).rows) == before
    sl.add_run(frame(("other", "7", 7)), history, "d1", RUNS[2])
    again = sl.read_history(spark, history)
    assert rows(again.rows.where(f"run_id = '{RUNS[2]}' and volume = 'd1'"), sl.PATH) == [("other",)]
    assert rows(sl.replaced_attempts(again), "volume", "run_id") == [("d1", RUNS[2])]


def test_a_reader_keeps_its_rows_while_a_run_is_repeated(spark, history, frame, rows):
    held = sl.read_history(spark, history).rows
    sl.add_run(frame(), history, "d1", RUNS[2])
    assert held.where("volume = 'd1'").count() == 6
    assert sl.read_history(spark, history).rows.where("volume = 'd1'").count() == 3


def test_names_of_any_kind(spark, frame, rows, tmp_path):
    path, names = str(tmp_path / "h"), ["a/b", "ü =%", "", "x" * 300, 'q"']
    for name in names:
        sl.add_run(frame((name, "1", 1)), path, name, "r/1")
    got = sl.read_history(spark, path)
    assert rows(got.rows, "volume", sl.PATH) == sorted((n, n) for n in names)
    assert sl.Volumes(got).summary().count() == len(names)


def test_times_in_a_history_of_both_kinds(spark, frame, rows, tmp_path):
    path, day = str(tmp_path / "h"), F.lit("2021-03-20").cast("timestamp")
    for volume, timed in (("old", False), ("new", True)):
        first = frame(("a", "1", 1), ("b", "1", 1))
        sl.add_run(first.withColumn(sl.MTIME, day) if timed else first, path, volume, "1")
        sl.add_run(frame(("a", "2", 1), ("b", "1", 1)).withColumn(sl.MTIME, day), path, volume, "2")
    history = sl.read_history(spark, path)
    assert rows(sl.Volumes(history).modified_by_time()) == [("new", "a", False), ("old", "a", None)]
    assert history.rows.where("mtime is null").count() == 2
