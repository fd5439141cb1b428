"""Cases that once gave silently wrong or incomplete answers."""

import os

import pytest
import snapledger as sl
from pyspark.errors import PySparkException
from snapledger.sources import history, tree


@pytest.mark.parametrize("compare", [sl.removed, sl.added, sl.modified, sl.diff_flags])
@pytest.mark.parametrize("swap", [False, True])
def test_repeated_path_against_an_empty_side(frame, spark, compare, swap):
    twice = sl.stored(frame(("a", "1", 1), ("a", "1", 1)))
    none = sl.stored(frame(("b", "1", 1)).where("relative_path = 'x'"))
    with pytest.raises(PySparkException, match="more than once"):
        compare(*((none, twice) if swap else (twice, none))).collect()


def test_a_looping_link_costs_no_other_file(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"f{i}").write_text(str(i))
    os.symlink("loop", tmp_path / "loop")
    scan = sl.scan_tree(spark, str(tmp_path))
    assert scan.snapshot.count() == 10 and scan.skipped.count() == 1


def test_names_that_are_no_text_are_set_aside(spark, tmp_path):
    (tmp_path / "good").write_text("x")
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff", "w"):
        pass
    scan = sl.scan_tree(spark, str(tmp_path))
    assert [r[0] for r in scan.snapshot.select("relative_path").collect()] == ["good"]


def test_odd_names_survive_a_uri(tmp_path):
    for name in ("a%20b", "c#d", "g?h", "e f"):
        (tmp_path / name).write_text(name)
    root = f"file://{tmp_path}"
    found = list(tree._lister({"v": root}, [], [], False)("v", root, root))
    files = {path: location for _, _, location, path, kind, _ in found if kind == tree.FILE}
    assert sorted(files) == ["a%20b", "c#d", "e f", "g?h"]
    for path, location in files.items():
        with tree._open(location) as f:
            assert f.read() == path.encode()


def test_io_errors_fail_the_listing(tmp_path, monkeypatch):
    (tmp_path / "f").write_text("x")

    def broken(entry):
        raise OSError(5, "input/output error")

    monkeypatch.setattr(tree, "_stat", broken)
    with pytest.raises(OSError):
        list(tree._lister({"v": str(tmp_path)}, [], [], False)("v", str(tmp_path), str(tmp_path)))


def test_an_emptied_run_replaces_its_rows(spark, frame, tmp_path):
    path = str(tmp_path / "h")
    history.add_run(frame(("a", "1", 1)), path, "d 1", "r2")
    history.add_run(frame(("a", "1", 1)).where("relative_path = 'x'"), path, "d 1", "r2")
    got = history.read_history(spark, path)
    assert got.rows.count() == 0 and got.runs.count() == 1


def test_series_names(spark, frame, tmp_path):
    for volume, value in (("a-1", "1"), ("b-1", "2"), ("my disk", "3"), ("x%20+y", "4")):
        sl.write_tsv(frame(("f", value, 1)), f"{tmp_path}/in/2021-03-29PT2130-{volume}-hashes.tsv", sl.FULL)
    sl.import_series(spark, f"{tmp_path}/in", f"{tmp_path}/h", sl.FULL)
    got = history.read_history(spark, f"{tmp_path}/h")
    assert {(r.volume, r.hash) for r in got.rows.collect()} == {("a-1", "1"), ("b-1", "2"), ("my disk", "3"), ("x%20+y", "4")}
    assert {r.volume for r in got.runs.collect()} == {"a-1", "b-1", "my disk", "x%20+y"}
    sl.write_tsv(frame(("f", "1", 1)), f"{tmp_path}/other/undated-hashes.tsv", sl.FULL)
    with pytest.raises(PySparkException, match="not the name"):
        sl.import_series(spark, f"{tmp_path}/other", f"{tmp_path}/h2", sl.FULL)


def test_unwritable_suffix_is_refused(frame, tmp_path):
    with pytest.raises(ValueError, match="suffix"):
        sl.write_tsv(frame(("a", "1", 1)), f"{tmp_path}/o.tsv.xz", sl.FULL)
