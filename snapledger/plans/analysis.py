"""One run: store a snapshot, report duplicates, compare with a baseline."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.fingerprint import FULL, HASH, PATH, SIZE, SIZE_ONLY, check_mode
from ..operators.diff import added, diff_flags, modified, removed, reports_from_flags
from ..operators.duplicates import duplicate_summary, duplicates_by_mode
from ..sources.store import stored
from ..sources.tsv import read_tsv, write_tsv

log = logging.getLogger(__name__)

COMPARISONS = ("removed", "added", "modified")
REPORTS = ("duplicates", *COMPARISONS)


def compared_column(mode: str) -> str:
    return SIZE if check_mode(mode) == SIZE_ONLY else HASH


def reports(
    current: DataFrame,
    baseline: DataFrame | None = None,
    mode: str = FULL,
    wanted: Iterable[str] = REPORTS,
) -> dict[str, DataFrame]:
    """The wanted reports over a *stored* snapshot.

    A single comparison is a join of its own. One full outer join serves
    several: its changed rows are stored and the reports cut from them. Without
    a baseline the comparisons are skipped.
    """
    wanted = list(wanted)
    if unknown := set(wanted) - set(REPORTS):
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    out: dict[str, DataFrame] = {}
    if "duplicates" in wanted:
        out["duplicates"] = duplicates_by_mode(current, mode)
    comparisons = [r for r in COMPARISONS if r in wanted]
    if comparisons and baseline is None:
        log.warning("no baseline: skipping %s", ", ".join(comparisons))
    elif len(comparisons) == 1:
        compare = {"removed": removed, "added": added, "modified": modified}[comparisons[0]]
        out[comparisons[0]] = compare(baseline, current, compared_column(mode))
    elif comparisons:
        flags = diff_flags(baseline, current, compared_column(mode), changed_only=True, details=True)
        cut = reports_from_flags(stored(flags, "changes"))
        out |= {r: cut[r] for r in comparisons}
    return out


def run(
    current: DataFrame,
    out: str,
    baseline: DataFrame | None = None,
    mode: str = FULL,
    wanted: Iterable[str] = REPORTS,
    suffix: str = ".tsv.gz",
    write: Callable[[DataFrame, str, str], None] = write_tsv,
    write_current: bool = True,
) -> dict[str, str]:
    """Store the current snapshot, write it and the wanted reports under ``out``; returns their paths.

    ``write_current=False`` is for a snapshot read from a single file, which
    need not be written again.
    """
    current = stored(current, "snapshot", compact=True)
    tables = {"hashes": current} if write_current else {}
    tables |= reports(current, baseline, mode, wanted)
    written = {name: f"{out.rstrip('/')}/{name}{suffix}" for name in tables}
    for name, df in tables.items():
        write(df, written[name], mode)
    return written


def run_files(
    spark: SparkSession,
    inputs: list[str],
    out: str,
    baseline: str | None = None,
    mode: str = FULL,
    wanted: Iterable[str] = REPORTS,
    suffix: str = ".tsv.gz",
) -> dict[str, str]:
    """The same for snapshots stored as text: concatenate the inputs and report on them.

    Paths that collide between inputs are worth a warning; a comparison will
    then refuse them. A single input is not written again.
    """
    current = stored(read_tsv(spark, inputs, mode), "inputs", compact=True)
    colliding = duplicate_summary(current, PATH).first()["duplicate_rows"]
    if colliding:
        log.warning("the inputs hold %d rows with colliding paths", colliding)
    earlier = read_tsv(spark, baseline, mode) if baseline else None
    return run(current, out, earlier, mode, wanted, suffix, write_current=len(inputs) > 1)
