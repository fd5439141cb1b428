"""All volumes of a history, each against its own latest earlier run, in one job per report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import FULL
from ..operators.diff import diff_flags, modified_by_time, reports_from_flags
from ..operators.duplicates import duplicate_summary, duplicates_by_mode
from ..operators.moves import moves
from ..sources.history import (
    BASELINE,
    RUN,
    VOLUME,
    History,
    add_runs,
    current_and_baseline,
    latest_runs,
    pairs,
    ranked_runs,
    read_history,
    require_comparable,
    rows_of_runs,
)
from ..sources.store import stored, write_snapshot
from ..sources.tree import TreeScan, scan_trees
from .analysis import COMPARISONS, compared_column


@dataclass
class Volumes:
    """A history, and which of its runs are compared (resolved once and stored)."""

    history: History
    mode: str = FULL
    as_of: str | None = None

    def __post_init__(self) -> None:
        ranked = stored(ranked_runs(self.history, self.as_of), "runs")
        require_comparable(ranked)
        self.runs = latest_runs(ranked)

    def current(self) -> DataFrame:
        """Rows of every volume's latest run, baseline or not."""
        return rows_of_runs(self.history, self.runs).drop(RUN)

    def changes(self, details: bool = False) -> DataFrame:
        """Changed paths of every volume that has a baseline, flagged."""
        current, baseline = current_and_baseline(self.history, self.runs)
        return diff_flags(
            baseline, current, compared_column(self.mode), within=[VOLUME], changed_only=True, details=details
        )

    def modified_by_time(self) -> DataFrame:
        """Modified paths of every volume that has a baseline, and whether their modification time differs too."""
        current, baseline = current_and_baseline(self.history, self.runs)
        return modified_by_time(baseline, current, compared_column(self.mode), within=[VOLUME])

    def moves(self) -> DataFrame:
        """Removed and added files of all volumes that have a baseline, with those told apart that moved, also between volumes."""
        current, baseline = current_and_baseline(self.history, self.runs)
        return moves(baseline, current, within=[VOLUME])

    def duplicates(self) -> DataFrame:
        """Duplicates inside the latest run of each volume."""
        return duplicates_by_mode(self.current(), self.mode, [VOLUME])

    def summary(self, changes: DataFrame | None = None) -> DataFrame:
        """One row per volume: its runs, and how much each report holds.

        A volume without a baseline is listed with null change counts.
        """
        changes = self.changes() if changes is None else changes
        rows = self.current()
        files = rows.groupBy(VOLUME).agg(F.count(F.lit(1)).alias("files"))
        repeated = duplicate_summary(rows, compared_column(self.mode), [VOLUME])
        counted = changes.groupBy(VOLUME).agg(*(F.count_if(F.col(c)).alias(c) for c in COMPARISONS))
        none, compared = F.lit(0).cast("long"), F.col(BASELINE).isNotNull()
        return (
            self.runs.join(files, VOLUME, "left")
            .join(repeated, VOLUME, "left")
            .join(counted, VOLUME, "left")
            .select(
                VOLUME,
                RUN,
                BASELINE,
                *(F.coalesce(F.col(c), none).alias(c) for c in ("files", "duplicate_rows", "duplicate_groups")),
                *(F.when(compared, F.coalesce(F.col(c), none)).alias(c) for c in COMPARISONS),
            )
        )


def run_volumes(
    spark: SparkSession, history_path: str, out: str, mode: str = FULL, as_of: str | None = None
) -> DataFrame:
    """Write every report of every volume under ``out``, partitioned by volume; returns the summary."""
    volumes = Volumes(read_history(spark, history_path), mode, as_of)
    changes = stored(volumes.changes(details=True), "volume-changes")
    tables = reports_from_flags(changes, [VOLUME]) | {"duplicates": volumes.duplicates()}
    for name, df in tables.items():
        write_snapshot(df, f"{out.rstrip('/')}/{name}", [VOLUME])
    return volumes.summary(changes)


def scan_volumes(
    spark: SparkSession, roots: Mapping[str, str], history_path: str, run_id: str, mode: str = FULL, **options
) -> TreeScan:
    """Scan the trees of all volumes together and add them to the history as one run.

    ``options`` are those of ``scan_trees``. ``run_volumes`` then compares.
    """
    scan = scan_trees(spark, roots, mode, **options)
    add_runs(scan.timed.withColumn(RUN, F.lit(run_id)), history_path, pairs(spark, list(roots), run_id))
    return scan
