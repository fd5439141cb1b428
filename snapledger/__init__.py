"""Content snapshots of tables and file trees, and what changed between them, on Spark."""

from .functions.fingerprint import FULL, HASH, HASHED_AT, MODES, MTIME, PARTIAL, PATH, PREFIX_BYTES, SIZE, SIZE_ONLY, tagged
from .operators.diff import added, diff_flags, modified, modified_by_time, removed, reports_from_flags
from .operators.duplicates import (
    duplicate_summary,
    duplicates,
    duplicates_by_mode,
    path_collisions,
    value_counts,
)
from .operators.exclude import exclude
from .operators.groups import flatten_groups, group_paths, nested_groups
from .operators.metrics import bytes_avoided, observe_counters, scan_counters, throughput
from .operators.moves import match_moves, moves
from .operators.rules import exclude_listed
from .operators.shared import shared_between, shared_classes
from .operators.snapshot import concat, fingerprint_levels, snapshot
from .operators.space import growth, growth_by_directory, space_by_directory, space_lost
from .plans.analysis import reports, run, run_files
from .plans.staged import duplicate_files
from .plans.volumes import Volumes, run_volumes, scan_volumes
from .sources.history import (
    History,
    add_run,
    add_runs,
    import_series,
    latest_runs,
    ranked_runs,
    read_history,
    replaced_attempts,
)
from .sources.store import read_snapshot, stored, write_bucketed, write_snapshot
from .sources.tree import scan_tree, scan_trees
from .sources.tsv import read_tsv, write_tsv
