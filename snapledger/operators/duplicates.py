"""Rows that share a value, inside one snapshot.

These read their input more than once. Give them a stored snapshot
(``sources.store``), so that content is fingerprinted only once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import HASH, PATH, SIZE, SIZE_ONLY, check_mode
from .skew import N_ROWS, broadcast_hot, is_hot, key_counts, total_rows


def _with_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def value_counts(rows: DataFrame, field: str = HASH, within: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value; null is not a value."""
    return key_counts(_with_keys(rows, [field]), [*within, field])


def rows_sharing(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All rows whose ``keys`` occur more than once.

    Counting pre-aggregates, so a value held by a third of all rows is cheap to
    count. Fetching its rows is where skew would bite: hot values are therefore
    matched by broadcast (their number is bounded, see ``skew``) and their rows
    never shuffle; only rows of other values meet their key in a shuffled semi
    join. The counting shuffle is shared by both branches.
    """
    keys, wanted = list(keys), list(dict.fromkeys([*keys, *columns]))
    repeated, hot = F.col(N_ROWS) > 1, is_hot(total_rows(rows))
    rows = _with_keys(rows.select(*wanted), keys)
    counts = key_counts(rows, keys)
    hot_keys = broadcast_hot(counts.where(repeated & hot).select(*keys))
    other_keys = counts.where(repeated & ~hot).select(*keys)
    unmoved = rows.join(hot_keys, keys, "left_semi")
    shuffled = rows.join(hot_keys, keys, "left_anti").join(other_keys, keys, "left_semi")
    return unmoved.select(*columns).unionByName(shuffled.select(*columns))


def duplicates(
    snapshot: DataFrame,
    field: str = HASH,
    columns: Sequence[str] | None = None,
    with_size: bool = False,
    within: Sequence[str] = (),
) -> DataFrame:
    """Rows whose ``field`` occurs more than once.

    Size is not part of the key unless ``with_size``; paths need not differ.
    ``within`` adds grouping columns, such as the volume.
    """
    columns = list(columns or [*within, *dict.fromkeys([field, PATH, SIZE])])
    keys = [*within, field] + ([SIZE] if with_size and field != SIZE else [])
    return rows_sharing(snapshot, keys, columns)


def duplicates_by_mode(snapshot: DataFrame, mode: str, within: Sequence[str] = ()) -> DataFrame:
    """The duplicate report: by size in size-only mode, otherwise by hash."""
    if check_mode(mode) == SIZE_ONLY:
        return duplicates(snapshot, SIZE, [*within, SIZE, PATH], within=within)
    return duplicates(snapshot, HASH, [*within, HASH, PATH, SIZE], within=within)


def path_collisions(snapshot: DataFrame) -> DataFrame:
    """Every row, of concatenated snapshots, whose path is not unique."""
    return duplicates(snapshot, PATH, [PATH])


def duplicate_summary(snapshot: DataFrame, field: str = HASH, within: Sequence[str] = ()) -> DataFrame:
    """How many rows the duplicate report has, and over how many groups. Needs no join."""
    repeated = value_counts(snapshot, field, within).where(F.col(N_ROWS) > 1)
    return repeated.groupBy(*within).agg(
        F.coalesce(F.sum(N_ROWS), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_groups"),
    )
