"""What changed between two snapshots, by path.

Paths are compared null-safely by default. ``null_keys=False`` states that no
path is null; snapshots bucketed by path (``sources.store.write_bucketed``)
then join without any shuffle.

A path must be unique on each side, and the query fails where it is not. The
check costs no shuffle of its own: each side is first grouped by path, which
collapses even a very frequent path map-side, and the join reuses the
partitioning and order of the groups. ``validate=False`` skips the grouping,
for snapshots already known to be unique.

Compare stored snapshots: on a snapshot still to be computed, even the test
whether a path has a hash computes that hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import HASH, MTIME, PATH, SIZE, require_same_tag
from .skew import N_ROWS, key_counts

# The path as a pair of never-null join keys.
KEY, KEY_IS_NULL = "key", "key_is_null"
HERE = "here"


def repeated_keys(snapshot: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Paths held by more than one row, with their counts."""
    return key_counts(snapshot, [*within, PATH]).where(F.col(N_ROWS) > 1)


def _one_per_path(
    side: DataFrame,
    name: str,
    values: dict[str, Column],
    within: Sequence[str],
    null_keys: bool,
    validate: bool,
) -> DataFrame:
    """Keys and values of one side, every column named ``<name>_...``."""
    keys = {c: F.col(c) for c in within} | {KEY: F.col(PATH)}
    if null_keys:
        keys |= {KEY: F.coalesce(PATH, F.lit("")), KEY_IS_NULL: F.col(PATH).isNull()}
    rows = side.select(*(c.alias(f"{name}_{k}") for k, c in (keys | values).items()))
    if not validate:
        return rows
    key, n = F.col(f"{name}_{KEY}"), F.col(N_ROWS)
    message = F.concat(F.lit("a path occurs more than once in one snapshot: "), key)
    # With one row per path, the maximum of a value is the value.
    return (
        rows.groupBy(*(f"{name}_{k}" for k in keys))
        .agg(F.count(F.lit(1)).alias(N_ROWS), *(F.max(f"{name}_{v}").alias(f"{name}_{v}") for v in values))
        .where(F.when(n == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
        .drop(N_ROWS)
    )


def _same_path(within: Sequence[str], null_keys: bool) -> Column:
    same = F.col(f"old_{KEY}") == F.col(f"new_{KEY}")
    for k in [*([KEY_IS_NULL] if null_keys else []), *within]:
        same = same & (F.col(f"old_{k}") == F.col(f"new_{k}"))
    return same


def _path_of(name: str, null_keys: bool) -> Column:
    key = F.col(f"{name}_{KEY}")
    return F.when(~F.col(f"{name}_{KEY_IS_NULL}"), key) if null_keys else key


def _differs(value: str) -> Column:
    old, new = F.col(f"old_{value}"), F.col(f"new_{value}")
    return ~old.eqNullSafe(new) | old.isNull()


def _columns(names: Sequence[str]) -> dict[str, Column]:
    return {c: F.col(c) for c in names}


def removed(
    old: DataFrame,
    new: DataFrame,
    value: str = HASH,
    within: Sequence[str] = (),
    null_keys: bool = True,
    validate: bool = True,
) -> DataFrame:
    """Rows of ``old`` whose path has no non-null ``value`` in ``new``."""
    require_same_tag(old, new)
    left = _one_per_path(old, "old", _columns([HASH, SIZE]), within, null_keys, validate)
    has_value = {HERE: F.col(value).isNotNull()}
    right = _one_per_path(new, "new", has_value, within, null_keys, validate).where(F.col(f"new_{HERE}"))
    gone = left.join(right, _same_path(within, null_keys), "left_anti")
    return gone.select(
        *(F.col(f"old_{c}").alias(c) for c in within),
        _path_of("old", null_keys).alias(PATH),
        *(F.col(f"old_{c}").alias(c) for c in (HASH, SIZE)),
    )


def added(
    old: DataFrame,
    new: DataFrame,
    value: str = HASH,
    within: Sequence[str] = (),
    null_keys: bool = True,
    validate: bool = True,
) -> DataFrame:
    """Rows of ``new`` whose path has no non-null ``value`` in ``old``."""
    return removed(new, old, value, within, null_keys, validate)


def modified(
    old: DataFrame,
    new: DataFrame,
    value: str = HASH,
    within: Sequence[str] = (),
    null_keys: bool = True,
    validate: bool = True,
) -> DataFrame:
    """Paths on both sides whose ``value`` differs; two nulls differ.

    ``value`` is the hash, or ``file_size_bytes`` for size-only snapshots. No join: see ``_changed``.
    """
    return _changed(old, new, value, within, null_keys, validate).select(*within, PATH)


def modified_by_time(
    old: DataFrame,
    new: DataFrame,
    value: str = HASH,
    within: Sequence[str] = (),
    null_keys: bool = True,
    validate: bool = True,
) -> DataFrame:
    """Modified paths and ``time_changed``: whether the modification time differs too.

    Content that changed under an unchanged time is worth a look. Null where either side does not know the time, as in
    runs stored before times were.
    """
    sides = (df if MTIME in df.columns else df.withColumn(MTIME, F.lit(None).cast("timestamp")) for df in (old, new))
    changed = _changed(*sides, value, within, null_keys, validate, [MTIME])
    return changed.select(*within, PATH, (F.col(f"old_{MTIME}") != F.col(f"new_{MTIME}")).alias("time_changed"))


def _changed(
    old: DataFrame,
    new: DataFrame,
    value: str,
    within: Sequence[str],
    null_keys: bool,
    validate: bool,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Keys of modified paths, with ``old_`` and ``new_`` columns of ``extra``.

    Both sides in one aggregate by path, which finds repeated paths too: a single shuffle, combined map-side, in place of one
    per side, a check and a join. As nothing is dropped before the check, an empty side does not hide repeated paths of the other.
    """
    require_same_tag(old, new)
    keys = {c: F.col(c) for c in within} | {KEY: F.col(PATH)}
    if null_keys:
        keys |= {KEY: F.coalesce(PATH, F.lit("")), KEY_IS_NULL: F.col(PATH).isNull()}
    values = list(dict.fromkeys([value, *extra]))
    sides = [
        side.select(*(c.alias(k) for k, c in keys.items()), F.lit(was).alias(HERE), *(F.col(v).alias(f"its_{v}") for v in values))
        for side, was in ((old, True), (new, False))
    ]
    here = {"old": F.col(HERE), "new": ~F.col(HERE)}
    grouped = sides[0].unionAll(sides[1]).groupBy(*keys).agg(
        *(F.count_if(flag).alias(f"n_{side}") for side, flag in here.items()),
        # With one row per path and side, the maximum of a value is the value.
        *(F.max(F.when(flag, F.col(f"its_{v}"))).alias(f"{side}_{v}") for side, flag in here.items() for v in values),
    )
    wanted = (F.col("n_old") > 0) & (F.col("n_new") > 0) & _differs(value)
    if validate:
        repeated = F.greatest("n_old", "n_new") > 1
        message = F.concat(F.lit("a path occurs more than once in one snapshot: "), F.col(KEY))
        # One condition, so that the check cannot be moved behind the comparison.
        wanted = F.when(repeated, F.raise_error(message).cast("boolean")).otherwise(wanted)
    path = F.when(~F.col(KEY_IS_NULL), F.col(KEY)) if null_keys else F.col(KEY)
    return grouped.where(wanted).withColumn(PATH, path)


def diff_flags(
    old: DataFrame,
    new: DataFrame,
    value: str = HASH,
    within: Sequence[str] = (),
    null_keys: bool = True,
    validate: bool = True,
    changed_only: bool = False,
    details: bool = False,
) -> DataFrame:
    """All three comparisons in one full outer join: flags per path.

    A path can be removed and modified at once (null hash on the other side),
    hence three flags and not one label. ``details`` keeps hash and size of
    both sides, from which ``reports_from_flags`` cuts the separate reports.
    """
    require_same_tag(old, new)
    kept = _columns([value, *((HASH, SIZE) if details else ())]) | {HERE: F.lit(True)}
    joined = _one_per_path(old, "old", kept, within, null_keys, validate).join(
        _one_per_path(new, "new", kept, within, null_keys, validate), _same_path(within, null_keys), "full_outer"
    )
    was, now = F.col(f"old_{HERE}").isNotNull(), F.col(f"new_{HERE}").isNotNull()
    flags = joined.select(
        *(F.coalesce(F.col(f"old_{c}"), F.col(f"new_{c}")).alias(c) for c in within),
        F.coalesce(_path_of("old", null_keys), _path_of("new", null_keys)).alias(PATH),
        (was & F.col(f"new_{value}").isNull()).alias("removed"),
        (now & F.col(f"old_{value}").isNull()).alias("added"),
        (was & now & _differs(value)).alias("modified"),
        *((F.col(f"{side}_{c}") for side in ("old", "new") for c in (HASH, SIZE)) if details else ()),
    )
    return flags.where("removed or added or modified") if changed_only else flags


def reports_from_flags(flags: DataFrame, within: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The removed, added and modified reports from detailed flags."""

    def rows(flag: str, side: str) -> DataFrame:
        kept = [F.col(f"{side}_{c}").alias(c) for c in (HASH, SIZE)]
        return flags.where(F.col(flag)).select(*within, PATH, *kept)

    return {
        "removed": rows("removed", "old"),
        "added": rows("added", "new"),
        "modified": flags.where("modified").select(*within, PATH),
    }
