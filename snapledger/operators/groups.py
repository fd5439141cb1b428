"""Paths grouped under their fingerprint, and back to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import HASH, NOT_COMPUTED, PATH, SIZE
from ..sources.store import stored
from .skew import N_ROWS, key_counts, looked_up

LIST_ROWS = 100_000
LEVELS = (SIZE, "partial_hash", "fully_hashed", "full_hash")


def group_paths(snapshot: DataFrame, keys: Sequence[str] = (HASH,), list_rows: int = LIST_ROWS) -> DataFrame:
    """One sorted list of paths per group; a group of more than ``list_rows`` rows comes in parts.

    Columns: the keys, ``part`` (0 unless split), ``n_rows`` (of the whole group, on every part), ``paths``. Parts are
    disjoint, together hold every row's path, also repeated ones, and are dealt out by a digest of the path,
    about ``list_rows`` each whatever the size of the snapshot. Totals are counted map-side; those of large
    groups are stored and joined to the rows, by broadcast or by shuffle as their number allows; no task gets a hot group's rows.
    """
    keys = list(keys)
    parts = F.struct(F.col(N_ROWS).alias("total"), F.ceil(F.col(N_ROWS) / list_rows).alias("parts"))
    large = stored(key_counts(snapshot, keys).where(F.col(N_ROWS) > list_rows).withColumn("_large", parts), "large-groups")
    rows = looked_up(snapshot.select(*keys, PATH), keys, large, "_large", PATH)
    return (
        rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64(PATH), F.col("_large.parts")), F.lit(0).cast("long")))
        # Groups of many parts are sorted on executors; by a hash first, as the keys of a few hot groups differ in their parts only.
        .groupBy(F.xxhash64(*keys, "part").alias("_group"), *keys, "part")
        .agg(
            F.coalesce(F.max("_large.total"), F.count(F.lit(1))).alias(N_ROWS),
            # A null path is a path too, and lists drop nulls.
            F.sort_array(F.collect_list(F.struct(PATH))).alias("paths"),
        )
        .drop("_group")
        .withColumn("paths", F.transform("paths", lambda x: x[PATH]))
    )


def nested_groups(levels: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Paths grouped by size, then prefix digest and coverage, then full digest."""
    return group_paths(levels, LEVELS, list_rows)


def flatten_groups(groups: DataFrame) -> DataFrame:
    """Groups back to snapshot rows, with the most detailed hash each group has."""
    hashes = [F.col(c) for c in (HASH, "full_hash", "partial_hash") if c in groups.columns]
    size = F.col(SIZE) if SIZE in groups.columns else F.lit(None).cast("long")
    return groups.select(
        F.explode("paths").alias(PATH),
        F.coalesce(*hashes, F.lit(NOT_COMPUTED)).alias(HASH),
        size.alias(SIZE),
    )
