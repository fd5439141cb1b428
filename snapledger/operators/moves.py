"""Moved files: a removed path and an added path that hold the same content.

Matching is one to one. Within a hash, removed and added rows are numbered by volume and path, and equal numbers
are a move; whatever has no partner stays removed or added. So every removed or added row comes out exactly once, and
three removed copies against two added ones make two moves and one removed file.

A hash that few rows have is numbered by a window, and its rows meet in one task. Hashes that hold over
1 / MAX_HOT_KEYS of the rows, fewer than MAX_HOT_KEYS of them whatever the data, are numbered over all tasks: their rows are sorted in
ranges of (side, hash, path), so a range's rows count on from those before it; then rows meet by hash *and* number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fingerprint import HASH, PATH, SIZE
from ..sources.store import stored
from .diff import added, removed
from .skew import N_ROWS, broadcast_hot, is_hot, key_counts, total_rows

CHANGE, MOVED, REMOVED, ADDED = "change", "moved", "removed", "added"
FROM, TO = "from_", "to_"
_GONE, _NTH, _PLACE = "gone", "nth", "place"


def match_moves(gone: DataFrame, come: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Removed and added rows as moves, and what is left of both.

    Columns: ``change`` (moved, removed or added), the hash, the size, and the path and ``within`` columns of both sides as
    ``from_...`` and ``to_...``, null where the row has no such side. A null hash is no content, and never moves. ``within``
    (the volume, say) does not restrict the matching: a file may move from one volume to another.
    """
    where = [*within, PATH]
    sides = [df.select(HASH, SIZE, *where, F.lit(flag).alias(_GONE)) for df, flag in ((gone, True), (come, False))]
    rows = stored(sides[0].unionByName(sides[1]), "changed")
    counts = key_counts(rows.where(F.col(HASH).isNotNull()), [HASH])
    hot = stored(counts.where(is_hot(total_rows(rows))).select(HASH), "hot-hashes")
    cold = rows.where(F.col(HASH).isNotNull()).join(broadcast_hot(hot), HASH, "left_anti")
    by_place = W.partitionBy(HASH, _GONE).orderBy(*where)
    # One shuffle by hash serves the window and the pairing after it.
    few = _paired(cold.repartition(HASH).withColumn(_NTH, F.row_number().over(by_place).cast("long")), where)
    many = _paired(_numbered(rows.join(broadcast_hot(hot), HASH, "left_semi"), where), where)
    alone = rows.where(F.col(HASH).isNull())
    rest = alone.select(
        F.when(F.col(_GONE), REMOVED).otherwise(ADDED).alias(CHANGE),
        HASH,
        SIZE,
        *(F.when(F.col(_GONE), F.col(c)).alias(FROM + c) for c in where),
        *(F.when(~F.col(_GONE), F.col(c)).alias(TO + c) for c in where),
    )
    return few.unionByName(many).unionByName(rest)


def _numbered(rows: DataFrame, where: Sequence[str]) -> DataFrame:
    """Number the rows of each hash and side by place, over all tasks.

    Sorted in ranges, a row's number is its distance from the range's first row of that hash and side, plus all
    rows of theirs in earlier ranges. There are as many such starts as hashes and ranges, a bounded number.
    """
    key = [_GONE, HASH]
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shuffles, *key, *where).sortWithinPartitions(*key, *where)
    ordered = stored(ordered.withColumn(_PLACE, F.monotonically_increasing_id()), "ordered")
    in_range = F.shiftright(_PLACE, 33).alias("range")
    starts = ordered.groupBy(*key, in_range).agg(F.min(_PLACE).alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(*key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(*key, "range", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = ordered.withColumn("range", in_range).join(F.broadcast(starts.repartition(1)), [*key, "range"])
    return placed.withColumn(_NTH, F.col(_PLACE) - F.col("start") + F.col("before") + 1).drop(_PLACE, "range", "start", "before")


def _paired(rows: DataFrame, where: Sequence[str]) -> DataFrame:
    """At most one row of each side has a hash and a number; both make a move."""

    def side(gone: bool, c: str):
        return F.max(F.when(F.col(_GONE) == gone, F.col(c)))

    both = rows.groupBy(HASH, _NTH).agg(
        F.bool_or(_GONE).alias("was"),
        F.bool_or(~F.col(_GONE)).alias("now"),
        F.coalesce(side(False, SIZE), side(True, SIZE)).alias(SIZE),
        *(side(True, c).alias(FROM + c) for c in where),
        *(side(False, c).alias(TO + c) for c in where),
    )
    change = F.when(F.col("was") & F.col("now"), MOVED).when(F.col("was"), REMOVED).otherwise(ADDED)
    return both.select(change.alias(CHANGE), HASH, SIZE, *(p + c for p in (FROM, TO) for c in where))


def moves(old: DataFrame, new: DataFrame, within: Sequence[str] = (), null_keys: bool = True, validate: bool = True) -> DataFrame:
    """What was removed and added between two snapshots, with moved files told apart; see ``match_moves``.

    ``within`` names the volume, in snapshots of several: paths are compared inside a volume, content moves between any two.
    """
    options = {"within": within, "null_keys": null_keys, "validate": validate}
    return match_moves(removed(old, new, **options), added(old, new, **options), within)
