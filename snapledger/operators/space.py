"""Bytes by directory: what a snapshot holds, what its duplicates cost, and how it grew.

A file counts in its directory and in all directories above, up to ``.``. Files are summed by their own directory
first, map-side, so only distinct directories are spread over their ancestors, and the sums of the upper ones, which
every file reaches, combine map-side again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import HASH, PATH, SIZE, require_same_tag
from ..functions.paths import ancestors, dirname
from ..sources.store import stored
from .diff import diff_flags
from .skew import MAX_HOT_KEYS, broadcast_hot

DIRECTORY = "directory"


def by_directory(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows below every directory; a row of a null path counts at the top only. Absent values count 0."""
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in sums.items()]
    own = rows.groupBy(F.coalesce(dirname(PATH), F.lit(".")).alias(DIRECTORY)).agg(*totals)
    above = own.withColumn(DIRECTORY, F.explode(ancestors(DIRECTORY)))
    return above.groupBy(DIRECTORY).agg(*(F.sum(name).alias(name) for name in sums))


def space_lost(snapshot: DataFrame) -> DataFrame:
    """Per repeated hash: (hash, copies, file_size_bytes, bytes_lost), the bytes of all copies but a smallest one.

    Combined map-side, with no join. Order by ``bytes_lost`` to see the dearest first. A null hash is no content.
    """
    grouped = snapshot.where(F.col(HASH).isNotNull()).groupBy(HASH)
    counted = grouped.agg(F.count(F.lit(1)).alias("copies"), F.min(SIZE).alias(SIZE), (F.sum(SIZE) - F.min(SIZE)).alias("bytes_lost"))
    return counted.where("copies > 1")


def space_by_directory(snapshot: DataFrame) -> DataFrame:
    """(directory, files, bytes, copies, bytes_lost) of every directory with all below it.

    Of the rows of a hash, the one of the smallest path is the original, and every other a copy that costs its size. A row that shares
    the smallest path, in a concatenated snapshot, is an original too. Hot hashes are matched by broadcast, as in ``rows_sharing``.
    """
    rows = stored(snapshot.select(PATH, HASH, SIZE), "sized")
    first = F.min(F.struct(PATH)).alias("original")
    counts = rows.where(F.col(HASH).isNotNull()).groupBy(HASH).agg(F.count(F.lit(1)).alias("n"), first)
    repeated = stored(counts.where("n > 1").withColumn("original", F.col(f"original.{PATH}")), "originals")
    limit = rows.count() / MAX_HOT_KEYS
    hot, cold = (repeated.where(x).select(HASH, "original") for x in (F.col("n") > limit, F.col("n") <= limit))
    hot = broadcast_hot(hot)
    held = rows.join(hot, HASH).unionByName(rows.join(hot, HASH, "left_anti").join(cold, HASH))
    copies = held.where(~F.col(PATH).eqNullSafe(F.col("original")))
    one, none = F.lit(1), F.lit(0)
    parts = rows.select(PATH, one.alias("files"), F.col(SIZE).alias("bytes"), none.alias("copies"), none.alias("bytes_lost"))
    parts = parts.unionByName(copies.select(PATH, none.alias("files"), none.alias("bytes"), one.alias("copies"), F.col(SIZE).alias("bytes_lost")))
    return by_directory(parts, {c: F.col(c) for c in ("files", "bytes", "copies", "bytes_lost")})


def growth(old: DataFrame, new: DataFrame, value: str = HASH) -> DataFrame:
    """Every changed path with its size in both snapshots: (relative_path, bytes_before, bytes_after, bytes_grown).

    An absent file, or an absent size, counts 0 bytes of growth on its side; the columns themselves stay null there.
    """
    changed = diff_flags(old, new, value, changed_only=True, details=True)
    sizes = {"bytes_before": F.col(f"old_{SIZE}"), "bytes_after": F.col(f"new_{SIZE}")}
    grown = F.coalesce(sizes["bytes_after"], F.lit(0)) - F.coalesce(sizes["bytes_before"], F.lit(0))
    return changed.select(PATH, *(c.alias(k) for k, c in sizes.items()), grown.alias("bytes_grown"))


def growth_by_directory(old: DataFrame, new: DataFrame) -> DataFrame:
    """(directory, files_before, files_after, bytes_before, bytes_after, bytes_grown) of every directory of either snapshot.

    No join: both sides are summed together, one shuffle of directories and one of their ancestors.
    """
    require_same_tag(old, new)
    none = F.lit(0)
    sides = []
    for snapshot, was in ((old, True), (new, False)):
        own = (F.lit(1), F.col(SIZE))
        before, after = (own, (none, none)) if was else ((none, none), own)
        columns = zip(("files_before", "bytes_before", "files_after", "bytes_after"), (*before, *after))
        sides.append(snapshot.select(PATH, *(c.alias(k) for k, c in columns)))
    names = ("files_before", "files_after", "bytes_before", "bytes_after")
    summed = by_directory(sides[0].unionByName(sides[1]), {c: F.col(c) for c in names})
    return summed.withColumn("bytes_grown", F.col("bytes_after") - F.col("bytes_before"))
