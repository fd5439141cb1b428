"""Content that two snapshots share under different paths.

A hash in m rows of one side and n of the other links m x n pairs. They are never listed: each row is told its class, named by
the smallest path that has the hash, and the number of its links, so the output grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import HASH, PATH, SIZE, require_same_tag
from ..sources.store import stored
from .skew import MAX_HOT_KEYS, broadcast_hot

SIDES = ("old", "new")


def _by_path(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both sides by hash and path: how many each has, and of what size. Combined map-side."""
    sides = [df.where(F.col(HASH).isNotNull()).select(PATH, HASH, SIZE, F.lit(name).alias("side")) for df, name in zip((old, new), SIDES)]
    here = {name: F.col("side") == name for name in SIDES}
    return (
        sides[0].unionByName(sides[1]).groupBy(HASH, PATH)
        .agg(
            *(F.count_if(here[s]).alias(f"n_{s}") for s in SIDES),
            *(F.max(F.when(here[s], F.col(SIZE))).alias(f"size_{s}") for s in SIDES),
        )
    )


def _classes(paths: DataFrame) -> DataFrame:
    """Per hash on both sides: its representative, rows of each side, and pairs of rows of different paths."""
    totals = paths.groupBy(HASH).agg(
        F.min(PATH).alias("class_path"),
        *(F.sum(f"n_{s}").alias(f"rows_{s}") for s in SIDES),
        F.sum(F.col("n_old") * F.col("n_new")).alias("unmoved"),
    )
    links = F.col("rows_old") * F.col("rows_new") - F.col("unmoved")
    return totals.withColumn("n_links", links).where("rows_old > 0 and rows_new > 0 and n_links > 0").drop("unmoved")


def shared_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per shared hash: (hash, class_path, rows_old, rows_new, n_links); the links are pairs of different paths."""
    require_same_tag(old, new)
    return _classes(_by_path(old, new))


def shared_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either snapshot whose content the other has under a different path.

    (side, relative_path, hash, file_size_bytes, class_path, copies, n_links): ``copies`` rows of that side have this path and
    hash (one, in a valid snapshot), each linked with ``n_links`` rows of the other side. A null hash is no content; null
    paths are one path. A file found under its own path only is not shared.

    Rows of a hash that holds over 1 / MAX_HOT_KEYS of all rows do not shuffle to learn their class: such hashes are fewer than MAX_HOT_KEYS
    and broadcast.
    """
    require_same_tag(old, new)
    paths = stored(_by_path(old, new), "paths-by-hash")
    classes = stored(_classes(paths).select(HASH, "class_path", "rows_old", "rows_new"), "classes")
    limit = paths.count() / MAX_HOT_KEYS
    hot, cold = (classes.where(x) for x in (F.col("rows_old") + F.col("rows_new") > limit, F.col("rows_old") + F.col("rows_new") <= limit))
    rest = paths.join(broadcast_hot(hot.select(HASH)), HASH, "left_anti")
    members = paths.join(broadcast_hot(hot), HASH).unionByName(rest.join(cold, HASH))

    def rows(side: str, other: str) -> DataFrame:
        links = F.col(f"rows_{other}") - F.col(f"n_{other}")
        return members.where((F.col(f"n_{side}") > 0) & (links > 0)).select(
            F.lit(side).alias("side"), PATH, HASH, F.col(f"size_{side}").alias(SIZE), "class_path", F.col(f"n_{side}").alias("copies"), links.alias("n_links")
        )

    return rows(*SIDES).unionByName(rows(*reversed(SIDES)))
