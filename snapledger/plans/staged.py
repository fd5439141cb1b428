"""Duplicate files of a tree with as little reading as possible.

Equal files have equal sizes and equal prefixes. So only files whose size
occurs twice are opened, and only those whose size and prefix digest occur
twice are read to the end. The report equals that of a full snapshot.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import FULL, HASH, PARTIAL, PATH, PREFIX_BYTES, SHA256, SIZE, fully_hashed
from ..operators.duplicates import duplicates, rows_sharing
from ..sources.history import VOLUME
from ..sources.store import stored
from ..sources.tree import FILE, hash_files, list_trees


def duplicate_files(
    spark: SparkSession,
    root: str,
    prefix_bytes: int = PREFIX_BYTES,
    exclude_suffixes: Iterable[str] | None = None,
    exclude_paths: Iterable[str] | None = None,
    boundary: bool = False,
    algo: str = SHA256,
) -> DataFrame:
    listing = list_trees(spark, {root: root}, None, exclude_suffixes, exclude_paths, boundary)
    files = listing.where(F.col("kind") == FILE)

    def hashed(some: DataFrame, mode: str) -> DataFrame:
        read = hash_files(some, mode, prefix_bytes, algo)
        return stored(read.where("error is null").select(PATH, HASH, SIZE), mode)

    same_size = stored(rows_sharing(files, [SIZE], [VOLUME, "root", "location", PATH, SIZE]), "same-size")
    same_prefix = stored(duplicates(hashed(same_size, PARTIAL), HASH, with_size=True), "same-prefix")
    covered = fully_hashed(SIZE, prefix_bytes)
    longer = stored(same_size.join(same_prefix.where(~covered).select(PATH), PATH, "left_semi"), "longer")
    return same_prefix.where(covered).select(HASH, PATH, SIZE).unionByName(duplicates(hashed(longer, FULL), HASH))
