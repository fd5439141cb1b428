"""Snapshots of table rows: one ``(relative_path, hash, file_size_bytes)`` row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import (
    FULL,
    HASH,
    PARTIAL,
    PATH,
    PREFIX_BYTES,
    SIZE,
    SIZE_ONLY,
    as_column,
    byte_size,
    check_mode,
    content_hash,
    full_hash,
    fully_hashed,
    hash_tag,
    prefix_hash,
    require_same_tag,
)


def snapshot(
    rows: DataFrame,
    key: Column | str,
    content: Column | str | None = None,
    mode: str = FULL,
    prefix_bytes: int = PREFIX_BYTES,
    size: Column | str | None = None,
) -> DataFrame:
    """Fingerprint every row: a narrow projection, no shuffle.

    ``size`` names a stored size column; with it, a size-only snapshot never
    reads the content column.
    """
    check_mode(mode)
    if content is None and (size is None or mode != SIZE_ONLY):
        raise ValueError("content is needed unless a size column serves a size-only snapshot")
    sized = as_column(size).cast("long") if size is not None else byte_size(content)
    return rows.select(
        as_column(key).cast("string").alias(PATH),
        content_hash(content, mode, prefix_bytes).alias(HASH, metadata=hash_tag(mode, prefix_bytes)),
        sized.alias(SIZE),
    )


def fingerprint_levels(
    rows: DataFrame,
    key: Column | str,
    content: Column | str,
    mode: str = FULL,
    prefix_bytes: int = PREFIX_BYTES,
) -> DataFrame:
    """All levels of detail per row: size, prefix digest, whether that covers the content, full digest.

    Levels a mode does not compute are null. Short content is digested once:
    its prefix digest is its full digest.
    """
    check_mode(mode)
    none = F.lit(None).cast("string")
    size = byte_size(content)
    covered = fully_hashed(size, prefix_bytes)
    partial, full, flag = none, none, F.lit(None).cast("boolean")
    if mode == FULL:
        full = full_hash(content)
        partial = F.when(covered, full).otherwise(prefix_hash(content, prefix_bytes))
        flag = covered
    elif mode == PARTIAL:
        partial, flag = prefix_hash(content, prefix_bytes), covered
    return rows.select(
        as_column(key).cast("string").alias(PATH),
        size.alias(SIZE),
        partial.alias("partial_hash"),
        flag.alias("fully_hashed"),
        full.alias("full_hash"),
    )


def concat(*snapshots: DataFrame) -> DataFrame:
    """All rows of all snapshots, by column name; absent columns become null."""
    if not snapshots:
        raise ValueError("nothing to concatenate")
    require_same_tag(*snapshots)
    merged = snapshots[0]
    for other in snapshots[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
