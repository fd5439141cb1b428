"""Fingerprint columns: content or prefix digest, byte size, bytes to read.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names, mode names, default prefix length, placeholder.
PATH = "relative_path"
HASH = "hash"
SIZE = "file_size_bytes"
MTIME = "mtime"
HASHED_AT = "hashed_at"
FULL = "full-hash"
PARTIAL = "partial-hash"
SIZE_ONLY = "file-size"
MODES = (FULL, PARTIAL, SIZE_ONLY)
PREFIX_BYTES = 1_000_000
NOT_COMPUTED = "not_computed"

SHA256 = "sha256"


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {', '.join(MODES)}")
    return mode


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_size(content: Column | str) -> Column:
    """Length in bytes (not characters)."""
    return F.octet_length(as_column(content)).cast("long")


def full_hash(content: Column | str) -> Column:
    return F.sha2(as_column(content).cast("binary"), 256)


def prefix_hash(content: Column | str, prefix_bytes: int = PREFIX_BYTES) -> Column:
    """Digest of the first ``prefix_bytes`` bytes; the cut may fall inside a character."""
    return F.sha2(F.substring(as_column(content).cast("binary"), 1, prefix_bytes), 256)


def fully_hashed(size: Column | str, prefix_bytes: int = PREFIX_BYTES) -> Column:
    """True where a prefix digest covers the whole content."""
    return as_column(size) <= F.lit(prefix_bytes)


def content_hash(content: Column | str, mode: str, prefix_bytes: int = PREFIX_BYTES) -> Column:
    """The value of the ``hash`` column for one mode."""
    check_mode(mode)
    if mode == SIZE_ONLY:
        return F.lit(NOT_COMPUTED)
    if mode == PARTIAL:
        return prefix_hash(content, prefix_bytes)
    return full_hash(content)


def bytes_to_read(size: Column | str, mode: str, prefix_bytes: int = PREFIX_BYTES) -> Column:
    """Bytes a scan in this mode has to read from one source record."""
    check_mode(mode)
    size = as_column(size)
    if mode == SIZE_ONLY:
        return F.lit(0).cast("long")
    if mode == PARTIAL:
        return F.least(size, F.lit(prefix_bytes).cast("long"))
    return size


def hash_tag(mode: str, prefix_bytes: int = PREFIX_BYTES, algo: str = SHA256) -> dict:
    """How a hash column was made, kept as column metadata.

    Metadata travels with the column through DataFrame operations and Parquet
    footers, so incompatible snapshots are refused while planning, at no cost
    per row.
    """
    tag = {"compare_mode": check_mode(mode)}
    if mode != SIZE_ONLY:
        tag["hash_algo"] = algo
    if mode == PARTIAL:
        tag["prefix_bytes"] = prefix_bytes
    return tag


def tagged(df: DataFrame, mode: str, prefix_bytes: int = PREFIX_BYTES, algo: str = SHA256) -> DataFrame:
    """Attach a tag to a snapshot whose origin is known, such as an imported text file."""
    return df.withMetadata(HASH, hash_tag(mode, prefix_bytes, algo))


def tag_of(df: DataFrame) -> dict:
    return dict(df.schema[HASH].metadata) if HASH in df.columns else {}


def require_same_tag(*snapshots: DataFrame) -> None:
    """Refuse to compare hashes made differently; untagged snapshots are taken on trust."""
    tags = [t for t in map(tag_of, snapshots) if t]
    for other in tags[1:]:
        if other != tags[0]:
            raise ValueError(f"snapshots hold hashes of different kinds: {tags[0]} and {other}")
