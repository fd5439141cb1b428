"""Snapshots and reports as tab-separated text, for interchange.

Dialect: header row, tab between fields, fields in double quotes, a backslash
before quotes and backslashes; numbers quoted or, if so wanted, bare. Plain files are read in
parallel, see ``records``; gzip cannot be split, so keep large snapshots in Parquet.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.fingerprint import HASH, PATH, SIZE, SIZE_ONLY, check_mode, tagged
from ..operators.snapshot import concat
from .records import read_records, write_records

log = logging.getLogger(__name__)

# File suffix and the codec Spark writes for it.
CODECS = {".gz": "gzip", ".bz2": "bzip2"}
UNWRITABLE = (".zip", ".xz", ".zst", ".zstd", ".7z", ".lz4", ".br")

# A file that does not fit the stated schema, in its header or its fields, fails the query.
DIALECT = {"sep": "\t", "header": True, "escape": "\\"}
READ_DIALECT = DIALECT | {"mode": "FAILFAST", "enforceSchema": False}


def hash_column(mode: str) -> str:
    """What a text file calls the hash column. A size-only file keeps the plain name."""
    return HASH if check_mode(mode) == SIZE_ONLY else mode.replace("-", "_")


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old!r} among {df.columns}; was the file written in another mode?")
    return df.withColumnRenamed(old, new)


def write_tsv(df: DataFrame, path: str, mode: str, ordered: bool = False, quote_numbers: bool = True) -> None:
    """Write a folder of part files; an empty report still has its header.

    The suffix of ``path`` chooses the compression. ``ordered`` sorts the rows,
    so that duplicates of one another are adjacent. ``quote_numbers=False`` quotes text only, which Spark's own
    writer cannot; its part files are named ``.txt``. Both kinds are read alike.
    """
    if path.rstrip("/").endswith(UNWRITABLE):
        raise ValueError(f"no codec for the suffix of {path!r}; .gz and .bz2 are written, or nothing")
    if ordered:
        df = df.orderBy(*(c for c in (HASH, SIZE, PATH) if c in df.columns))
    if HASH in df.columns:
        df = rename_column(df, HASH, hash_column(mode))
    codec = next((codec for suffix, codec in CODECS.items() if path.endswith(suffix)), "none")
    if not quote_numbers:
        write_records(df, path, codec)
        return
    df.write.options(
        **DIALECT,
        quoteAll=True,
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        compression=codec,
    ).csv(path)


def read_tsv(
    spark: SparkSession,
    paths: str | Iterable[str],
    mode: str,
    multiline: bool = True,
    tag: dict | None = None,
) -> DataFrame:
    """Read snapshots and concatenate them; types are stated, never inferred.

    Each file may order its columns in its own way. A file without the hash
    column of ``mode`` is refused. ``multiline=False`` leaves them to Spark's own reader
    of lines, for paths without line breaks. ``tag`` states how the hashes were
    made (``prefix_bytes``, ``algo``), which text cannot carry.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    merged = concat(*(_read_one(spark, p, mode, multiline) for p in paths))
    return tagged(merged, mode, **tag) if tag is not None else merged


def _read_one(spark: SparkSession, path: str, mode: str, multiline: bool) -> DataFrame:
    names = spark.read.options(**DIALECT, multiLine=multiline).csv(path).columns
    if hash_column(mode) not in names:
        raise ValueError(f"no column {hash_column(mode)!r} in {path}; was it written in another mode?")
    if multiline:
        rows = read_records(spark, path, names)
    else:
        schema = T.StructType([T.StructField(n, T.LongType() if n == SIZE else T.StringType()) for n in names])
        rows = spark.read.schema(schema).options(**READ_DIALECT).csv(path)
    return rename_column(rows, hash_column(mode), HASH).select(
        *(c for c in (PATH, HASH, SIZE) if c in [HASH, *names])
    )


def write_merged(merged: DataFrame, inputs: list[str], path: str, mode: str) -> bool:
    """Write concatenated inputs; with a single input there is nothing new to write."""
    if len(inputs) == 1:
        log.info("%s would equal %s; not written", path, inputs[0])
        return False
    write_tsv(merged, path, mode)
    return True
