"""Scan counters and the figures derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.fingerprint import FULL, PATH, PREFIX_BYTES, SIZE, bytes_to_read
from ..functions.paths import dirname


def _sums(mode: str, prefix_bytes: int) -> list[Column]:
    total = F.coalesce(F.sum(SIZE), F.lit(0))
    read = F.coalesce(F.sum(bytes_to_read(SIZE, mode, prefix_bytes)), F.lit(0))
    return [
        F.count(F.lit(1)).alias("files"),
        total.alias("bytes_total"),
        read.alias("bytes_read"),
        (total - read).alias("bytes_avoided"),
    ]


def scan_counters(snapshot: DataFrame, mode: str = FULL, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """Files, directories that hold them, bytes in total, read and avoided."""
    return snapshot.agg(
        F.countDistinct(dirname(PATH)).alias("directories"), *_sums(mode, prefix_bytes)
    )


def bytes_avoided(snapshot: DataFrame, mode: str, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """What a cheaper mode did not have to read, in bytes and MB of 10^6 bytes."""
    sums = snapshot.agg(*_sums(mode, prefix_bytes))
    return sums.select(
        "bytes_total", "bytes_avoided", (F.col("bytes_avoided") / 1_000_000).alias("mb_avoided")
    )


def observe_counters(
    snapshot: DataFrame, name: str = "scan", mode: str = FULL, prefix_bytes: int = PREFIX_BYTES
) -> tuple[DataFrame, Observation]:
    """Count while the snapshot is written; no second pass over the content."""
    seen = Observation(name)
    return snapshot.observe(seen, *_sums(mode, prefix_bytes)), seen


def throughput(counters: DataFrame, seconds: float) -> DataFrame:
    """Rates of a finished scan: minutes past five minutes, files per minute under five a second."""
    took, per_second = F.lit(float(seconds)), F.col("files") / F.lit(float(seconds))
    long_run, slow = took > 300, per_second < 5
    return counters.withColumns(
        {
            "mb_read": F.col("bytes_read") / 1_000_000,
            "mb_per_second": F.col("bytes_read") / 1_000_000 / took,
            "elapsed": F.when(long_run, took / 60).otherwise(took),
            "elapsed_unit": F.when(long_run, "minutes").otherwise("seconds"),
            "file_rate": F.when(slow, per_second * 60).otherwise(per_second),
            "file_rate_unit": F.when(slow, "minute").otherwise("second"),
        }
    )
