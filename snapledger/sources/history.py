"""Snapshot history: stored rows of every run, and a register of the runs.

A call of ``add_runs`` is an attempt with a folder of its own, ``rows/<attempt>/run_key=...``, that nothing else ever writes to. The
register, one small file per attempt, is written last and by one task, so it appears at once or not at all. Readers know
runs by the register alone, the latest attempt of each. An attempt that failed before it registered is never seen, repeating a run
replaces it the moment the register says so, and nothing that a reader may hold is deleted.

The register also says how many rows a run has, so a volume that was emptied is compared like any other, and a comparison names
the folders of its runs by itself, however many others are stored.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fingerprint import HASH, HASHED_AT, MTIME, PATH, SIZE, tag_of
from .tsv import READ_DIALECT, hash_column

VOLUME, RUN, BASELINE = "volume", "run_id", "baseline_run_id"
TAG, BASELINE_TAG = "hash_tag", "baseline_hash_tag"
ATTEMPT, RUN_KEY, N_FILES = "attempt", "run_key", "n_files"

# Fixed value: how dated snapshot files are named, as run, volume, suffix. A run begins with its date; the
# volume is all that follows, dashes included.
SERIES_NAME = r"/(\d{4}-\d{2}-\d{2}[^-/]*)-([^/]+)-hashes\.tsv(?:\.gz|\.bz2)?(?:/[^/]*)?$"

_RUN_FIELDS = [T.StructField(VOLUME, T.StringType()), T.StructField(RUN, T.StringType())]
RUNS = T.StructType(
    [
        *_RUN_FIELDS,
        T.StructField(TAG, T.StringType()),
        T.StructField(ATTEMPT, T.StringType()),
        T.StructField(N_FILES, T.LongType()),
    ]
)
# Runs stored without times have them as null.
ROWS = T.StructType(
    [
        T.StructField(PATH, T.StringType()),
        T.StructField(HASH, T.StringType()),
        T.StructField(SIZE, T.LongType()),
        T.StructField(MTIME, T.TimestampType()),
        T.StructField(HASHED_AT, T.TimestampType()),
        *_RUN_FIELDS,
    ]
)


class History(NamedTuple):
    """A history's folder, and its register: one row per run, that of the latest attempt."""

    spark: SparkSession
    path: str
    runs: DataFrame

    @property
    def rows(self) -> DataFrame:
        """Rows of all runs."""
        return rows_of_runs(self, self.runs).select(*ROWS.names)


def _run_key() -> Column:
    """A folder name for a run, whatever its volume and run are called. A digest, so no two runs share one."""
    return F.sha2(F.to_json(F.struct(VOLUME, RUN)), 256)


def add_runs(rows: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Store snapshot rows that carry ``volume`` and ``run_id``, and possibly times.

    ``runs`` lists their ``(volume, run_id)`` pairs, and must do so where a run
    may have no rows. Rebalancing by run keeps files large and splits a volume that holds most rows.
    """
    spark = rows.sparkSession
    # The time puts attempts in order; the rest tells two of one moment apart.
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    folder = f"{path}/rows/{attempt}"
    times = [F.col(c) if c in rows.columns else F.lit(None).cast("timestamp").alias(c) for c in (MTIME, HASHED_AT)]
    kept = rows.select(PATH, HASH, SIZE, *times, VOLUME, RUN).withColumn(RUN_KEY, _run_key())
    kept.hint("rebalance", F.col(RUN_KEY)).write.partitionBy(RUN_KEY).parquet(folder)
    written = spark.read.schema(ROWS).parquet(folder).groupBy(VOLUME, RUN).agg(F.count(F.lit(1)).alias(N_FILES))
    if runs is not None:
        same = [F.col(f"listed.{c}").eqNullSafe(F.col(f"written.{c}")) for c in (VOLUME, RUN)]
        listed = runs.select(VOLUME, RUN).distinct().alias("listed")
        written = listed.join(written.alias("written"), same[0] & same[1], "left").select("listed.*", N_FILES)
    tag = json.dumps(tag_of(rows), sort_keys=True)
    register = written.select(
        VOLUME, RUN, F.lit(tag).alias(TAG), F.lit(attempt).alias(ATTEMPT), F.coalesce(N_FILES, F.lit(0)).cast("long").alias(N_FILES)
    )
    register.repartition(1).write.mode("append").parquet(f"{path}/runs")


def pairs(spark: SparkSession, volumes: list[str], run_id: str) -> DataFrame:
    """One run of each of the given volumes."""
    return spark.createDataFrame([(v, run_id) for v in volumes], f"{VOLUME} string, {RUN} string")


def add_run(snapshot: DataFrame, path: str, volume: str, run_id: str) -> None:
    rows = snapshot.withColumns({VOLUME: F.lit(volume), RUN: F.lit(run_id)})
    add_runs(rows, path, pairs(snapshot.sparkSession, [volume], run_id))


def read_history(spark: SparkSession, path: str) -> History:
    """The stored history. Volume and run stay text, whatever they look like."""
    registered = spark.read.schema(RUNS).parquet(f"{path}/runs")
    latest = registered.groupBy(VOLUME, RUN).agg(F.max_by(F.struct(TAG, ATTEMPT, N_FILES), ATTEMPT).alias("last"))
    return History(spark, path, latest.select(VOLUME, RUN, *(F.col(f"last.{c}").alias(c) for c in (TAG, ATTEMPT, N_FILES))))


def replaced_attempts(history: History) -> DataFrame:
    """Registered attempts of runs that a later attempt replaced: (volume, run_id, attempt). No reader starts on them any more."""
    registered = history.spark.read.schema(RUNS).parquet(f"{history.path}/runs").select(VOLUME, RUN, ATTEMPT)
    return registered.exceptAll(history.runs.select(VOLUME, RUN, ATTEMPT))


def _named(path: Column) -> list[Column]:
    """Volume and run that the name of a series file gives; any other name fails the query."""
    bad = F.raise_error(F.concat(F.lit("not the name of a dated snapshot: "), path)).cast("string")
    fields = ((2, VOLUME), (1, RUN))
    return [F.when(path.rlike(SERIES_NAME), F.regexp_extract(path, SERIES_NAME, i)).otherwise(bad).alias(c) for i, c in fields]


def import_series(spark: SparkSession, folder: str, path: str, mode: str) -> None:
    """Add a folder of dated text snapshots, ``<run>-<volume>-hashes.tsv[.gz]``, to the history.

    Each may be a single file or a folder of part files. All are read in one
    job, one task per file; run and volume come from the name.
    """
    files = f"{folder.rstrip('/')}/*-hashes.tsv*"
    schema = [T.StructField(PATH, T.StringType()), T.StructField(hash_column(mode), T.StringType())]
    schema = T.StructType([*schema, T.StructField(SIZE, T.LongType())])
    rows = (
        spark.read.schema(schema)
        .options(**READ_DIALECT, multiLine=True)
        .csv(files)
        .select(
            PATH,
            F.col(hash_column(mode)).alias(HASH),
            SIZE,
            *_named(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))),
        )
    )
    listed = spark.read.format("binaryFile").load(files)
    runs = listed.select(*_named(F.col("path")))
    add_runs(rows, path, runs.distinct())


def ranked_runs(history: History, as_of: str | None = None) -> DataFrame:
    """Runs per volume (up to ``as_of``), the latest first, each with the one before it.

    Run names start with their date, so their order is chronological. The
    window sees one row per stored run, not per file.
    """
    runs = history.runs
    if as_of is not None:
        runs = runs.where(F.col(RUN) <= as_of)
    by_run = W.partitionBy(VOLUME).orderBy(F.desc(RUN))
    return runs.select(
        VOLUME,
        RUN,
        TAG,
        F.lead(RUN).over(by_run).alias(BASELINE),
        F.lead(TAG).over(by_run).alias(BASELINE_TAG),
        F.row_number().over(by_run).alias("nth"),
    )


def latest_runs(ranked: DataFrame) -> DataFrame:
    """Latest run of every volume and its baseline, null when there is none."""
    return ranked.where("nth = 1").select(VOLUME, RUN, BASELINE)


def require_comparable(ranked: DataFrame) -> None:
    """Refuse a latest run whose hashes were made differently from its baseline's; untagged ones are trusted."""
    untagged = json.dumps({})
    clash = ranked.where(
        (F.col("nth") == 1)
        & (F.col(TAG) != F.col(BASELINE_TAG))
        & (F.col(TAG) != untagged)
        & (F.col(BASELINE_TAG) != untagged)
    ).first()
    if clash:
        raise ValueError(f"runs hold hashes of different kinds: {clash.asDict()}")


def rows_of_runs(history: History, runs: DataFrame) -> DataFrame:
    """History rows of the given ``(volume, run_id)`` pairs.

    Their folders are taken from the register, so that planning lists these and no others: the driver holds one name a run, and a
    comparison has two runs a volume at most. Rows of different volumes are in different folders, none shuffles by its volume.
    """
    wanted = runs.select(VOLUME, RUN).alias("wanted")
    same = [F.col(f"wanted.{c}").eqNullSafe(F.col(f"known.{c}")) for c in (VOLUME, RUN)]
    known = history.runs.where(F.col(N_FILES) > 0).withColumn(RUN_KEY, _run_key()).alias("known")
    folders = known.join(wanted, same[0] & same[1], "left_semi").select(ATTEMPT, RUN_KEY).collect()
    if not folders:
        return history.spark.createDataFrame([], ROWS)
    return history.spark.read.schema(ROWS).parquet(*(f"{history.path}/rows/{r[ATTEMPT]}/{RUN_KEY}={r[RUN_KEY]}" for r in folders))


def current_and_baseline(history: History, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each volume's latest run, and of its baseline.

    Volumes without a baseline are in neither: they have nothing to compare.
    """
    paired = runs.where(F.col(BASELINE).isNotNull())
    earlier = paired.select(VOLUME, F.col(BASELINE).alias(RUN))
    return rows_of_runs(history, paired).drop(RUN), rows_of_runs(history, earlier).drop(RUN)
