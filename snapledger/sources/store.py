"""Stored snapshots: Parquet in a folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import PATH


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set on the context as checkpoint folder.

    Only a local session with neither gets a folder of its own; on a cluster a
    machine-local folder would be invisible to other executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="snapledger-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/snapledger/{label}-{uuid.uuid4().hex}"


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write Parquet in files of even size.

    A scan of a large table ends in as many tasks as the table has splits, and
    a snapshot is a small fraction of its content: written as it comes, it
    would be a swarm of tiny files. The rebalance hint lets AQE merge small
    partitions and split those of a volume that holds most rows.
    """
    keys = partition_by or [PATH]
    writer = df.hint("rebalance", *(F.col(k) for k in keys)).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored(df: DataFrame, label: str = "stored", compact: bool = False) -> DataFrame:
    """Write a result once and go on from the copy.

    Analyses that read a snapshot several times then never fingerprint content
    again, and a lost executor costs a re-read rather than a re-computation.
    ``compact`` writes files of even size, for a snapshot computed by the many
    small tasks of a content scan. The folder stays until its owner removes it.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    if compact:
        write_snapshot(df, path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """A snapshot table hashed and sorted by path, for repeated comparison.

    Two tables of equal bucket count compare without a shuffle, when the
    comparison is told that no path is null. Null paths are refused here.
    """
    checked = df.withColumn(
        PATH, F.coalesce(F.col(PATH), F.raise_error(F.lit("a bucketed snapshot needs a path in every row")))
    )
    (
        checked.repartition(buckets, PATH)
        .write.bucketBy(buckets, PATH)
        .sortBy(PATH)
        .option("path", path)
        .mode(mode)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)
