"""A corpus pipeline: five operators, each reading what the one before stored.

Toxic texts go, one document of each near-duplicate group stays, documents that hold a benchmark passage go,
secrets are masked, and what is left is segmented into pieces.
"""

from __future__ import annotations

import pathlib
import sys
from collections.abc import Callable

ROOT = pathlib.Path(__file__).resolve().parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from snapledger.llm import contamination, minhash, secrets, segment, toxicity  # noqa: E402
from snapledger.sources.ship import ship  # noqa: E402
from snapledger.sources.store import stored  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score a half or more go; learnt from the labels outside the held-out fold."""
    ship(spark)
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group linked by five-word shingles at a similarity of 0.8, the document of the smallest id stays."""
    ship(spark)
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item, or a shorter item whole, occur go."""
    ship(spark)
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what was found in its text is masked, and n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def segment_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, as ids with their scores."""
    ship(spark)
    found = segment.segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)
    return found.drop("decoded").withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("segmentation", segment_texts),
]
# Learned scores, randomness tests and sampled segmentations are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each reading what the one before stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
