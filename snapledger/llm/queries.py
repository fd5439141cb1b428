"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.ship import ship
from . import contamination, licenses, lines, minhash, periods, prefixes, quality, secrets, segment, substrings, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


@_query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4)
    return found.withColumnsRenamed({"doc": "doc_id", "component": "component_id"})


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contamination.digest(contamination.contaminated(docs, items))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(_table(spark, sf_dir, "documents")))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


@_query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@_query
def op10_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return segment.digest(segment.segmentations(docs, _vocabulary("piece_bpe_32k.model"), k=2, check=True))


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return prefixes.trie(prefixes.rebuilt(prefixes.sequences(turns)))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periods.planted(docs.doc_id, docs.text).alias("text"))
    return periods.digest(periods.find_runs(docs)).withColumnRenamed("doc", "doc_id")


@_query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


ORACLE_SQL["op11_prefix_trie"] = prefixes.SQL
ORACLE_SQL["op13_line_dedup"] = lines.SQL
