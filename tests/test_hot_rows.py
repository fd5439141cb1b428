"""Rows of one value that holds most of a table are never sent to one task."""

import snapledger as sl
from pyspark.sql import functions as F
from snapledger.operators.skew import looked_up


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _largest(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def _paths(spark):
    """20,000 in one directory of few distinct endings, some without a directory, some without a name."""
    top, gone = F.concat(F.lit("top"), "id"), F.concat(F.lit("gone"), F.col("id") % 100, F.lit("/"), "id")
    name = F.when(F.col("id") % 49 == 0, top).when(F.col("id") % 7 == 0, gone).otherwise(F.concat(F.lit("pages/"), "id", F.lit(".html")))
    name = F.when(F.col("id") % 50 > 0, name)
    return spark.range(0, 20_000, 1, 4).select(name.alias("relative_path"))


def test_excluded_rows_stay_spread(spark, conf):
    rows = _paths(spark)
    rules = spark.createDataFrame([("path", f"gone{i}") for i in range(0, 100, 2)] + [("suffix", "*9"), ("suffix", "*.htm")], "kind string, rule string")
    want = sl.exclude(rows, suffixes=["*9", "*.htm"], paths=[f"gone{i}" for i in range(0, 100, 2)], boundary=True)
    want = sorted(map(repr, want.collect()))
    conf("spark.sql.adaptive.enabled", "false")
    for threshold in ("-1", "10000"):
        conf("spark.sql.autoBroadcastJoinThreshold", threshold)
        kept = sl.exclude_listed(rows, rules, boundary=True)
        assert sorted(map(repr, kept.collect())) == want
        assert _largest(kept) < 0.4 * len(want)
    assert "hashpartitioning(_directory" not in _plan(kept) and "hashpartitioning(_end" not in _plan(kept)


def test_large_groups_are_told_without_a_shuffle_by_group(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "10000")
    rows = sl.stored(spark.range(20_000).select(F.col("id").cast("string").alias("relative_path"), F.when(F.col("id") % 3 > 0, "hot").alias("hash"), F.lit(1).alias("file_size_bytes")))
    groups = sl.group_paths(rows, list_rows=500)
    assert "SortMergeJoin" not in _plan(groups)
    found = groups.collect()
    assert {(r["hash"], r["n_rows"]) for r in found} == {("hot", 13333), (None, 6667)}
    assert sorted(p for r in found for p in r["paths"]) == sorted(str(i) for i in range(20_000))
    assert len({(r["hash"], r["part"]) for r in found}) == len(found) > 30 and max(len(r["paths"]) for r in found) < 800


def test_looked_up_spreads_hot_rows_and_finds_all(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    # One key of most rows, null of some, and 30,000 keys of a row each.
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 75_000, 1, 4).select("id", key.alias("k"))
    counted = sl.stored(rows.groupBy("k").agg(F.count("*").alias("n_rows")).withColumn("v", F.when(~F.coalesce(F.col("k"), F.lit("hot")).endswith("7"), F.length(F.coalesce("k", F.lit(""))))))
    found = looked_up(rows, ["k"], counted, "v", F.col("id"))
    assert found.columns == ["id", "k", "v"] and _largest(found) < 30_000
    want = [(i, "hot" if i % 2 == 0 else None if i % 5 == 0 else str(i)) for i in range(75_000)]
    assert sorted((r["id"], r["k"], r["v"]) for r in found.collect()) == sorted(
        ((i, k, None if (k or "hot").endswith("7") else len(k or "")) for i, k in want), key=lambda r: r[0]
    )
