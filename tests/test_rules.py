"""Rule tables drop the rows that the same rules drop as literals."""

import random

import pytest
import snapledger as sl
from pyspark.sql import functions as F

SCHEMA = "kind string, rule string"


@pytest.mark.parametrize("boundary", [False, True])
def test_same_rows_as_literals(spark, boundary):
    rng = random.Random(3)
    parts = ["a", "ab", "src1", "src10", ".git", "x y", "ü"]
    paths = {"/".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(80)}
    names = [f"{p}/{n}" if p else n for p in paths for n in ("f.txt", "ab", "g.tar.gz", ".hidden", "ü.é")]
    rows = spark.createDataFrame([(n, "x", i) for i, n in enumerate([*names, None])], "relative_path string, rule string, kind int")
    for _ in range(6):
        dirs = rng.sample(["./src1/", "a", "./a/ab/", ".git", "x y/", "ü/ü", "ab/", "a/b", "nothing/"], 4)
        ends = rng.sample(["*.txt", ".gz", "b", "*.é", "a/f.txt", "hidden", "nothing"], 3)
        rules = spark.createDataFrame([("path", d) for d in dirs] + [("suffix", e) for e in ends] + [("path", None)], SCHEMA)
        got = sl.exclude_listed(rows, rules, boundary)
        assert got.columns == rows.columns
        want = sl.exclude(rows, suffixes=ends, paths=dirs, boundary=boundary)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).select(F.lit("path").alias("kind"), F.concat(F.lit("./dir"), "id", F.lit("/")).alias("rule"))
    more = spark.createDataFrame([("suffix", "*.tmp")], SCHEMA)
    rows = spark.range(200_000).select(F.concat(F.lit("dir"), F.col("id") * 3, F.lit("/sub/f"), F.when(F.col("id") % 2 == 0, ".tmp").otherwise(".txt")).alias("relative_path"))
    kept = sl.exclude_listed(rows, rules.unionByName(more), boundary=True)
    assert kept.count() == sum(1 for i in range(200_000) if i % 2 and 3 * i >= 100_000)


def test_few_or_bad_rules(spark, frame, rows):
    some = frame(("a/b", "1", 1), ("c", "1", 1))
    assert rows(sl.exclude_listed(some, spark.createDataFrame([], SCHEMA))) == rows(some)
    assert sl.exclude_listed(frame(), spark.createDataFrame([("path", "a")], SCHEMA)).count() == 0
    for bad in (("path", "./"), ("path", ""), ("suffix", "*"), ("other", "x")):
        with pytest.raises(ValueError):
            sl.exclude_listed(some, spark.createDataFrame([bad], SCHEMA))
