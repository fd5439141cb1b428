"""Hot keys: find the few values that hold a large share of all rows.

At most ``MAX_HOT_KEYS - 1`` values can each hold more than
``1 / MAX_HOT_KEYS`` of the rows, whatever the data. So the set of hot keys is
small enough to broadcast at any scale, and any other key is small enough for
one shuffle partition. Counts are pre-aggregated map-side, so finding hot keys
is itself free of skew.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

MAX_HOT_KEYS = 20_000
N_ROWS = "n_rows"


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(N_ROWS))


def total_rows(rows: DataFrame) -> Column:
    """Number of rows, as a scalar subquery of the same plan. Over Parquet it reads footers only."""
    return rows.agg(F.count(F.lit(1))).scalar()


def is_hot(total: Column) -> Column:
    return F.col(N_ROWS) * F.lit(MAX_HOT_KEYS) > total


def broadcast_hot(keys: DataFrame) -> DataFrame:
    """Broadcast fewer than ``MAX_HOT_KEYS`` rows cut from an aggregate over all rows.

    The shuffle to one partition ends the stage that finds them, so that the
    broadcast, which has a timeout, only collects them.
    """
    return F.broadcast(keys.repartition(1))


def all_equal(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality over pairs of column names."""
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def looked_up(rows: DataFrame, keys: Sequence[str], counted: DataFrame, value: str, by: Column | str) -> DataFrame:
    """``rows`` with the column ``value`` that ``counted`` (keys, n_rows, value) has for their keys, or null.

    ``counted`` is stored, has distinct keys, which compare null-safely, and tells how many rows each has. Where few have a value, these are
    broadcast, and no row of ``rows`` is shuffled. Otherwise what is known of hot keys, be it that they have no
    value, is broadcast, and their rows are spread over the tasks of the join for the others, by a hash of ``by``.
    """
    columns, told = rows.columns, counted.where(F.col(value).isNotNull())
    if told.limit(MAX_HOT_KEYS + 1).count() <= MAX_HOT_KEYS:
        few = told.select(*(F.col(k).alias(f"_known_{k}") for k in keys), value)
        return rows.join(broadcast_hot(few), all_equal(rows, few, [(k, f"_known_{k}") for k in keys]), "left").select(*columns, value)
    hot = is_hot(counted.agg(F.sum(N_ROWS)).scalar())
    # The zero is stored, for the optimizer would take a literal out of the join's keys.
    known = counted.where(hot | F.col(value).isNotNull()).select(*keys, value, hot.alias("hot"), F.lit(0).cast("long").alias("spread"))
    known = stored(known, "looked-up")
    first = known.where("hot").select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.col(value).alias("_hot_value"), F.col("hot").alias("_hot"))
    rest = known.where("not hot").select(
        *(F.col(k).alias(f"_cold_{k}") for k in keys), F.col(value).alias("_cold_value"), F.col("spread").alias("_none")
    )
    rows = rows.join(broadcast_hot(first), all_equal(rows, first, [(k, f"_hot_{k}") for k in keys]), "left")
    by = F.col(by) if isinstance(by, str) else by
    rows = rows.withColumn("_spread", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(MAX_HOT_KEYS)) + 1).otherwise(F.lit(0)).cast("long"))
    same = all_equal(rows, rest, [(k, f"_cold_{k}") for k in keys]) & (rows["_spread"] == rest["_none"])
    return rows.join(rest, same, "left").select(*columns, F.coalesce("_hot_value", "_cold_value").alias(value))
