"""Exclusion by a table of rules, for lists too long to be written into a plan.

The rows are those of ``exclude`` with the same rules. A rule about directories is compared with prefixes of distinct directories, which are
far fewer than files and found map-side; a rule about names with the ends of names. Both are equalities, of as many
characters as the rules have, so they join by hash whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import PATH, as_column
from ..functions.paths import dirname
from ..sources.store import stored
from .skew import key_counts, looked_up

KIND, RULE = "kind", "rule"
BY_PATH, BY_SUFFIX = "path", "suffix"


def normalised(rules: DataFrame) -> DataFrame:
    """Distinct (kind, rule) with the rules of ``exclude``: ``*.ext`` is ``.ext``, ``./dir/`` is ``dir``. One that drops everything is refused."""
    plain = F.when(F.col(KIND) == BY_PATH, F.regexp_replace(RULE, r"^\./?|/\z", "")).otherwise(F.regexp_replace(RULE, r"^\*", ""))
    found = stored(rules.where(F.col(RULE).isNotNull()).select(KIND, plain.alias(RULE)).distinct(), "rules")
    known = F.col(KIND).isin(BY_PATH, BY_SUFFIX)
    empty = (F.col(RULE) == "") | ((F.col(KIND) == BY_PATH) & (F.col(RULE) == "."))
    bad = found.where(~F.coalesce(known, F.lit(False)) | empty).first()
    if bad:
        raise ValueError(f"no rule, or one that is empty after normalisation and would drop everything: {bad.asDict()}")
    return found


def _lengths(rules: DataFrame, kind: str) -> list[int]:
    """Lengths that rules of a kind have: no more than a path can have characters, however many rules there are."""
    return sorted(r[0] for r in rules.where(F.col(KIND) == kind).select(F.length(RULE)).distinct().collect())


def _dropped_directories(own: DataFrame, rules: DataFrame, boundary: bool) -> DataFrame:
    """The directories of ``own`` that a rule drops."""
    lengths = F.array(*(F.lit(n) for n in _lengths(rules, BY_PATH)))
    directory = F.col("directory")

    def fits(n: Column) -> Column:
        whole = F.length(directory) >= n
        return whole & ((F.length(directory) == n) | (directory.substr(n + 1, F.lit(1)) == "/")) if boundary else whole

    prefixes = own.select("directory", F.explode(F.filter(lengths, fits)).alias("n"))
    prefixes = prefixes.select("directory", directory.substr(F.lit(1), F.col("n")).alias(RULE))
    wanted = rules.where(F.col(KIND) == BY_PATH).select(RULE)
    return prefixes.join(wanted, RULE, "left_semi").select("directory").distinct()


def exclude_listed(rows: DataFrame, rules: DataFrame, boundary: bool = False, key: Column | str = PATH) -> DataFrame:
    """Keep the rows that no rule of a table (kind, rule) drops; kinds are ``path`` and ``suffix``.

    Apply it before fingerprinting: excluded content is then never hashed. Rows without a key are kept. A top-level name is in directory
    ``.``, which no rule matches; a suffix with ``/`` never matches. Null rules and an empty table drop nothing. Distinct
    directories and names' ends are counted and stored first; content is read once, and shuffled only where very many of them are dropped.
    """
    key, columns = as_column(key), rows.columns
    rules = normalised(rules)
    if _lengths(rules, BY_PATH):
        # A top-level name has no directory that a rule could drop.
        rows = rows.withColumn("_directory", F.when(key.contains("/"), dirname(key)))
        own = stored(key_counts(rows, ["_directory"]), "directories")
        dropped = _dropped_directories(own.select(F.col("_directory").alias("directory")), rules, boundary)
        own = own.join(dropped.select(F.col("directory").alias("_directory"), F.lit(True).alias("_dropped")), "_directory", "left")
        rows = looked_up(rows, ["_directory"], stored(own, "verdicts"), "_dropped", key).where("_dropped is null").select(*columns)
    lengths = _lengths(rules, BY_SUFFIX)
    if lengths:
        ends = F.array(*(F.struct(F.lit(n).alias("n"), _end(key, n).alias("_end")) for n in lengths))
        ends = key_counts(rows.select(F.explode(ends).alias("end")).select("end.*"), ["n", "_end"])
        dropped = rules.where((F.col(KIND) == BY_SUFFIX) & ~F.col(RULE).contains("/")).select(F.col(RULE).alias("_end"), F.lit(True).alias("_dropped"))
        ends = stored(ends.join(dropped, "_end", "left"), "ends")
        # Lengths of ends that drop something, of the few that rules have.
        for n in sorted(r[0] for r in ends.where("_dropped").select("n").distinct().collect()):
            own = ends.where(F.col("n") == n).drop("n")
            rows = looked_up(rows.withColumn("_end", _end(key, n)), ["_end"], own, "_dropped", key).where("_dropped is null").select(*columns)
    return rows


def _end(key: Column, n: int) -> Column:
    return F.when(F.length(key) >= n, F.right(key, F.lit(n)))
