"""Exclusion rules: by directory prefix and by name suffix."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

from ..functions.fingerprint import PATH, as_column
from ..functions.paths import dir_starts_with, name_ends_with


def suffix_rules(rules: Iterable[str] | None) -> list[str]:
    """``*.ext`` means ``.ext``; repeated rules collapse. A rule matching every name is refused."""
    return _distinct((r.removeprefix("*") for r in rules or ()), refuse={""})


def path_rules(rules: Iterable[str] | None) -> list[str]:
    """Drop a leading ``./`` or ``.`` and a trailing ``/``. A rule matching every directory is refused."""
    return _distinct((re.sub(r"^\./?|/$", "", r) for r in rules or ()), refuse={"", "."})


def _distinct(rules: Iterable[str], refuse: set[str]) -> list[str]:
    found = list(dict.fromkeys(rules))
    if refuse.intersection(found):
        raise ValueError("an exclusion rule is empty after normalisation and would drop everything")
    return found


def exclude(
    rows: DataFrame,
    suffixes: Iterable[str] | None = None,
    paths: Iterable[str] | None = None,
    boundary: bool = False,
    key: Column | str = PATH,
) -> DataFrame:
    """Keep the rows no rule drops.

    Apply it before fingerprinting: the filter then runs below the digest, so
    excluded content is never hashed. Rows without a key are kept.
    """
    key = as_column(key)
    drops = [dir_starts_with(key, p, boundary) for p in path_rules(paths)]
    drops += [name_ends_with(key, s) for s in suffix_rules(suffixes)]
    for drop in drops:
        rows = rows.where(~drop | key.isNull())
    return rows
