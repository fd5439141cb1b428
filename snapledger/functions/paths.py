"""Path columns. A path uses ``/``; the directory of a top-level name is ``.``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fingerprint import as_column


def basename(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def dirname(path: Column | str) -> Column:
    path = as_column(path)
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(path.contains("/"), path.substr(F.lit(1), cut)).otherwise(F.lit("."))


def ancestors(directory: Column | str) -> Column:
    """A directory and all above it, up to ``.``, as an array."""
    parts = F.split(as_column(directory), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(as_column(directory) == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), above))


def relative_to(path: Column | str, base: str) -> Column:
    """Strip ``base`` from paths below it; other paths are left alone."""
    path, prefix = as_column(path), base.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(len(prefix) + 1, 2**31 - 1)).otherwise(path)


def dir_starts_with(path: Column | str, prefix: str, boundary: bool = False) -> Column:
    """Does the *directory* of ``path`` start with ``prefix``?

    Stated on the path itself, without cutting the directory out first: the
    path starts with the prefix and has a ``/`` at or after its end. The first
    half is a predicate the Parquet reader understands. With ``boundary`` the
    prefix must end at a path component.
    """
    path = as_column(path)
    if boundary:
        return path.startswith(prefix + "/")
    return path.startswith(prefix) & (F.locate("/", path, len(prefix) + 1) > 0)


def name_ends_with(path: Column | str, suffix: str) -> Column:
    """Does the base name end with ``suffix``? A suffix with ``/`` never matches."""
    return F.lit(False) if "/" in suffix else as_column(path).endswith(suffix)
