"""Snapshots of file trees, listed and hashed on the executors.

The tree must be visible to every executor: a shared mount (a plain path or a
``file:`` URI), or a URI that ``pyarrow.fs`` understands. Directories are
listed level by level, one row per directory, so that neither the driver nor a
single task ever walks the tree, whatever its shape; each level is stored, and
a lost executor costs only its own share. Hidden names and empty files count;
symbolic links are reported, never followed.
"""

from __future__ import annotations

import errno
import hashlib
import math
import os
import posixpath
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fingerprint import (
    FULL,
    HASH,
    HASHED_AT,
    MTIME,
    NOT_COMPUTED,
    PARTIAL,
    PATH,
    PREFIX_BYTES,
    SHA256,
    SIZE,
    SIZE_ONLY,
    bytes_to_read,
    check_mode,
    hash_tag,
)
from ..operators.exclude import path_rules, suffix_rules
from ..operators.metrics import throughput
from .history import VOLUME
from .store import new_folder, stored

FILE, DIRECTORY, LINK, UNREADABLE, VANISHED, OTHER = "file", "directory", "link", "unreadable", "vanished", "other"
NOT_FOUND, CHANGED = "not found", "changed while read"

READ_BLOCK = 1 << 20
ROWS_PER_BATCH = 4096
DIRECTORIES_PER_TASK = 64
BYTES_PER_TASK = 1 << 30
OPEN_COST = 1 << 16  # what opening a file counts for, in bytes, when files are dealt to tasks
READS = 3  # how often a file is read, if it changes meanwhile, before it is set aside

LISTING = f"{VOLUME} string, root string, location string, {PATH} string, kind string, {SIZE} long"
HASHED = (
    f"{VOLUME} string, {PATH} string, {HASH} string, {SIZE} long, bytes_read long, error string, "
    f"{MTIME} timestamp, {HASHED_AT} timestamp"
)


@dataclass
class TreeScan:
    """A finished scan of one or more trees, all of it in stored tables."""

    listing: DataFrame
    files: DataFrame
    mode: str
    prefix_bytes: int
    algo: str
    seconds: float = 0.0  # how long listing and hashing took

    @property
    def by_volume(self) -> DataFrame:
        """Snapshot rows with the volume they belong to."""
        return self.timed.drop(MTIME, HASHED_AT)

    @property
    def timed(self) -> DataFrame:
        """The same with each file's modification time, as it was when read, and the time of its hashing.

        Both are null in a size-only scan, which opens no file.
        """
        tag = hash_tag(self.mode, self.prefix_bytes, self.algo)
        hashed = F.col(HASH).alias(HASH, metadata=tag)
        return self.files.where("error is null").select(PATH, hashed, SIZE, VOLUME, MTIME, HASHED_AT)

    @property
    def snapshot(self) -> DataFrame:
        return self.by_volume.drop(VOLUME)

    @property
    def vanished(self) -> DataFrame:
        """Files that were listed, or nearly, but gone before they could be read."""
        unread = self.files.where(F.col("error") == NOT_FOUND).select(VOLUME, PATH)
        return self.listing.where(F.col("kind") == VANISHED).select(VOLUME, PATH).unionByName(unread)

    @property
    def unsettled(self) -> DataFrame:
        """Files that changed each time they were read. They have no hash and are in no snapshot."""
        return self.files.where(F.col("error") == CHANGED).select(VOLUME, PATH)

    @property
    def throughput(self) -> DataFrame:
        """Rates per volume, from the bytes truly read and the time that the scan of all volumes took."""
        return throughput(self.counters, self.seconds)

    @property
    def skipped(self) -> DataFrame:
        """Links, unreadable directories and special files."""
        return self.listing.where(F.col("kind").isin(LINK, UNREADABLE, OTHER)).select(VOLUME, PATH, "kind")

    @property
    def counters(self) -> DataFrame:
        """Per volume: files, directories, bytes in total, truly read and avoided."""
        read = self.files.where("error is null").select(
            VOLUME, F.lit(1).alias("files"), F.lit(0).alias("directories"), SIZE, "bytes_read"
        )
        entered = self.listing.where(F.col("kind") == DIRECTORY).select(
            VOLUME, F.lit(0).alias("files"), F.lit(1).alias("directories"), F.lit(0).alias(SIZE), F.lit(0).alias("bytes_read")
        )
        return (
            read.unionByName(entered)
            .groupBy(VOLUME)
            .agg(
                F.sum("files").alias("files"),
                F.sum("directories").alias("directories"),
                F.sum(SIZE).alias("bytes_total"),
                F.sum("bytes_read").alias("bytes_read"),
                (F.sum(SIZE) - F.sum("bytes_read")).alias("bytes_avoided"),
            )
        )


def scan_trees(
    spark: SparkSession,
    roots: Mapping[str, str],
    mode: str = FULL,
    prefix_bytes: int = PREFIX_BYTES,
    bases: Mapping[str, str] | None = None,
    exclude_suffixes: Iterable[str] | None = None,
    exclude_paths: Iterable[str] | None = None,
    boundary: bool = False,
    algo: str = SHA256,
) -> TreeScan:
    """List and fingerprint every file under every root, all volumes in the same jobs.

    ``roots`` names the root of each volume. Paths are relative to the root, or
    to what ``bases`` gives for the volume.
    """
    check_mode(mode)
    began = time.monotonic()
    listing = list_trees(spark, roots, bases, exclude_suffixes, exclude_paths, boundary)
    files = listing.where(F.col("kind") == FILE)
    hashed = stored(hash_files(files, mode, prefix_bytes, algo), "tree-files")
    return TreeScan(listing, hashed, mode, prefix_bytes, algo, time.monotonic() - began)


def scan_tree(spark: SparkSession, root: str, mode: str = FULL, base: str | None = None, **options) -> TreeScan:
    """The same for a single tree; its root is its volume name."""
    return scan_trees(spark, {root: root}, mode, bases={root: base} if base else None, **options)


# --- listing ---------------------------------------------------------------


def list_trees(
    spark: SparkSession,
    roots: Mapping[str, str],
    bases: Mapping[str, str] | None = None,
    exclude_suffixes: Iterable[str] | None = None,
    exclude_paths: Iterable[str] | None = None,
    boundary: bool = False,
) -> DataFrame:
    """Everything under the roots, as stored rows of files, directories and links.

    An excluded directory is not entered. One Spark job per level of depth; the
    driver learns only how many directories the next level has.
    """
    starts = {volume: _plain(root) for volume, root in roots.items()}
    relative_to = {volume: _plain((bases or {}).get(volume, root)) for volume, root in starts.items()}
    list_one = _lister(relative_to, suffix_rules(exclude_suffixes), path_rules(exclude_paths), boundary)
    folder = new_folder(spark, "tree-listing")
    frontier = spark.createDataFrame(
        [(volume, root, root) for volume, root in starts.items()], f"{VOLUME} string, root string, location string"
    )
    level, directories = 0, len(starts)
    spread = 4 * spark.sparkContext.defaultParallelism
    while directories > 0:
        # Few directories can hold very many files: none shares a task while there are cores.
        tasks = max(min(directories, spread), math.ceil(directories / DIRECTORIES_PER_TASK))
        dealt_out = frontier.repartition(tasks, VOLUME, "location") if tasks > spread else _one_each(frontier, tasks)
        entries = dealt_out.mapInArrow(_listing_task(list_one), LISTING)
        found = Observation()
        ahead = (F.col("kind") == DIRECTORY) & (F.col("location") != F.col("root"))
        entries.observe(found, F.count_if(ahead).alias("n")).write.parquet(f"{folder}/level={level}")
        directories = found.get["n"]
        frontier = spark.read.schema(LISTING).parquet(f"{folder}/level={level}").where(ahead)
        frontier = frontier.select(VOLUME, "root", "location")
        level += 1
    return spark.read.schema(LISTING).parquet(*(f"{folder}/level={n}" for n in range(level)))


def _one_each(frontier: DataFrame, tasks: int) -> DataFrame:
    """At most ``DIRECTORIES_PER_TASK`` directories a task, in turn: a level of few, so that one task can number it."""
    number = F.row_number().over(W.orderBy(VOLUME, "location")) - 1
    return frontier.withColumn("task", F.pmod(number, F.lit(tasks))).repartitionById(tasks, "task").drop("task")


def _plain(path: str) -> str:
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return path.rstrip("/") or "/"


def _is_remote(path: str) -> bool:
    return "://" in path


def _relative(location: str, base: str) -> str:
    if _is_remote(location):
        return unquote(location.removeprefix(base.rstrip("/") + "/")) if location != base else "."
    return posixpath.relpath(location, base)


def _lister(bases: dict[str, str], suffixes: list[str], prefixes: list[str], boundary: bool) -> Callable:
    def dropped_directory(path: str) -> bool:
        if boundary:
            return any(path == p or path.startswith(p + "/") for p in prefixes)
        return any(path.startswith(p) for p in prefixes)

    def list_one(volume: str, root: str, directory: str) -> Iterator[tuple]:
        here = _relative(directory, bases[volume])
        if directory == root:
            if dropped_directory(here):
                return
            yield volume, root, directory, here, DIRECTORY, None
        try:
            for name, kind, size in _entries(directory):
                path = name if here == "." else f"{here}/{name}"
                if not _is_text(name):
                    # Neither a column nor a URI can hold such a name: it is reported, escaped, and left out.
                    path, kind = path.encode("utf-8", "backslashreplace").decode(), UNREADABLE if kind == DIRECTORY else OTHER
                    yield volume, root, directory, path, kind, None
                    continue
                location = directory.rstrip("/") + "/" + (quote(name) if _is_remote(directory) else name)
                if kind == DIRECTORY:
                    if not dropped_directory(path):
                        yield volume, root, location, path, kind, None
                elif not any(name.endswith(s) for s in suffixes):
                    yield volume, root, location, path, kind, size
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            # Any other error leaves it open what the directory holds, and fails the task.
            if directory == root:
                raise
            yield volume, root, directory, here, UNREADABLE, None

    return list_one


def _is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _entries(directory: str) -> Iterator[tuple]:
    if _is_remote(directory):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(directory)
        for info in files.get_file_info(fs.FileSelector(path)):
            kind = {fs.FileType.Directory: DIRECTORY, fs.FileType.File: FILE}.get(info.type, OTHER)
            yield info.base_name, kind, info.size if kind == FILE else None
        return
    with os.scandir(directory) as entries:
        for entry in entries:
            if entry.is_symlink():
                # A link to a directory is not a file and is silently left alone. One that cannot be
                # followed, as it leads to itself or into a closed folder, is a link all the same.
                try:
                    to_directory = entry.is_dir()
                except OSError:
                    to_directory = False
                if not to_directory:
                    yield entry.name, LINK, None
            elif entry.is_dir(follow_symlinks=False):
                yield entry.name, DIRECTORY, None
            else:
                yield entry.name, *_stat(entry)


def _stat(entry: os.DirEntry) -> tuple:
    try:
        size = entry.stat(follow_symlinks=False).st_size
    except FileNotFoundError:
        return VANISHED, None
    except PermissionError:
        return OTHER, None
    return (FILE, size) if entry.is_file(follow_symlinks=False) else (OTHER, None)


def _listing_task(list_one: Callable) -> Callable:
    schema = _arrow({VOLUME: "s", "root": "s", "location": "s", PATH: "s", "kind": "s", SIZE: "l"})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (entry for batch in batches for directory in _rows_of(batch) for entry in list_one(*directory))
        yield from _batched(rows, schema)

    return task


def _arrow(columns: dict[str, str]) -> pa.Schema:
    types = {"s": pa.string(), "l": pa.int64(), "t": pa.timestamp("us", tz="UTC")}
    return pa.schema([(name, types[kind]) for name, kind in columns.items()])


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from a stream of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_PER_BATCH:
            yield _to_batch(held, schema)
            held = []
    if held:
        yield _to_batch(held, schema)


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


# --- hashing ---------------------------------------------------------------


def hash_files(files: DataFrame, mode: str = FULL, prefix_bytes: int = PREFIX_BYTES, algo: str = SHA256) -> DataFrame:
    """Fingerprint listed files. ``files`` must be a stored listing: it is read twice.

    A size-only snapshot opens no file. Otherwise files are dealt to tasks of equal bytes, see ``dealt``. Content is
    read in blocks of ``READ_BLOCK``, never whole. Size, time and digest belong together: a file that
    changes while it is read is read again, up to ``READS`` times, and then set aside with an error.
    """
    check_mode(mode)
    if mode == SIZE_ONLY:
        unread, no_error, no_time = F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("timestamp")
        return files.select(
            VOLUME, PATH, F.lit(NOT_COMPUTED).alias(HASH), SIZE, unread.alias("bytes_read"), no_error.alias("error"),
            no_time.alias(MTIME), no_time.alias(HASHED_AT),
        )
    hasher(algo)
    limit = prefix_bytes if mode == PARTIAL else None
    rows = files.select(VOLUME, "root", "location", PATH, SIZE)
    work = dealt(rows, bytes_to_read(SIZE, mode, prefix_bytes) + OPEN_COST)
    return work.mapInArrow(_hashing_task(limit, algo), HASHED)


def dealt(files: DataFrame, weight: Column, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """The files in tasks of equal weight: none has more than its share and one file.

    A running sum over all files is cut into equal parts. It is made of a running sum inside each of some buckets, by a hash of the
    location, and of the sums of the buckets before, a table of one row per bucket. One file is always one task's work, as its
    digest is sequential.
    """
    spark = files.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weighed = files.withColumns({"weight": weight, "bucket": F.pmod(F.xxhash64("location"), F.lit(buckets))})
    sums = weighed.groupBy("bucket").agg(F.sum("weight").alias("sum"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.coalesce(F.sum("sum"), F.lit(0)).alias("w"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    spread = 4 * spark.sparkContext.defaultParallelism
    tasks = max(1, min(total["n"], max(spread, math.ceil(total["w"] / bytes_per_task))))
    share = max(1, math.ceil(total["w"] / tasks))
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    before = W.partitionBy("bucket").orderBy("location", PATH).rowsBetween(W.unboundedPreceding, -1)
    placed = weighed.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0))).join(F.broadcast(starts), "bucket")
    task = F.floor((F.col("start") + F.col("before")) / share).cast("int")
    return placed.select(*files.columns, task.alias("task")).repartitionById(tasks, "task").drop("task")


def hasher(algo: str):
    """A fresh hash object. ``blake3`` needs the package of that name on the executors."""
    if algo == "blake3":
        try:
            from blake3 import blake3
        except ImportError as e:
            raise ValueError("hash algorithm 'blake3' needs the blake3 package") from e
        return blake3()
    if algo != SHA256:
        raise ValueError(f"unknown hash algorithm {algo!r}")
    return hashlib.sha256()


def digest(stream, limit: int | None, algo: str) -> tuple[str, int]:
    """Hex digest and byte count of a stream, or of its first ``limit`` bytes."""
    state, seen = hasher(algo), 0
    while limit is None or seen < limit:
        block = stream.read(READ_BLOCK if limit is None else min(READ_BLOCK, limit - seen))
        if not block:
            break
        state.update(block)
        seen += len(block)
    return state.hexdigest(), seen


def _open(location: str):
    if _is_remote(location):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(location)
        return files.open_input_stream(path)
    return open(location, "rb", buffering=0)


def _state(stream, location: str) -> tuple[int, int]:
    """Size and modification time, in nanoseconds, of a file as it is now."""
    if _is_remote(location):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(location)
        info = files.get_file_info(path)
        return info.size, info.mtime_ns or 0
    stat = os.fstat(stream.fileno())
    return stat.st_size, stat.st_mtime_ns


def read_settled(location: str, limit: int | None, algo: str) -> tuple[str | None, int, int, int]:
    """(digest, bytes read in all, size, modification time) of one state of a file; no digest if it changes each time."""
    seen = 0
    for _ in range(READS):
        with _open(location) as stream:
            before = _state(stream, location)
            value, n = digest(stream, limit, algo)
            seen += n
            if before == _state(stream, location) and n == (before[0] if limit is None else min(limit, before[0])):
                return value, seen, *before
    return None, seen, *before


def _hashing_task(limit: int | None, algo: str) -> Callable:
    schema = _arrow({VOLUME: "s", PATH: "s", HASH: "s", SIZE: "l", "bytes_read": "l", "error": "s", MTIME: "t", HASHED_AT: "t"})

    def one(volume: str, root: str, location: str, path: str, size: int) -> tuple:
        try:
            value, seen, size, changed = read_settled(location, limit, algo)
        except FileNotFoundError:
            # A file deleted since the listing is set aside. If the whole tree
            # is gone, its mount is missing here and the task must fail.
            if not _is_remote(root) and not os.path.isdir(root):
                raise OSError(errno.ENOTCONN, "the scanned tree is not visible on this executor", root) from None
            return volume, path, None, size, 0, NOT_FOUND, None, None
        error = CHANGED if value is None else None
        return volume, path, value, size, seen, error, changed // 1000, time.time_ns() // 1000

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((one(*row) for batch in batches for row in _rows_of(batch)), schema)

    return task
