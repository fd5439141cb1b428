"""

Every query reads whole tables. Three corpora serve as snapshots:

* documents, as ``source/doc_id.lang`` with their text;
* an *old* state, documents plus conversations;
* a *new* state, where long documents have moved to ``archive/``, French ones
  have gained a line break, conversations are gone and pages have come.

Queries that read a snapshot more than once store it first, as a user would.
"""

from __future__ import annotations

import importlib.util
import os
import pathlib
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = pathlib.Path(__file__).resolve().parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

import snapledger as sl  # noqa: E402
from snapledger.functions.paths import basename, dirname  # noqa: E402
from snapledger.operators import diff  # noqa: E402
from snapledger.sources.ship import ship  # noqa: E402
from snapledger.sources.store import new_folder  # noqa: E402
from snapledger.sources.tree import hash_files, list_trees  # noqa: E402

# Prefix length of the partial mode here: shorter than most texts, so that the
# prefix matters. It is a parameter of the operator, not a cut of its input.
PREFIX = 256
LONG = 2000
SPLIT = 500
RUNS = ("2021-03-21PT2300", "2021-03-28PT2213", "2021-03-29PT2130")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


# --- corpora: (relative path, content) per record ------------------------------

def _doc_path() -> Column:
    return _path(F.col("source"), "/", _text("doc_id"), ".", F.col("lang"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(_doc_path().alias("path"), F.col("text").alias("content"))


def _edited() -> Column:
    return F.when(F.col("lang") == "fr", F.concat("text", F.lit("\n"))).otherwise(F.col("text"))


def _moved() -> Column:
    return _path(F.when(F.col("n_chars") >= LONG, "archive/").otherwise(""), _doc_path())


def _conversations(spark: SparkSession, sf_dir: str, content: Column | None = None) -> DataFrame:
    path = _path("conversations/", _text("conv_id"), "/", _text("turn"), ".txt")
    content = F.col("text") if content is None else content
    return _table(spark, sf_dir, "conversations").select(path.alias("path"), content.alias("content"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path("pages/", _text("page_id"), ".html")
    return _table(spark, sf_dir, "pages").select(path.alias("path"), F.col("html").alias("content"))


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).unionByName(_conversations(spark, sf_dir))


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select(_moved().alias("path"), _edited().alias("content"))
    return documents.unionByName(_pages(spark, sf_dir))


def _snap(rows: DataFrame, mode: str = sl.FULL, prefix_bytes: int = PREFIX) -> DataFrame:
    return sl.snapshot(rows, "path", "content", mode, prefix_bytes)


def _both(spark: SparkSession, sf_dir: str, mode: str = sl.FULL) -> tuple[DataFrame, DataFrame]:
    return _snap(_old(spark, sf_dir), mode), _snap(_new(spark, sf_dir), mode)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.concat(*_both(spark, sf_dir))


def _stored_documents(spark: SparkSession, sf_dir: str, mode: str = sl.FULL) -> DataFrame:
    return sl.stored(_snap(_documents(spark, sf_dir), mode), compact=True)


# --- snapshots and exclusion ----------------------------------------------------


def snapshot_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(_documents(spark, sf_dir))


def snapshot_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(_documents(spark, sf_dir), sl.PARTIAL)


def snapshot_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(_documents(spark, sf_dir), sl.SIZE_ONLY)


def snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.snapshot(_table(spark, sf_dir, "pages"), "url", "html")


def snapshot_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(_conversations(spark, sf_dir))


def fingerprint_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.fingerprint_levels(_documents(spark, sf_dir), "path", "content", prefix_bytes=PREFIX)


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _new(spark, sf_dir).select("path")
    return rows.select("path", dirname("path").alias("directory"), basename("path").alias("name"))


def exclude_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(sl.exclude(_documents(spark, sf_dir), paths=["./src1/"], key="path"))


def exclude_path_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(sl.exclude(_documents(spark, sf_dir), paths=["./src1/"], boundary=True, key="path"))


def exclude_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(sl.exclude(_new(spark, sf_dir), suffixes=["*.fr", ".html"], key="path"))


def exclude_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from tables: a folder per supplier, and a last letter per word of the parts' names."""
    folders = _table(spark, sf_dir, "supplier").select(F.lit("path").alias("kind"), _path("./src", _text("s_suppkey"), "/").alias("rule"))
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    suffixes = words.select(F.lit("suffix").alias("kind"), _path("*", F.substring("word", 1, 1)).alias("rule"))
    return _snap(sl.exclude_listed(_new(spark, sf_dir), folders.unionByName(suffixes), boundary=True, key="path"))


# --- duplicates and groups ------------------------------------------------------


def duplicates_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.duplicates(_stored_documents(spark, sf_dir))


def duplicates_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.duplicates(_stored_documents(spark, sf_dir, sl.PARTIAL))


def duplicates_partial_with_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.duplicates(_stored_documents(spark, sf_dir, sl.PARTIAL), with_size=True)


def duplicates_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.duplicates_by_mode(_stored_documents(spark, sf_dir, sl.SIZE_ONLY), sl.SIZE_ONLY)


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose content is their two flags: a handful of values hold all rows."""
    return _table(spark, sf_dir, "lineitem").select(
        _path(_text("l_orderkey"), "/", _text("l_linenumber")).alias("path"),
        _path(F.col("l_returnflag"), "|", F.col("l_linestatus")).alias("content"),
    )


def duplicates_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.duplicates(sl.stored(_snap(_order_lines(spark, sf_dir)), compact=True))


def _order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without their number: customer, status and priority."""
    return _table(spark, sf_dir, "orders").select(
        _path("orders/", _text("o_orderkey")).alias("path"),
        _path(_text("o_custkey"), "|", F.col("o_orderstatus"), "|", F.col("o_orderpriority")).alias("content"),
    )


def duplicates_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.duplicates(sl.stored(_snap(_order_records(spark, sf_dir)), compact=True))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.value_counts(_snap(_documents(spark, sf_dir)))


def duplicates_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.duplicate_summary(_snap(_documents(spark, sf_dir)))


def _listed(groups: DataFrame) -> DataFrame:
    return groups.withColumn("paths", F.array_join("paths", "\n"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sl.group_paths(_stored_documents(spark, sf_dir))
    return _listed(groups.where("n_rows > 1"))


def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups too large for one list: every part tells the group's size, and no path is lost."""
    key = F.concat_ws("/", "l_orderkey", "l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select(key.alias("path"), F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("content"))
    groups = sl.group_paths(sl.stored(_snap(rows), compact=True), list_rows=SPLIT)
    return groups.groupBy("hash").agg(
        F.max("n_rows").alias("n_rows"), F.sum(F.size("paths")).alias("listed"), (F.count(F.lit(1)) > 1).alias("split")
    )


def hierarchical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(sl.nested_groups(sl.stored(fingerprint_levels(spark, sf_dir), compact=True)))


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = sl.stored(fingerprint_levels(spark, sf_dir), compact=True)
    return levels.unionAll(levels)


def flatten_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.flatten_groups(sl.nested_groups(_twice(spark, sf_dir)))


# --- comparison -------------------------------------------------------------------


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.removed(*_both(spark, sf_dir))


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.added(*_both(spark, sf_dir))


def modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.modified(*_both(spark, sf_dir))


def modified_size_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.modified(*_both(spark, sf_dir, sl.SIZE_ONLY), value=sl.SIZE)


def diff_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.diff_flags(*_both(spark, sf_dir))


def diff_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flags from two tables bucketed by path, joined without a shuffle."""
    tables = []
    for side, rows in zip(("old", "new"), _both(spark, sf_dir)):
        folder = new_folder(spark, f"bucketed-{side}")
        tables.append(sl.write_bucketed(rows, folder.rsplit("/", 1)[1].replace("-", "_"), folder, 8))
    return sl.diff_flags(*tables, null_keys=False)


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comparison reports of one run, stacked."""
    old, new = (sl.stored(s, compact=True) for s in _both(spark, sf_dir))
    cut = sl.reports(new, old, wanted=("removed", "added", "modified"))
    stacked = [df.select(F.lit(name).alias("report"), sl.PATH) for name, df in cut.items()]
    return stacked[0].unionByName(stacked[1]).unionByName(stacked[2])


def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.path_collisions(sl.stored(_merged(spark, sf_dir), compact=True))


def repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.repeated_keys(_merged(spark, sf_dir))


# --- moves, shared content, space ------------------------------------------------------


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.moves(*(sl.stored(s, compact=True) for s in _both(spark, sf_dir)))


def _order_states(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders whose content is their status, so a handful of hashes hold all; then without the small ones, and the urgent moved."""
    orders, status = _table(spark, sf_dir, "orders"), F.col("o_orderstatus").alias("content")
    place = F.when(F.col("o_orderpriority").startswith("1"), "urgent/").otherwise("")
    states = [
        orders.select(_path("orders/", _text("o_orderkey")).alias("path"), status),
        orders.where("o_totalprice > 100000").select(_path("orders/", place, _text("o_orderkey")).alias("path"), status),
    ]
    return [sl.stored(_snap(rows), compact=True) for rows in states]


def moves_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves among rows of which a handful of hashes hold all."""
    return sl.moves(*_order_states(spark, sf_dir))


def moves_across_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents go from the first volume to the second, where pages are."""
    long, short = F.col("n_chars") >= LONG, F.col("n_chars") < LONG
    table = _table(spark, sf_dir, "documents")
    some = {k: table.where(c).select(_doc_path().alias("path"), F.col("text").alias("content")) for k, c in (("long", long), ("short", short))}
    pages = _pages(spark, sf_dir)
    runs = [
        ("disk1", RUNS[0], _documents(spark, sf_dir)),
        ("disk2", RUNS[0], pages),
        ("disk1", RUNS[1], some["short"]),
        ("disk2", RUNS[1], pages.unionByName(some["long"])),
    ]
    return sl.Volumes(_stored_runs(spark, [(v, r, _snap(rows)) for v, r, rows in runs])).moves()


def shared_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.shared_between(*_both(spark, sf_dir))


def shared_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between rows of which a handful of hashes hold all: a few rows per path, not one per pair."""
    return sl.shared_between(*_order_states(spark, sf_dir))


def shared_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.shared_classes(*_order_states(spark, sf_dir))


def space_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.space_lost(_snap(_documents(spark, sf_dir)))


def space_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.space_by_directory(_merged(spark, sf_dir))


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.growth(*_both(spark, sf_dir))


def growth_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.growth_by_directory(*_both(spark, sf_dir, sl.SIZE_ONLY))


def modified_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a history whose customers' first run was stored without times."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    folder, dated = new_folder(spark, "history"), F.col("o_orderdate").cast("timestamp")
    path = _path("orders/", _text("o_orderkey"))
    content = _path(F.col("o_orderstatus"), "|", F.col("o_orderpriority"))
    edited = F.when(F.col("o_orderpriority").startswith("1"), F.concat(content, F.lit("!"))).otherwise(content)
    touched = F.when(F.col("o_totalprice") > 100_000, dated + F.expr("interval 1 day")).otherwise(dated)
    named = customers.select(_path("customers/", _text("c_custkey")).alias("path"), F.col("c_name").alias("content"), F.col("c_mktsegment").alias("segment"))
    shouted = F.when(F.col("segment") == "BUILDING", F.upper("content")).otherwise(F.concat("content", F.lit("?")))
    noon = F.lit("2021-03-28 12:00:00").cast("timestamp")

    def add(volume: str, run: str, rows: DataFrame, mtime: Column | None) -> None:
        # A snapshot has three columns; times are joined on by whoever has them.
        kept = rows.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)).withColumn("file_size_bytes", F.octet_length("content").cast("long"))
        kept = kept.withColumnRenamed("path", sl.PATH)
        kept = kept if mtime is None else kept.withColumn(sl.MTIME, mtime)
        sl.add_run(kept, folder, volume, run)

    add("orders", RUNS[0], orders.select(path.alias("path"), content.alias("content"), dated.alias("at")), F.col("at"))
    add("orders", RUNS[1], orders.select(path.alias("path"), edited.alias("content"), touched.alias("at")), F.col("at"))
    add("customers", RUNS[0], named, None)
    add("customers", RUNS[1], named.withColumn("content", shouted), noon)
    return sl.Volumes(sl.read_history(spark, folder)).modified_by_time()


# --- text files, history, counters ---------------------------------------------------


def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = new_folder(spark, "tsv") + ".tsv.gz"
    sl.write_tsv(_snap(_documents(spark, sf_dir)), folder, sl.FULL)
    return sl.read_tsv(spark, folder, sl.FULL)


def tsv_bz2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through another codec, chosen by the suffix of the path."""
    ship(spark)
    folder = new_folder(spark, "tsv") + ".tsv.bz2"
    sl.write_tsv(_snap(_documents(spark, sf_dir)), folder, sl.FULL)
    return sl.read_tsv(spark, folder, sl.FULL)


def tsv_bare_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text quoted and numbers bare, in paths that hold a line break each."""
    ship(spark)
    folder = new_folder(spark, "tsv") + ".tsv"
    broken = _documents(spark, sf_dir).withColumn("path", F.replace("path", F.lit("/"), F.lit('/\n"')))
    sl.write_tsv(_snap(broken), folder, sl.FULL, quote_numbers=False)
    return sl.read_tsv(spark, folder, sl.FULL)


def tsv_empty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the file of a report without rows: its header."""
    documents = _stored_documents(spark, sf_dir)
    written = sl.run(documents, new_folder(spark, "run"), documents, wanted=["removed"], suffix=".tsv")
    return spark.read.text(written["removed"])


def run_single_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over one stored text snapshot: the duplicates, each with the names of all files written; the input is not written again."""
    ship(spark)
    stored = new_folder(spark, "tsv") + ".tsv"
    sl.write_tsv(_snap(_documents(spark, sf_dir)), stored, sl.FULL)
    written = sl.run_files(spark, [stored], new_folder(spark, "run"), wanted=["duplicates"])
    return sl.read_tsv(spark, written["duplicates"], sl.FULL).withColumn("written", F.lit(",".join(sorted(written))))


def tsv_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored inputs, of different column order, read and concatenated."""
    ship(spark)
    folders = [new_folder(spark, "tsv") + ".tsv" for _ in range(2)]
    old, new = _both(spark, sf_dir)
    sl.write_tsv(old, folders[0], sl.FULL)
    sl.write_tsv(new.select(sl.HASH, sl.PATH, sl.SIZE), folders[1], sl.FULL)
    return sl.read_tsv(spark, folders, sl.FULL)


def _runs(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame]]:
    """Documents over three runs, conversations over two, pages in one run only."""
    table = _table(spark, sf_dir, "documents")
    edited = table.select(_doc_path().alias("path"), _edited().alias("content"))
    moved = table.select(_moved().alias("path"), _edited().alias("content"))
    answered = F.when(F.col("role") == "assistant", F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    runs = [
        ("documents", RUNS[0], _documents(spark, sf_dir)),
        ("documents", RUNS[1], edited),
        ("documents", RUNS[2], moved),
        ("conversations", RUNS[0], _conversations(spark, sf_dir)),
        ("conversations", RUNS[2], _conversations(spark, sf_dir, answered)),
        ("pages", RUNS[2], _pages(spark, sf_dir)),
    ]
    return [(volume, run, _snap(rows)) for volume, run, rows in runs]


def _history(spark: SparkSession, sf_dir: str) -> sl.History:
    return _stored_runs(spark, _runs(spark, sf_dir))


def _stored_runs(spark: SparkSession, runs: list[tuple[str, str, DataFrame]]) -> sl.History:
    folder = new_folder(spark, "history")
    rows = [snap.withColumns({"volume": F.lit(v), "run_id": F.lit(r)}) for v, r, snap in runs]
    pairs = spark.createDataFrame([(v, r) for v, r, _ in runs], "volume string, run_id string")
    sl.add_runs(sl.concat(*rows), folder, pairs)
    return sl.read_history(spark, folder)


def history_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.latest_runs(sl.ranked_runs(_history(spark, sf_dir)))


def history_latest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.Volumes(_history(spark, sf_dir)).changes()


def history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes, of runs that were stored as dated text snapshots."""
    texts, folder = new_folder(spark, "dated"), new_folder(spark, "history")
    for volume, run, snap in _runs(spark, sf_dir):
        sl.write_tsv(snap, f"{texts}/{run}-{volume}-hashes.tsv.gz", sl.FULL)
    sl.import_series(spark, texts, folder, sl.FULL)
    return sl.Volumes(sl.read_history(spark, folder)).changes()


def history_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates inside the latest run of each volume."""
    return sl.Volumes(_history(spark, sf_dir)).duplicates()


def volume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.Volumes(_history(spark, sf_dir)).summary()


def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.scan_counters(_snap(_documents(spark, sf_dir), sl.PARTIAL), sl.PARTIAL, PREFIX)


def bytes_avoided(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        sl.bytes_avoided(_snap(_documents(spark, sf_dir), mode), mode, PREFIX)
        .select(F.lit(mode).alias("mode"), "bytes_total", "bytes_avoided")
        for mode in (sl.FULL, sl.PARTIAL, sl.SIZE_ONLY)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, had the scan taken ten minutes."""
    return sl.throughput(sl.scan_counters(_snap(_documents(spark, sf_dir))), 600)


# --- file trees -------------------------------------------------------------------------


def _as_tree(rows: DataFrame, label: str) -> str:
    """Write every record as a file of its own, from Spark tasks; returns the root."""
    root = new_folder(rows.sparkSession, label)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if (folder := f"{top}/{path}".rsplit("/", 1)[0]) not in made:
                    files.create_dir(folder, recursive=True)
                    if len(made) == 10_000:
                        made.clear()
                    made.add(folder)
                with files.open_output_stream(f"{top}/{path}") as out:
                    out.write(content)
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    files = rows.select("path", F.col("content").cast("binary")).repartition(tasks, "path")
    files.mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()
    return root


def tree_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sl.scan_tree(spark, _as_tree(_documents(spark, sf_dir), "tree")).snapshot


def tree_partial_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sl.scan_tree(
        spark,
        _as_tree(_new(spark, sf_dir), "tree"),
        mode=sl.PARTIAL,
        prefix_bytes=PREFIX,
        exclude_suffixes=["*.fr"],
        exclude_paths=["archive/src1"],
    ).snapshot


def tree_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scan = sl.scan_tree(spark, _as_tree(_documents(spark, sf_dir), "tree"), mode=sl.PARTIAL, prefix_bytes=PREFIX)
    return scan.counters.drop("volume")


def _change_tree(rows: DataFrame, root: str, change: Callable[[str], None]) -> None:
    """Do something to the file of every row, from Spark tasks. The tree is on a mount that all executors see."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                change(f"{root}/{path}")
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    rows.select("path").mapInArrow(task, "done boolean").write.format("noop").mode("overwrite").save()


def _mounted(root: str) -> str:
    """A tree's root as a plain path, for what only a file system does."""
    return root.removeprefix("file://").removeprefix("file:")


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a link beside every French document: what the scan leaves out, and why."""
    ship(spark)
    rows = _documents(spark, sf_dir)
    root = _mounted(_as_tree(rows, "tree"))
    _change_tree(rows.where(F.col("path").endswith(".fr")), root, lambda path: os.symlink(path, path + ".link"))
    return sl.scan_tree(spark, root).skipped.drop("volume")


def tree_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French documents are deleted between the listing and the hashing: the others' hashes, and the name of every file that is gone."""
    ship(spark)
    rows = _documents(spark, sf_dir)
    root = _mounted(_as_tree(rows, "tree"))
    files = list_trees(spark, {root: root}).where("kind = 'file'")
    _change_tree(rows.where(F.col("path").endswith(".fr")), root, os.remove)
    return sl.stored(hash_files(files)).select(sl.PATH, sl.HASH, "error")


def tree_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured rates of a scan. They differ from run to run, so the query tells what has to hold between them."""
    ship(spark)
    scan = sl.scan_tree(spark, _as_tree(_documents(spark, sf_dir), "tree"))
    rate = scan.throughput
    seconds = F.when(F.col("elapsed_unit") == "minutes", F.col("elapsed") * 60).otherwise(F.col("elapsed"))
    per_second = F.when(F.col("file_rate_unit") == "minute", F.col("file_rate") / 60).otherwise(F.col("file_rate"))
    return rate.select(
        "files",
        "bytes_read",
        (seconds > 0).alias("took_time"),
        (F.abs(F.col("mb_per_second") * seconds * 1_000_000 / F.col("bytes_read") - 1) < 1e-6).alias("bytes_agree"),
        (F.abs(per_second * seconds / F.col("files") - 1) < 1e-6).alias("files_agree"),
    )


def tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sl.duplicate_files(spark, _as_tree(_documents(spark, sf_dir), "tree"), prefix_bytes=PREFIX)


# --- contract ------------------------------------------------------------------------------

QUERIES = (
    snapshot_full,
    snapshot_partial,
    snapshot_size,
    snapshot_pages,
    snapshot_conversations,
    fingerprint_levels,
    path_parts,
    exclude_path,
    exclude_path_boundary,
    exclude_ext,
    exclude_listed,
    duplicates_full,
    duplicates_partial,
    duplicates_partial_with_size,
    duplicates_size,
    duplicates_hot,
    duplicates_orders,
    value_counts,
    duplicates_summary,
    duplicate_groups,
    split_groups,
    hierarchical_groups,
    flatten_groups,
    removed,
    added,
    modified,
    modified_size_mode,
    diff_flags,
    diff_bucketed,
    run_reports,
    concat,
    path_collisions,
    repeated_paths,
    moves,
    moves_hot,
    moves_across_volumes,
    shared_between,
    shared_hot,
    shared_classes,
    space_lost,
    space_by_directory,
    growth,
    growth_by_directory,
    modified_by_time,
    tsv_roundtrip,
    tsv_bz2,
    tsv_bare_numbers,
    tsv_empty_report,
    run_single_input,
    tsv_concat,
    history_latest_runs,
    history_latest_diff,
    history_import,
    history_duplicates,
    volume_summary,
    scan_counters,
    bytes_avoided,
    throughput,
    tree_snapshot,
    tree_partial_excluded,
    tree_counters,
    tree_links,
    tree_vanished,
    tree_throughput,
    tree_duplicates,
)


def entry(spark: SparkSession) -> DataFrame:
    """Duplicates by content among the documents of the smallest scale factor."""
    return duplicates_full(spark, "/root/testdata/sf0.001")


def _corpus_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators; empty where that subpackage is absent."""
    specs = [importlib.util.find_spec(m) for m in ("snapledger.llm", "corpus_pipeline")]
    if not all(spec and spec.origin for spec in specs):
        return {}, {}
    import corpus_pipeline
    from snapledger.llm import queries as corpus

    found, sql = dict(corpus.QUERIES), dict(corpus.ORACLE_SQL)
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES} | _corpus_queries()[0]


def oracle_sql() -> dict[str, str]:
    return _own_sql() | _corpus_queries()[1]


def _own_sql() -> dict[str, str]:
    doc_path = "concat(source, '/', cast(doc_id as varchar), '.', lang)"
    moved = f"concat(case when n_chars >= {LONG} then 'archive/' else '' end, {doc_path})"
    edited = "case when lang = 'fr' then concat(text, chr(10)) else text end"
    answered = "case when role = 'assistant' then concat(text, chr(10)) else text end"
    conv_path = "concat('conversations/', cast(conv_id as varchar), '/', cast(turn as varchar), '.txt')"
    page_path = "concat('pages/', cast(page_id as varchar), '.html')"

    documents = f"select {doc_path} as path, text as content from documents"
    conversations = f"select {conv_path} as path, text as content from conversations"
    pages = f"select {page_path} as path, html as content from pages"
    old = f"{documents} union all {conversations}"
    new = f"select {moved} as path, {edited} as content from documents union all {pages}"

    full = "sha256(content)"
    partial = f"sha256(array_slice(encode(content), 1, {PREFIX}))"
    unhashed = "'not_computed'"

    def snap(rows: str, value: str = full) -> str:
        return (
            f"select path as relative_path, {value} as hash, "
            f"cast(strlen(content) as bigint) as file_size_bytes from ({rows})"
        )

    def sharing(rows: str, keys: str, columns: str) -> str:
        return (
            f"with s as ({rows}), k as (select {keys} from s group by {keys} having count(*) > 1) "
            f"select {columns} from s where ({keys}) in (select ({keys}) from k)"
        )

    report = "hash, relative_path, file_size_bytes"
    levels = (
        "select path as relative_path, cast(strlen(content) as bigint) as file_size_bytes, "
        f"{partial} as partial_hash, strlen(content) <= {PREFIX} as fully_hashed, {full} as full_hash "
        f"from ({documents})"
    )
    sides = f"with o as ({snap(old)}), n as ({snap(new)})"
    sized = f"with o as ({snap(old, unhashed)}), n as ({snap(new, unhashed)})"
    same = "o.relative_path is not distinct from n.relative_path"
    gone = (
        f"select o.relative_path, o.hash, o.file_size_bytes from o left join n on {same} where n.hash is null"
    )
    come = (
        f"select n.relative_path, n.hash, n.file_size_bytes from n left join o on {same} where o.hash is null"
    )
    changed = f"select o.relative_path from o join n on {same} where o.hash is distinct from n.hash"

    def flags(o: str, n: str, on: str, keys: str) -> str:
        return (
            f"select {keys}, o.here is not null and n.hash is null as removed, "
            "n.here is not null and o.hash is null as added, "
            "o.here is not null and n.here is not null and o.hash is distinct from n.hash as modified "
            f"from (select *, true as here from ({o})) o full join (select *, true as here from ({n})) n on {on}"
        )

    all_flags = f"{sides} " + flags(
        "select * from o", "select * from n", same, "coalesce(o.relative_path, n.relative_path) as relative_path"
    )

    def moved_sql(o: str, n: str, more: str = "") -> str:
        """Rows gone and come, numbered within their hash; ``more`` is the volume, with a comma."""
        nth = f"row_number() over (partition by hash order by {more}relative_path) as nth"
        where = [c for c in (more.strip(", "), "relative_path") if c]
        columns = "".join(f", g.{c} as from_{c}" for c in where) + "".join(f", c.{c} as to_{c}" for c in where)
        on = "o.volume = n.volume and o.relative_path = n.relative_path" if more else "o.relative_path = n.relative_path"
        return (
            f"with o as ({o}), n as ({n}), g as (select o.*, {nth} from o anti join n on {on}), "
            f"c as (select n.*, {nth} from n anti join o on {on}) "
            "select case when c.nth is null then 'removed' when g.nth is null then 'added' else 'moved' end as change, "
            f"coalesce(c.hash, g.hash) as hash, coalesce(c.file_size_bytes, g.file_size_bytes) as file_size_bytes{columns} "
            "from g full join c on g.hash = c.hash and g.nth = c.nth"
        )

    orders = "select concat('orders/', cast(o_orderkey as varchar)) as path, o_orderstatus as content from orders"
    sorted_orders = (
        "select concat('orders/', case when starts_with(o_orderpriority, '1') then 'urgent/' else '' end, "
        "cast(o_orderkey as varchar)) as path, o_orderstatus as content from orders where o_totalprice > 100000"
    )
    disks = [
        f"select *, 'disk1' as volume from ({snap(rows)}) union all select *, 'disk2' as volume from ({snap(more)})"
        for rows, more in (
            (documents, pages),
            (
                f"select {doc_path} as path, text as content from documents where n_chars < {LONG}",
                f"{pages} union all select {doc_path} as path, text as content from documents where n_chars >= {LONG}",
            ),
        )
    ]

    def classes(o: str, n: str) -> str:
        return (
            f"with b as (select *, 1 as o, 0 as n from ({o}) union all select *, 0, 1 from ({n})), "
            "p as (select hash, relative_path, sum(o) as n_old, sum(n) as n_new, max(file_size_bytes) filter (o = 1) as size_old, "
            "max(file_size_bytes) filter (n = 1) as size_new from b group by hash, relative_path), "
            "t as (select hash, min(relative_path) as class_path, cast(sum(n_old) as bigint) as rows_old, "
            "cast(sum(n_new) as bigint) as rows_new, cast(sum(n_old) * sum(n_new) - sum(n_old * n_new) as bigint) as n_links "
            "from p group by hash)"
        )

    def shared_sql(o: str, n: str) -> str:
        parts = (
            f"select '{a}' as side, relative_path, hash, size_{a} as file_size_bytes, class_path, cast(n_{a} as bigint) as copies, "
            f"cast(rows_{b} - n_{b} as bigint) as n_links from p join t using (hash) where n_{a} > 0 and rows_{b} > n_{b}"
            for a, b in (("old", "new"), ("new", "old"))
        )
        return f"{classes(o, n)} {' union all '.join(parts)}"

    def summed(rows: str, sums: str) -> str:
        """Sums over a directory and all above it."""
        return (
            f"with a as (select *, string_split(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), '/') as parts from ({rows})), "
            "e as (select * exclude (parts), unnest(list_concat(['.'], list_transform(range(1, len(parts) + 1), "
            f"lambda i: array_to_string(parts[1:i], '/')))) as directory from a) select directory, {sums} from e group by directory"
        )

    merged = f"select *, min(relative_path) over (partition by hash) as original from ({snap(old)} union all {snap(new)})"
    sizes = (
        "select relative_path, 1 as files_before, 0 as files_after, file_size_bytes as bytes_before, 0 as bytes_after "
        f"from ({snap(old, unhashed)}) union all select relative_path, 0, 1, 0, file_size_bytes from ({snap(new, unhashed)})"
    )

    runs = [
        ("documents", RUNS[0], documents),
        ("documents", RUNS[1], f"select {doc_path} as path, {edited} as content from documents"),
        ("documents", RUNS[2], f"select {moved} as path, {edited} as content from documents"),
        ("conversations", RUNS[0], conversations),
        ("conversations", RUNS[2], f"select {conv_path} as path, {answered} as content from conversations"),
        ("pages", RUNS[2], pages),
    ]
    stored = " union all ".join(
        f"select *, '{volume}' as volume, '{run}' as run_id from ({snap(rows)})" for volume, run, rows in runs
    )
    history = (
        f"with h as ({stored}), latest as (select volume, run_id, baseline_run_id from ("
        "select volume, run_id, lag(run_id) over (partition by volume order by run_id) as baseline_run_id, "
        "row_number() over (partition by volume order by run_id desc) as nth "
        "from (select distinct volume, run_id from h)) where nth = 1), "
        "n as (select h.* from h join latest l on h.volume = l.volume and h.run_id = l.run_id), "
        "o as (select h.* from h join latest l on h.volume = l.volume and h.run_id = l.baseline_run_id)"
    )
    compared = "select * from n where volume in (select volume from o)"
    changes = (
        "select * from ("
        + flags(
            "select * from o",
            compared,
            f"o.volume = n.volume and {same}",
            "coalesce(o.volume, n.volume) as volume, coalesce(o.relative_path, n.relative_path) as relative_path",
        )
        + ") where removed or added or modified"
    )
    repeated = "select volume, count(*) as c from n group by volume, hash having count(*) > 1"
    summary = (
        f"{history}, f as (select volume, count(*) as files from n group by volume), "
        f"d as (select volume, sum(c) as duplicate_rows, count(*) as duplicate_groups from ({repeated}) group by volume), "
        "c as (select volume, count(*) filter (removed) as removed, count(*) filter (added) as added, "
        f"count(*) filter (modified) as modified from ({changes}) group by volume) "
        "select l.volume, l.run_id, l.baseline_run_id, f.files, "
        "cast(coalesce(d.duplicate_rows, 0) as bigint) as duplicate_rows, "
        "cast(coalesce(d.duplicate_groups, 0) as bigint) as duplicate_groups, "
        + ", ".join(
            f"case when l.baseline_run_id is not null then coalesce(c.{x}, 0) end as {x}"
            for x in ("removed", "added", "modified")
        )
        + " from latest l left join f on f.volume = l.volume left join d on d.volume = l.volume "
        "left join c on c.volume = l.volume"
    )

    total, read = "sum(strlen(content))", f"sum(least(strlen(content), {PREFIX}))"
    counters = (
        f"cast({total} as bigint) as bytes_total, cast({read} as bigint) as bytes_read, "
        f"cast({total} - {read} as bigint) as bytes_avoided"
    )
    directory = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
    name = "regexp_extract(path, '[^/]*$')"

    return {
        "snapshot_full": snap(documents),
        "snapshot_partial": snap(documents, partial),
        "snapshot_size": snap(documents, unhashed),
        "snapshot_pages": snap("select url as path, html as content from pages"),
        "snapshot_conversations": snap(conversations),
        "fingerprint_levels": levels,
        "path_parts": f"select path, {directory} as directory, {name} as name from ({new})",
        "exclude_path": snap(f"select * from ({documents}) where not starts_with({directory}, 'src1')"),
        "exclude_path_boundary": snap(
            f"select * from ({documents}) where {directory} <> 'src1' and not starts_with({directory}, 'src1/')"
        ),
        "exclude_ext": snap(
            f"select * from ({new}) where not ends_with({name}, '.fr') and not ends_with({name}, '.html')"
        ),
        "exclude_listed": snap(
            f"select * from ({new}) p where not exists (select 1 from supplier where {directory} = concat('src', cast(s_suppkey as varchar)) "
            f"or starts_with({directory}, concat('src', cast(s_suppkey as varchar), '/'))) and not exists (select 1 from "
            "(select unnest(string_split(p_name, ' ')) as word from part) where ends_with(p.path, substr(word, 1, 1)))"
        ),
        "duplicates_full": sharing(snap(documents), "hash", report),
        "duplicates_partial": sharing(snap(documents, partial), "hash", report),
        "duplicates_partial_with_size": sharing(snap(documents, partial), "hash, file_size_bytes", report),
        "duplicates_size": sharing(snap(documents, unhashed), "file_size_bytes", "file_size_bytes, relative_path"),
        "duplicates_hot": sharing(
            snap(
                "select concat(cast(l_orderkey as varchar), '/', cast(l_linenumber as varchar)) as path, "
                "concat(l_returnflag, '|', l_linestatus) as content from lineitem"
            ),
            "hash",
            report,
        ),
        "duplicates_orders": sharing(
            snap(
                "select concat('orders/', cast(o_orderkey as varchar)) as path, "
                "concat(cast(o_custkey as varchar), '|', o_orderstatus, '|', o_orderpriority) as content from orders"
            ),
            "hash",
            report,
        ),
        "value_counts": f"select hash, count(*) as n_rows from ({snap(documents)}) group by hash",
        "duplicates_summary": (
            "select cast(coalesce(sum(c), 0) as bigint) as duplicate_rows, count(*) as duplicate_groups from "
            f"(select count(*) as c from ({snap(documents)}) group by hash having count(*) > 1)"
        ),
        "duplicate_groups": (
            "select hash, cast(0 as bigint) as part, count(*) as n_rows, "
            "string_agg(relative_path, chr(10) order by relative_path) as paths "
            f"from ({snap(documents)}) group by hash having count(*) > 1"
        ),
        "split_groups": (
            f"select hash, count(*) as n_rows, count(*) as listed, count(*) > {SPLIT} as split from ("
            + snap(
                "select concat(cast(l_orderkey as varchar), '/', cast(l_linenumber as varchar)) as path, "
                "concat(l_returnflag, '|', l_linestatus) as content from lineitem"
            )
            + ") group by hash"
        ),
        "hierarchical_groups": (
            "select file_size_bytes, partial_hash, fully_hashed, full_hash, cast(0 as bigint) as part, "
            "count(*) as n_rows, string_agg(relative_path, chr(10) order by relative_path) as paths "
            f"from ({levels}) group by file_size_bytes, partial_hash, fully_hashed, full_hash"
        ),
        "flatten_groups": f"select * from ({snap(documents)}) union all select * from ({snap(documents)})",
        "removed": f"{sides} {gone}",
        "added": f"{sides} {come}",
        "modified": f"{sides} {changed}",
        "modified_size_mode": (
            f"{sized} select o.relative_path from o join n on {same} "
            "where o.file_size_bytes is distinct from n.file_size_bytes"
        ),
        "diff_flags": all_flags,
        "diff_bucketed": all_flags,
        "run_reports": (
            f"{sides} select 'removed' as report, relative_path from ({gone}) "
            f"union all select 'added' as report, relative_path from ({come}) "
            f"union all select 'modified' as report, relative_path from ({changed})"
        ),
        "concat": f"{snap(old)} union all {snap(new)}",
        "path_collisions": sharing(f"{snap(old)} union all {snap(new)}", "relative_path", "relative_path"),
        "repeated_paths": (
            f"select relative_path, count(*) as n_rows from ({snap(old)} union all {snap(new)}) "
            "group by relative_path having count(*) > 1"
        ),
        "moves": moved_sql(snap(old), snap(new)),
        "moves_hot": moved_sql(snap(orders), snap(sorted_orders)),
        "moves_across_volumes": moved_sql(*disks, "volume, "),
        "shared_between": shared_sql(snap(old), snap(new)),
        "shared_hot": shared_sql(snap(orders), snap(sorted_orders)),
        "shared_classes": (
            f"{classes(snap(orders), snap(sorted_orders))} "
            "select * from t where rows_old > 0 and rows_new > 0 and n_links > 0"
        ),
        "space_lost": (
            "select hash, count(*) as copies, min(file_size_bytes) as file_size_bytes, "
            "cast(sum(file_size_bytes) - min(file_size_bytes) as bigint) as bytes_lost "
            f"from ({snap(documents)}) group by hash having count(*) > 1"
        ),
        "space_by_directory": summed(
            merged,
            "count(*) as files, cast(sum(file_size_bytes) as bigint) as bytes, count(*) filter (relative_path <> original) as copies, "
            "cast(coalesce(sum(file_size_bytes) filter (relative_path <> original), 0) as bigint) as bytes_lost",
        ),
        "growth": (
            f"{sides} select coalesce(o.relative_path, n.relative_path) as relative_path, o.file_size_bytes as bytes_before, "
            "n.file_size_bytes as bytes_after, coalesce(n.file_size_bytes, 0) - coalesce(o.file_size_bytes, 0) as bytes_grown "
            "from o full join n on o.relative_path = n.relative_path where o.hash is distinct from n.hash"
        ),
        "growth_by_directory": summed(
            sizes,
            ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("files_before", "files_after", "bytes_before", "bytes_after"))
            + ", cast(sum(bytes_after) - sum(bytes_before) as bigint) as bytes_grown",
        ),
        "modified_by_time": (
            "select 'orders' as volume, concat('orders/', cast(o_orderkey as varchar)) as relative_path, o_totalprice > 100000 as time_changed "
            "from orders where starts_with(o_orderpriority, '1') union all "
            "select 'customers', concat('customers/', cast(c_custkey as varchar)), cast(null as boolean) from customer "
            "where case when c_mktsegment = 'BUILDING' then upper(c_name) else concat(c_name, '?') end <> c_name"
        ),
        "tsv_roundtrip": snap(documents),
        "tsv_bz2": snap(documents),
        "tsv_bare_numbers": snap(f"select replace(path, '/', concat('/', chr(10), '\"')) as path, content from ({documents})"),
        "tsv_empty_report": (
            "select concat('\"relative_path\"', chr(9), '\"full_hash\"', chr(9), '\"file_size_bytes\"') as value "
            f"from ({snap(documents)} where false union all select '', '', 0)"
        ),
        "run_single_input": "select *, 'duplicates' as written from (" + sharing(snap(documents), "hash", report) + ")",
        "tsv_concat": f"{snap(old)} union all {snap(new)}",
        "history_latest_runs": f"{history} select volume, run_id, baseline_run_id from latest",
        "history_latest_diff": f"{history} {changes}",
        "history_import": f"{history} {changes}",
        "history_duplicates": (
            f"{history}, k as (select volume, hash from n group by volume, hash having count(*) > 1) "
            "select volume, hash, relative_path, file_size_bytes from n "
            "where (volume, hash) in (select (volume, hash) from k)"
        ),
        "volume_summary": summary,
        "scan_counters": (
            f"select count(distinct {directory}) as directories, count(*) as files, {counters} from ({documents})"
        ),
        "bytes_avoided": (
            f"select 'full-hash' as mode, cast({total} as bigint) as bytes_total, cast(0 as bigint) as bytes_avoided "
            f"from ({documents}) union all select 'partial-hash', cast({total} as bigint), "
            f"cast({total} - {read} as bigint) from ({documents}) "
            f"union all select 'file-size', cast({total} as bigint), cast({total} as bigint) from ({documents})"
        ),
        "throughput": (
            "select *, bytes_read / 1000000.0::double as mb_read, bytes_read / 1000000.0::double / 600.0::double as mb_per_second, "
            "600.0::double / 60 as elapsed, 'minutes' as elapsed_unit, "
            "case when files / 600.0::double < 5 then files / 600.0::double * 60 else files / 600.0::double end as file_rate, "
            "case when files / 600.0::double < 5 then 'minute' else 'second' end as file_rate_unit from "
            f"(select count(distinct {directory}) as directories, count(*) as files, cast({total} as bigint) as bytes_total, "
            f"cast({total} as bigint) as bytes_read, cast(0 as bigint) as bytes_avoided from ({documents}))"
        ),
        "tree_snapshot": snap(documents),
        "tree_partial_excluded": snap(
            f"select * from ({new}) where not ends_with({name}, '.fr') and not starts_with({directory}, 'archive/src1')",
            partial,
        ),
        "tree_counters": (
            f"select count(*) as files, {counters}, count(distinct {directory}) + 1 as directories from ({documents})"
        ),
        "tree_links": f"select concat(path, '.link') as relative_path, 'link' as kind from ({documents}) where ends_with(path, '.fr')",
        "tree_vanished": (
            "select relative_path, case when not gone then hash end as hash, case when gone then 'not found' end as error "
            f"from (select *, ends_with(relative_path, '.fr') as gone from ({snap(documents)}))"
        ),
        "tree_throughput": (
            f"select count(*) as files, cast({total} as bigint) as bytes_read, true as took_time, true as bytes_agree, "
            f"true as files_agree from ({documents})"
        ),
        "tree_duplicates": sharing(snap(documents), "hash", report),
    }
