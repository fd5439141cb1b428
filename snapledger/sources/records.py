"""Tab-separated snapshots as records that may hold line breaks, read in parallel from files of any size.

Dialect: header row, tab between fields, text in double quotes with a backslash before quotes and backslashes, numbers bare,
null empty; or numbers quoted too, and then null like empty text. Spark's text source splits plain files at line ends, and a line end may lie inside a quoted path. Each split finds out by itself
which it is: read on, the lines make a whole record, or the end of one, and only one of the two fits the dialect. Its first lines, up to
the first record's start, and its last ones, after the last record's end, are put together with those of the splits beside it.

What a split assumed is checked: the quotes of all splits before it say whether it begins inside a field. A file of which any
split was mistaken, which takes paths that look like records, is read by Spark's own reader instead, in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fingerprint import SIZE
from .ship import ship
from .store import stored

RECORD, FRAGMENT, SPLIT = 0, 1, 2
_TEXT = r'"([^"\\]*(?:\\.[^"\\]*)*)"|()'
_NUMBER = r'("?)(-?\d+)?"?'
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLAIN = {"sep": "\t", "header": True, "escape": "\\", "mode": "FAILFAST", "enforceSchema": False, "multiLine": True}


class Dialect:
    """Whole records of the given columns, and ends of records that begin inside a text field."""

    def __init__(self, names: list[str]):
        self.names = names
        fields = [f"(?:{_NUMBER if n == SIZE else _TEXT})" for n in names]
        self.whole = re.compile("\t".join(fields), re.S)
        # The rest of a text field, its quote, and the fields after it.
        self.ends = [re.compile("\t".join([r'[^"\\]*(?:\\.[^"\\]*)*"', *fields[i + 1 :]]), re.S) for i, n in enumerate(names) if n != SIZE]

    def parse(self, record: str) -> list:
        found = self.whole.fullmatch(record)
        if not found:
            raise ValueError(f"not a record of {self.names}: {record[:200]!r}")
        # Where numbers are quoted, nulls are too, and cannot be told from empty text.
        all_quoted = any(n == SIZE and found[2 * i + 1] for i, n in enumerate(self.names))
        out = []
        for i, n in enumerate(self.names):
            value = found[2 * i + 1]
            if n == SIZE:
                value = int(found[2 * i + 2]) if found[2 * i + 2] else None
            elif value == "" and all_quoted:
                value = None
            elif value is not None and "\\" in value:
                value = _ESCAPED.sub(r"\1", value)
            out.append(value)
        return out

    def is_end(self, text: str) -> bool:
        return any(end.fullmatch(text) for end in self.ends)


def odd_quotes(line: str) -> bool:
    """Whether a line leaves a field open that it found closed, or the other way round."""
    return bool((_ESCAPED.sub("", line) if "\\" in line else line).count('"') & 1)


def header_of(names: list[str]) -> str:
    return "\t".join(f'"{n}"' for n in names)


class _Split:
    """The lines of one split of a file, in order."""

    def __init__(self, dialect: Dialect, file: str, start: int):
        self.dialect, self.file, self.start = dialect, file, start
        self.inside: bool | None = False if start == 0 else None  # whether it begins inside a field, once known
        self.odd = False  # of all quotes so far
        self.open: list[str] = []  # lines of a record not ended yet, or the lines before the first record's start
        self.headless = start == 0
        self.head_done = False
        self.error: str | None = None

    def add(self, line: str) -> Iterator[tuple]:
        self.open.append(line)
        self.odd ^= odd_quotes(line)
        if self.inside is None:
            self._decide()
            if self.inside is None:
                return
        if self.odd != self.inside:
            return  # inside a field
        text, self.open = "\n".join(self.open), []
        if self.inside and not self.head_done:
            self.head_done = True
            yield self._row(FRAGMENT, text=text)
        elif self.headless:
            self.headless = False
            if text.removesuffix("\r") != header_of(self.dialect.names):
                self.error = self.error or f"the header does not conform to {self.dialect.names}: {text[:200]!r}"
        elif text.rstrip("\r"):
            try:
                yield self._row(RECORD, values=self.dialect.parse(text.removesuffix("\r")))
            except ValueError as e:
                # A bad file, or a mistake about the split: the quotes of the splits before it will tell.
                self.error = self.error or str(e)

    def _decide(self) -> None:
        # Quotes so far are even, and the lines may be a record, or odd, and they may be the end of one.
        text = "\n".join(self.open).removesuffix("\r")
        if self.odd:
            self.inside = self.dialect.is_end(text)
        else:
            self.inside = not self.dialect.whole.fullmatch(text)

    def end(self) -> Iterator[tuple]:
        if self.open:
            yield self._row(FRAGMENT, text="\n".join(self.open))
        yield self._row(SPLIT, text=self.error)

    def _row(self, kind: int, values: list | None = None, text: str | None = None) -> tuple:
        return (kind, self.file, self.start, text, bool(self.inside), self.odd, *(values or [None] * len(self.dialect.names)))


def _schema(names: list[str]) -> tuple[str, pa.Schema]:
    plain = {"kind": "int", "file": "string", "start": "bigint", "text": "string", "inside": "boolean", "odd": "boolean"}
    plain |= {f"f_{n}": "bigint" if n == SIZE else "string" for n in names}
    arrow = {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return ", ".join(f"`{k}` {t}" for k, t in plain.items()), pa.schema([(k, arrow[t]) for k, t in plain.items()])


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _splits(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Records, fragments and one row about each split, from lines in the order of their files."""
    schema, dialect, split, out = _schema(names)[1], Dialect(names), None, []
    for batch in batches:
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if split is None or (file, start) != (split.file, split.start):
                out += split.end() if split else ()
                split = _Split(dialect, file, start)
            out += split.add(line)
        yield _to_batch(out, schema)
        out = []
    yield _to_batch([*out, *(split.end() if split else ())], schema)


def _joined(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The records that fragments make, file by file in order."""
    schema, dialect, file, text, odd = _schema(names)[1], Dialect(names), None, None, False
    for batch in batches:
        out = []
        for own, start, more in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "text")), strict=True):
            if own != file:
                if odd:
                    raise ValueError(f"a field is not closed at the end of {file}")
                file, text, odd = own, None, False
            text, odd = more if text is None else f"{text}\n{more}", odd ^ odd_quotes(more)
            if not odd:
                if text.rstrip("\r"):
                    out.append((RECORD, own, start, None, False, False, *dialect.parse(text.removesuffix("\r"))))
                text = None
        yield _to_batch(out, schema)
    if odd:
        raise ValueError(f"a field is not closed at the end of {file}")


def read_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The records of all files under a path, whose header must be ``names``; any column but the size is text.

    Files are read once, in as many tasks as they have splits (a compressed file has one), and the records stored.
    A record or header that does not fit fails the query.
    """
    ship(spark)
    schema = _schema(names)[0]
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    parts = stored(lines.mapInArrow(partial(_splits, names=names), schema), "records")
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    splits = parts.where(F.col("kind") == SPLIT).select("file", "text", "inside", quotes.alias("truly"))
    checked = stored(splits.where("inside <> truly or text is not null"), "mistaken")
    bad = checked.where("inside = truly").first()
    if bad:
        raise ValueError(f"{bad['text']} in {bad['file']}")
    fragments = parts.where(F.col("kind") == FRAGMENT)
    whole = parts.where(F.col("kind") == RECORD)
    again = [r[0] for r in checked.select("file").distinct().collect()]
    if again:
        # Names of files with paths that look like records, which only contrived ones do.
        fragments, whole = (df.where(~F.col("file").isin(again)) for df in (fragments, whole))
    # A split has two fragments at most: the end of a record of the one before it, and the begin of its last.
    order = fragments.withColumn("nth", F.monotonically_increasing_id())
    ends = order.repartition("file").sortWithinPartitions("file", "start", "nth").drop("nth").mapInArrow(partial(_joined, names=names), schema)
    found = whole.unionByName(ends).select(*(F.col(f"f_{n}").alias(n) for n in names))
    if again:
        types = T.StructType([T.StructField(n, T.LongType() if n == SIZE else T.StringType()) for n in names])
        found = found.unionByName(spark.read.schema(types).options(**_PLAIN).csv(again))
    return found


def _line(df: DataFrame) -> Column:
    """A row as a record: text quoted, numbers bare, null empty."""

    def field(f: T.StructField) -> Column:
        column = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            return F.coalesce(column.cast("string"), F.lit(""))
        return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(column, r'(["\\])', r"\\$1"), F.lit('"')), F.lit(""))

    return F.concat_ws("\t", *(field(f) for f in df.schema.fields))


def _with_header(batches: Iterator[pa.RecordBatch], header: str) -> Iterator[pa.RecordBatch]:
    """The header before a task's rows; the first task has it also without rows, so there is one file at least."""
    first = pa.RecordBatch.from_pydict({"value": pa.array([header])})
    if TaskContext.get().partitionId() == 0:
        yield first
        first = None
    for batch in batches:
        if batch.num_rows and first is not None:
            yield first
            first = None
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])


def write_records(df: DataFrame, path: str, codec: str = "none") -> None:
    """A folder of part files, each with the header; there is one also without any row."""
    ship(df.sparkSession)
    rows = df.select(_line(df).alias("value")).mapInArrow(partial(_with_header, header=header_of(df.columns)), "value string")
    rows.write.option("lineSep", "\n").option("compression", codec).text(path)
