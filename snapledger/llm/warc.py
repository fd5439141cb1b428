"""WARC archives as a Spark data source.

Every record is a gzip member of its own whose header names the member's length, so that a
reader inflates the record's headers, decides on type and header predicates, and goes on
to the next member without inflating an unwanted payload. Members without the length are read too.
A file is a partition, and writers begin a new one after ``FILE_BYTES``; the files of an archive are those that a finished write
has listed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from ..sources.store import new_folder, stored
from .tokens import _filesystem

NAME = "snapledger_warc"
FILE_BYTES = 64 << 20  # compressed bytes after which a file ends; a larger record is a file of its own
LISTING = "_files"
# Fixed values of the format.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length in an extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 8 + len(body) + 8
    extra = b"LX" + struct.pack("<HI", 4, size)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row) -> bytes:
    """One record. A revisit has no block; its payload's length and digest stay in the headers."""
    payload = bytes(row["payload"] or b"") if row["record_type"] != "revisit" else b""
    lines = ["WARC/1.1"]
    lines += [f"{name}: {row[column]}" for column, name in HEADERS.items() if row[column] is not None]
    lines += [f"WARC-Profile: {PROFILE}"] * (row["record_type"] == "revisit")
    lines += [f"WARC-Date: {DATE}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def members(data: memoryview) -> Iterator[tuple[dict, callable]]:
    """(headers, payload function) of every record. Only headers are inflated until the payload is asked for."""
    at = 0
    while at < len(data):
        sized = data[at + 3] & 4 and bytes(data[at + 12 : at + 14]) == b"LX"
        stop = at + struct.unpack_from("<I", data, at + 16)[0] if sized else len(data)
        inflate = zlib.decompressobj(31)
        head = inflate.decompress(data[at:stop], 1024)
        while b"\r\n\r\n" not in head:
            more = inflate.decompress(inflate.unconsumed_tail, 1024)
            if not more:
                raise ValueError(f"no end of headers in the record at {at}")
            head += more
        text, _, begun = head.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])

        def payload(inflate=inflate, begun=begun, n=n) -> bytes:
            return (begun + inflate.decompress(inflate.unconsumed_tail))[:n]

        yield headers, payload
        if not sized:
            payload()
            stop = len(data) - len(inflate.unused_data)
        at = stop


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    names: list


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` = false leaves payloads null and never inflates them."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self._path, self._wants = options["path"], str(options.get("payload", "true")).lower() != "false"
        self._tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                values = f.value if isinstance(f, In) else [f.value]
                self._tests.append((HEADERS[column], frozenset(str(v) for v in values)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, top = _filesystem(self._path)
        with files.open_input_stream(f"{top}/{LISTING}") as f:
            return [_File(f"{self._path}/{name}") for name in f.read().decode().split()]

    def read(self, partition: _File | None):
        if partition is None:  # an archive without files
            return
        files, path = _filesystem(partition.path)
        with files.open_input_stream(path, compression=None) as f:
            data = memoryview(f.read())
        for headers, payload in members(data):
            if all(headers.get(name) in values for name, values in self._tests):
                values = [headers.get(name) for name in HEADERS.values()]
                values[-1] = None if values[-1] is None else int(values[-1])
                yield (*values, payload() if self._wants else None)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self._path = path

    def write(self, rows):
        files, top = _filesystem(self._path)
        files.create_dir(top, recursive=True)
        names, out, size = [], None, 0
        for row in rows:
            if out is None:
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = files.open_output_stream(f"{top}/{names[-1]}", compression=None), 0
            data = member(record(row))
            out.write(data)
            size += len(data)
            if size >= FILE_BYTES:
                out.close()
                out = None
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages):
        """List the files of the tasks that succeeded; what lost attempts left behind is in no list."""
        files, top = _filesystem(self._path)
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/{LISTING}", compression=None) as out:
            out.write("\n".join(n for m in messages if m for n in m.names).encode())


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let Spark hand it predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


_FIVE_BITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest):
    """Base32 of a 40-digit hex string: eight groups of 20 bits, four symbols each."""
    group = lambda i: F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
    symbols = [
        F.substring(F.lit(_FIVE_BITS), F.shiftright(group(i), shift).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for shift in (15, 10, 5, 0)
    ]
    return F.concat(*symbols)


def write_pages(
    pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0
) -> None:
    """Write a record per row to ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is a response and the others
    revisit it; smaller ones are all responses, and so are rows of a null id. A null payload is empty. Equal ids with equal
    payloads are all responses if theirs is the largest id. Only ids and digests are shuffled to find equal payloads, and the revisits
    are stored: if they are few, Spark broadcasts them, and no payload is shuffled to be told from them.
    """
    register(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    ids = pages.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("_id"), F.sha1(body).alias("_sha"), F.octet_length(body).alias("_n"))
    ids = stored(ids.where(F.col("_n") >= min_bytes).select("_id", "_sha"), "digests")
    first = ids.groupBy("_sha").agg(F.max("_id").alias("_first"), F.min("_id").alias("_least")).where("_least < _first")
    revisits = ids.join(first, "_sha").where("_id < _first").select("_id", F.col("_sha").alias("_same"), "_first").distinct()
    revisits = stored(revisits, "revisits")
    rows = pages.select(F.col(id).cast("bigint").alias("_id"), F.col(url).alias("_url"), body.alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    joined = rows.join(revisits, (rows["_id"] == revisits["_id"]) & (rows["_sha"] == revisits["_same"]), "left").select(
        F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.concat(F.lit("<urn:page:"), rows["_id"].cast("string"), F.lit(">")).alias("record_id"),
        F.regexp_replace("_url", r"[\r\n]", "").alias("target_uri"),
        F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">")).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("_sha"))).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("_first").isNull(), F.col("payload")).alias("payload"),
    )
    joined.write.format(NAME).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive; filters on header columns are applied before payloads are inflated."""
    register(spark)
    return spark.read.format(NAME).option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Written and read back. A response's length and digest are those of the payload that was read.

    Responses and revisits are read apart, by a predicate that the source applies to headers. Revisits have no payload to inflate.
    """
    spark, path = pages.sparkSession, new_folder(pages.sparkSession, "warc")
    write_pages(pages, path)
    responses = read(spark, path).where("record_type = 'response'")
    got = responses.unionByName(read(spark, path, payload=False).where("record_type = 'revisit'"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '-?[0-9]+', 0) as bigint)")
    own = F.col("record_type") == "response"
    return got.select(
        number("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, base32(F.sha1("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
