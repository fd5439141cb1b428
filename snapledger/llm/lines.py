"""Removal of lines that an earlier document holds too, suspected through two Bloom filters, then confirmed.

A line's key is the line without blanks at its ends, A-Z lowered; keys under ``LEAST`` characters are left alone. A key in
several documents loses its lines everywhere but in the document of the smallest id.

Lines do not shuffle to be compared. Every task makes its distinct keys' 128-bit digests, packed by shard of the digest, and
a shard's task puts them into two Bloom filters: one of digests seen once, and, if that one knew them, one of digests
seen twice. Both belong to the shard, so their size is bounded and neither the driver nor any executor holds a filter
of the whole corpus. Digests that the second filter knows are suspects. Only suspects become rows: the smallest document per
digest is found map-side, which confirms the repeats exactly and drops what the filters mistook.

A key that many documents of one task hold goes to its shard once, marked as repeated; its documents are suspects at
once and never meet in the shard's task. So a line of a third of all documents loads no shard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import MAX_HOT_KEYS, broadcast_hot
from ..sources.store import stored

LEAST = 10  # characters of the shortest key that counts
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
SHARD_BYTES = 64 << 20  # text per shard of the filters
HELD = 1 << 17  # digests a task holds before it sends them on
BITS, PROBES = 16, 4  # of a filter, per digest
DIGEST = 16
ALONE, MARKED, SUSPECT = 0, 1, 2  # what a packed row holds: digests with their one document, repeated digests, suspects

_CONTINUATION = bytes(range(0x80, 0xC0))
_PACKED = "kind int, shard bigint, digests binary, docs binary"
_FOUND = "digest binary, doc bigint"


def digests(text: bytes, least: int = LEAST) -> list[bytes | None]:
    """The digest of every line's key, None for a key that is too short."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip(BLANKS)
        long = len(key) >= least and (len(key) >= 4 * least or len(key.translate(None, _CONTINUATION)) >= least)
        out.append(hashlib.blake2b(key, digest_size=DIGEST).digest() if long else None)
    return out


def _blob(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, DIGEST)


def _halves(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(raw).view("<u8")
    return both[:, 0], both[:, 1] | np.uint64(1)


def _by_shard(kind: int, raw: np.ndarray, docs: np.ndarray, shards: int) -> Iterator[tuple]:
    shard = (_halves(raw)[0] >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(shard[order]) > 0)) if len(order) else order
    for piece in np.split(order, edge[1:]) if len(order) else []:
        yield kind, int(shard[piece[0]]), raw[piece].tobytes(), docs[piece].tobytes()


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "shard": pa.int64(), "digests": pa.binary(), "docs": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def _pack(batches: Iterator[pa.RecordBatch], shards: int, least: int, held: int) -> Iterator[pa.RecordBatch]:
    """A task's distinct digests by shard, and the suspects that it knows by itself."""
    first: dict[bytes, int | None] = {}  # None once several documents hold it
    again: list[tuple[bytes, int]] = []

    def send() -> pa.RecordBatch:
        alone = [(d, doc) for d, doc in first.items() if doc is not None]
        marked = _blob([d for d, doc in first.items() if doc is None])
        rows = list(_by_shard(ALONE, _blob([d for d, _ in alone]), np.array([doc for _, doc in alone], np.int64), shards))
        rows += _by_shard(MARKED, marked, np.zeros(len(marked), np.int64), shards)
        if again:
            rows.append((SUSPECT, 0, b"".join(d for d, _ in again), np.array([doc for _, doc in again], np.int64).tobytes()))
        first.clear()
        again.clear()
        return _to_batch(rows)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for d in set(digests(text, least)) - {None}:
                if d not in first:
                    first[d] = doc
                elif first[d] is None:
                    again.append((d, doc))
                elif first[d] != doc:
                    again += [(d, first[d]), (d, doc)]
                    first[d] = None
            if len(first) + len(again) > held:
                yield send()
    yield send()


class Bloom:
    """A set of digests that may know too many, never too few."""

    def __init__(self, expected: int):
        self.mask = np.uint64((1 << max(10, math.ceil(math.log2(BITS * max(1, expected))))) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)

    def _places(self, raw: np.ndarray) -> np.ndarray:
        a, b = _halves(raw)
        return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & self.mask

    def add(self, raw: np.ndarray) -> None:
        at = self._places(raw).ravel()
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def knows(self, raw: np.ndarray) -> np.ndarray:
        at = self._places(raw)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).all(axis=1)


def _pieces(held: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(digests, documents, marked) of some packed rows at a time."""
    lo = 0
    while lo < len(held):
        hi, size = lo, 0
        while hi < len(held) and size < HELD * DIGEST:
            size += len(held[hi][1])
            hi += 1
        part = held[lo:hi]
        raw, docs = _blob([d for _, d, _ in part]), np.frombuffer(b"".join(x for _, _, x in part), np.int64)
        yield raw, docs, np.repeat([kind == MARKED for kind, _, _ in part], [len(x) // 8 for _, _, x in part])
        lo = hi


def _suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, doc) of this task's digests that the filter of twice-seen ones knows."""
    held = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("kind", "digests", "docs")), strict=True)]
    if not held:
        return
    n = sum(len(d) for _, d, _ in held) // DIGEST
    once, twice = Bloom(n), Bloom(n)
    for raw, _, marked in _pieces(held):
        # Digests of several packed rows may be equal here, before the first filter has either.
        _, at, count = np.unique(np.ascontiguousarray(raw).view(f"V{DIGEST}").ravel(), return_index=True, return_counts=True)
        twice.add(np.concatenate([raw[marked], raw[at[count > 1]], raw[at][once.knows(raw[at])]]))
        once.add(raw[at])
    for raw, docs, marked in _pieces(held):
        hit = np.flatnonzero(twice.knows(raw) & ~marked)
        yield _rows_of(raw[hit], docs[hit])


def _rows_of(raw: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(raw), [None, pa.py_buffer(raw.tobytes())])
    return pa.RecordBatch.from_arrays([digest.cast(pa.binary()), pa.array(docs, pa.int64())], names=["digest", "doc"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, docs in zip(*(batch.column(c).to_pylist() for c in ("digests", "docs")), strict=True):
            yield _rows_of(_blob([d]), np.frombuffer(docs, np.int64))


def _later(found: DataFrame) -> DataFrame:
    """(digest, doc) of every suspect that a document of smaller id holds too.

    Counted map-side. Digests of over 1 / MAX_HOT_KEYS of the suspects, fewer than MAX_HOT_KEYS by their definition, are
    broadcast and their rows stay where they are; the others meet in a join.
    """
    least = found.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    least = stored(least.where("first < last"), "line-firsts")
    limit = found.count() / MAX_HOT_KEYS
    hot, cold = (least.where(x).select("digest", "first") for x in (F.col("n") > limit, F.col("n") <= limit))
    rest = found.join(broadcast_hot(hot.select("digest")), "digest", "left_anti")
    both = found.join(broadcast_hot(hot), "digest").unionByName(rest.join(cold, "digest"))
    return both.where(F.col("doc") > F.col("first")).select("digest", "doc")


def _cut(batches: Iterator[pa.RecordBatch], least: int, texts: bool) -> Iterator[pa.RecordBatch]:
    types = {"doc": pa.int64(), "n_lines": pa.int64(), "n_dropped": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    for batch in batches:
        rows = []
        for doc, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, kept = text.count(b"\n") + 1, text
            left = n
            if gone:
                gone = set(gone)
                lines = [line for line, d in zip(text.split(b"\n"), digests(text, least), strict=True) if d not in gone]
                kept, left = b"\n".join(lines), len(lines)
            rows.append((doc, n, n - left, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def drop_repeated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, texts: bool = False, held: int = HELD
) -> DataFrame:
    """(doc, n_lines, n_dropped, kept_sha256[, kept]) per row of ``docs``; ``kept`` is the remaining text in UTF-8.
    ``held`` bounds the digests that a task collects before it sends them on.

    A null or empty text is one empty line, which stays. Rows of equal id count as one document: what only they share stays in all
    of them. Rows of a null id are passed through whole, and their lines count nowhere. Lines repeated inside one document
    stay or go together. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    own = rows.where("doc is not null")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD_BYTES))
    packed = stored(own.mapInArrow(partial(_pack, shards=shards, least=least, held=held), _PACKED), "line-digests")
    dealt = packed.where(F.col("kind") != SUSPECT).repartition(shards, "shard").mapInArrow(_suspect, _FOUND)
    known = packed.where(F.col("kind") == SUSPECT).mapInArrow(_unpack, _FOUND)
    gone = _later(stored(dealt.unionByName(known), "line-suspects")).groupBy("doc").agg(F.collect_set("digest").alias("gone"))
    cut = rows.join(gone, "doc", "left").select("doc", "text", "gone")
    out = cut.mapInArrow(partial(_cut, least=least, texts=texts), "doc bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")


SQL = """
with line as (
  select doc_id, nth, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as nth
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
shared as (select key, min(doc_id) as first from line where length(key) >= 10 group by key having count(distinct doc_id) > 1),
marked as (select line.*, coalesce(line.doc_id > shared.first, false) as gone from line left join shared on line.key = shared.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by nth) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
