"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id, or
earlier in its own. Suffixes are sorted where they can be equal only: each ``LENGTH``-byte window is named by the
smallest hash among its ``GRAM``-byte strings, which depends on nothing but its content, so equal windows have
equal names. Windows whose name occurs once in the corpus are unique and stay where they are. Of the others the
runs of windows of one name, with their bytes, are contexts. Equal contexts collapse map-side: of those that a batch of documents holds the
earliest stays, and any other is repeated throughout, told by one range. So a passage of a third of all
documents is a few contexts a batch, not some of every document's.

Contexts are dealt out by name and sorted there, suffixes cut at ``LENGTH`` bytes: by
multikey sort on their first 8 bytes (shallow), and then by a blind trie per group of equal prefixes (deep): the
group's earliest suffix is the trie's path, every other hangs off it where their common prefix ends, and the
branches are groups of their own. Suffixes that follow the path to its end repeat it.

A name that has more than ``CROWD`` contexts even so, of different surroundings, would load one task. Its contexts are cut into single
windows, which collapse again, by digest: the earliest place of each is found map-side, and every later one repeats it.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import MAX_HOT_KEYS, broadcast_hot
from ..sources.store import stored
from .textops import chunks, constants, mix

LENGTH = 100
GRAM = 24
CROWD = 20_000  # contexts of a name, after equal ones of a batch collapsed, that one task sorts
HELD = 1 << 25  # bytes of a batch whose equal contexts collapse
ROWS = 20_000  # contexts that leave at once
PIECE = 1 << 19  # bytes of text whose windows are named at once, which takes about 60 times as many; a longer document is by itself
SORTED = 1 << 19  # windows of whole names that are sorted at once; the windows of one name are sorted together
NAMED = 1 << 23  # bytes of a batch whose names are told at once
CUT = 1000  # documents that are cut at once
_C = constants(3, 21)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, first, last) of every maximal run of windows of one document that have the same name.

    And the hash of the string at every place, and the name of the window there (0 where none begins).
    """
    n = len(data) - 8
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint64)
    eight = np.ndarray(n + 1, "<u8", data.data, strides=(1,))
    m = n - GRAM + 1
    h = mix(eight[:m] * _C[0] + eight[8 : 8 + m] * _C[1] + eight[16 : 16 + m] * _C[2])
    name = _sliding(h, LENGTH - GRAM + 1, np.minimum)  # of the window at every place
    inside = np.zeros(n - LENGTH + 2, np.int64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= LENGTH:
            inside[a] += 1
            inside[b - LENGTH + 1] -= 1
    valid = np.cumsum(inside[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (name[1:] != name[:-1])
    edge = offsets[(offsets < len(new))]
    new[edge] = valid[edge]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    return name[first], first, np.flatnonzero(stop), h, np.where(valid, name, np.uint64(0))


def ties(h: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Places of strings that name windows and equal the naming string before them.

    Only there can one run of windows hold equal ones, in text that repeats with a short period.
    """
    if not len(h):
        return np.zeros(0, np.int64)
    width = LENGTH - GRAM + 1
    pad = np.zeros(width - 1, np.uint64)
    naming = np.flatnonzero(h == _sliding(np.concatenate([pad, name, pad]), width, np.maximum))
    return naming[1:][h[naming[1:]] == h[naming[:-1]]]


def _names(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Names of runs with their documents: (bucket, names, docs, many).

    A name that several runs of a batch, or of ``NAMED`` bytes of it, have goes to its bucket once, marked as of many, and with all its
    documents to bucket -1, of names already known to be common. So no bucket gets more than one entry per name and NAMED bytes.
    """
    for batch in batches:
        ids, names, docs, size = batch.column(0).to_numpy(zero_copy_only=False), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for lo, _hi, data, offsets in chunks(batch.column(1), PIECE):
            name, first, _, h, of = runs(data, offsets)
            again = ties(h, of)
            names += [name, h[again]]
            docs.append(ids[lo + np.searchsorted(offsets, np.concatenate([first, again]), "right") - 1])
            size += len(data)
            if size > NAMED:
                yield _name_rows(np.concatenate(names), np.concatenate(docs).astype(np.int64), buckets)
                names, docs, size = names[:1], docs[:1], 0
        yield _name_rows(np.concatenate(names), np.concatenate(docs).astype(np.int64), buckets)


def _name_rows(name: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    own, first, of, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    here = np.flatnonzero(count[of] > 1)
    bucket = (own % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(at))
    pieces = [order[at[b] : at[b + 1]] for b in some]
    rows = [(int(b), own[p].tobytes(), doc[first[p]].tobytes(), (count[p] > 1).tobytes()) for b, p in zip(some, pieces, strict=True)]
    if len(here):
        rows.append((-1, name[here].tobytes(), doc[here].tobytes(), b""))
    types = {"bucket": pa.int32(), "names": pa.binary(), "docs": pa.binary(), "many": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def _common(table: pa.Table) -> pa.Table:
    """Of one bucket: (doc, name) of the names that occur more than once, but those that a batch told by itself."""
    name, doc, many = (
        np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("names", np.uint64), ("docs", np.int64), ("many", bool))
    )
    _, of, count = np.unique(name, return_inverse=True, return_counts=True)
    common = (count > 1)[of] & ~many
    return pa.table({"doc": doc[common], "name": name[common].astype(np.int64)})


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64)), pa.array(np.frombuffer(names, np.int64))], names=["doc", "name"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of common names: (key, doc, place, windows, bytes), and those that an earlier one of the batch equals, without bytes.

    The bytes tell the key, so they are told apart by their digest alone. Of each different context only the place in the batch's own text
    is held until the batch ends, or ``HELD`` bytes of it; rows leave ``ROWS`` at a time.
    """
    for batch in batches:
        done, seen, since = 0, {}, 0
        rows: list[array] = [array("q") for _ in range(6)]  # key, doc, place, windows, begin (-1: without bytes), end
        ids, lists, text = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        raw = memoryview(text.buffers()[2] or b"")
        base = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
        for lo, hi, data, offsets in chunks(text, PIECE):
            name, first, last, _, _ = runs(data, offsets)
            at, ahead = np.searchsorted(first, offsets), int(base[lo])
            name = name.astype(np.int64)
            for i in range(hi - done):
                wanted = np.sort(lists[done + i].values.to_numpy(zero_copy_only=False))
                own = name[at[i] : at[i + 1]]
                where = np.searchsorted(wanted, own)
                hits = at[i] + np.flatnonzero(wanted[np.minimum(where, len(wanted) - 1)] == own)
                doc, begin = int(ids[done + i]), int(offsets[i])
                for k, a, b in zip(name[hits].tolist(), first[hits].tolist(), last[hits].tolist(), strict=True):
                    digest, new = hashlib.blake2b(raw[ahead + a : ahead + b + LENGTH], digest_size=16).digest(), len(rows[0])
                    for column, value in zip(rows, (k, doc, a - begin, b - a + 1, ahead + a, ahead + b + LENGTH), strict=True):
                        column.append(value)
                    other = seen.setdefault(digest, new)
                    if other != new:
                        if (doc, a - begin) < (rows[1][other], rows[2][other]):
                            seen[digest], new = new, other
                        rows[4][new] = -1  # the earliest keeps its bytes
            done = hi
            if int(base[hi]) - since > HELD:
                yield from _context_rows(rows, raw)
                seen, since, rows = {}, int(base[hi]), [array("q") for _ in rows]
        yield from _context_rows(rows, raw)


def _context_rows(rows: list[array], raw: memoryview) -> Iterator[pa.RecordBatch]:
    key, doc, place, n, begin, end = (np.frombuffer(x, np.int64) for x in rows)
    for lo in range(0, len(key), ROWS):
        some = slice(lo, lo + ROWS)
        own = [raw[a:b].tobytes() if a >= 0 else None for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
        columns = [pa.array(key[some]), pa.array(doc[some]), pa.array(place[some].astype(np.int32)), pa.array(n[some].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())], names=["key", "doc", "place", "n", "bytes"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, doc, place) of every window of contexts; high and low are halves of its digest."""
    for batch in batches:
        out = []
        for doc, place, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "place", "n", "bytes")), strict=True):
            for p in range(n):
                own = hashlib.blake2b(raw[p : p + LENGTH], digest_size=16).digest()
                out.append((*struct.unpack("<qq", own), doc, place + p))
        types = {"high": pa.int64(), "low": pa.int64(), "doc": pa.int64(), "place": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types.values())], names=list(types))


def _later(windows: DataFrame) -> DataFrame:
    """(doc, first, last) of the windows that stand earlier too.

    The earliest place per digest is found map-side. Digests that hold over 1 / MAX_HOT_KEYS of the windows are
    broadcast, so that their windows never meet in a task; the others are joined.
    """
    digest = ["high", "low"]
    least = windows.groupBy(*digest).agg(F.min(F.struct("doc", "place")).alias("least"), F.count("*").alias("n"))
    least = stored(least.where("n > 1"), "earliest")
    limit = windows.count() / MAX_HOT_KEYS
    hot = least.where(F.col("n") > limit).select(*digest, "least")
    cold = least.where(F.col("n") <= limit).select(*digest, "least")
    rest = windows.join(broadcast_hot(hot.select(*digest)), digest, "left_anti")
    both = windows.join(broadcast_hot(hot), digest).unionByName(rest.join(cold, digest))
    later = both.where(F.struct("doc", "place") > F.col("least"))
    return later.select("doc", F.col("place").alias("first"), F.col("place").alias("last"))


def repeats(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which suffixes repeat, over LENGTH bytes, an earlier one of their group.

    ``data`` is padded by 8 bytes, ``at`` the suffixes' places in it in document order, ``group`` a number each.
    """
    eight = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    found = np.zeros(len(at), bool)
    # Shallow: stable sort by group and first 8 bytes.
    key = eight[at].byteswap()
    order = np.lexsort((key, group))
    key, g = key[order], group[order]
    label = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (g[1:] != g[:-1])))[: len(order)]
    starts = [*range(8, LENGTH - 7, 8), LENGTH - 8]
    while len(order):
        # Groups of one are in their place.
        new = np.append(True, label[1:] != label[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(label)))
        pivot = np.repeat(head, size)
        many = np.repeat(size, size) > 1
        rest = np.flatnonzero(many & ~new)
        if not len(rest):
            break
        mine, path = at[order[rest]], at[order[pivot[rest]]]
        # Deep: where each leaves the path of its group's earliest suffix.
        common = np.full(len(rest), LENGTH)
        open_ = np.arange(len(rest))
        for s in starts:
            differ = eight[mine[open_] + s] ^ eight[path[open_] + s]
            left = differ != 0
            low = differ[left] & (~differ[left] + np.uint64(1))
            common[open_[left]] = s + (np.log2(low.astype(np.float64)) / 8).astype(np.int64)
            open_ = open_[~left]
            if not len(open_):
                break
        same = common >= LENGTH
        found[order[rest[same]]] = True
        branch = rest[~same]
        way = common[~same]
        letter = data[at[order[branch]] + way].astype(np.int64)
        child = (label[branch] * (LENGTH + 1) + way) * 256 + letter
        down = np.argsort(child, kind="stable")
        order, child = order[branch[down]], child[down]
        label = np.cumsum(np.append(True, child[1:] != child[:-1]))[: len(order)]
    return found


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows (doc, first, last) that repeat an earlier one, of the names in this task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by([("key", "ascending")])
    keys = table.column("key").to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    windows = np.append(0, np.cumsum(table.column("n").to_numpy(), dtype=np.int64))[edges]  # before each key
    lo = 0
    while lo < len(edges) - 1:  # some keys at a time, so that memory is bounded by the largest of them
        hi = max(lo + 1, int(np.searchsorted(windows, windows[lo] + SORTED, "right")) - 1)
        part = table.slice(edges[lo], edges[hi] - edges[lo]).sort_by([("doc", "ascending"), ("place", "ascending")]).combine_chunks()
        lo = hi
        n, key = part.column("n").to_numpy(), part.column("key").to_numpy()
        doc, place = part.column("doc").to_numpy(), part.column("place").to_numpy()
        raw = [x.as_py() for x in part.column("bytes")]
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        begin = np.cumsum([0, *(len(r) for r in raw)])[:-1]
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hit = repeats(data, begin[row] + step, key[row])
        first = hit.copy()
        first[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        last = hit.copy()
        last[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
        f, t = np.flatnonzero(first), np.flatnonzero(last)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row[f]]), pa.array((place[row[f]] + step[f]).astype(np.int32)), pa.array((place[row[t]] + step[t]).astype(np.int32))],
            names=["doc", "first", "last"],
        )


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(lo, CUT) for b in batches for lo in range(0, b.num_rows, CUT)):
        out = []
        for doc, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode()
            mark = np.zeros(len(raw) + 1, np.int32)
            for r in ranges:
                mark[r["first"]] += 1
                mark[r["last"] + LENGTH] -= 1
            gone = np.cumsum(mark[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int((gone & ~np.append(False, gone[:-1])).sum())
            out.append((doc, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", texts: bool = False, crowd: int = CROWD) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of ``docs``.

    A null text is empty; texts under LENGTH bytes lose nothing; equal texts are found first by digest, and only the
    one of the smallest id is searched. Rows of equal id and text are one document, and each gets its result; different texts under one
    id are documents of their own, in the order of their digests. Rows of a null id are passed through whole. An empty
    table gives no rows. ``kept`` (with ``texts``) are the remaining bytes, null where none were removed. ``crowd`` bounds the
    contexts that one task sorts for a name.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = stored(rows.select("doc", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "sizes")
    if sizes.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty():
        out = _of_distinct(rows, sizes, crowd, texts)
    else:
        out = _of_repeated(rows, sizes, crowd, texts)
    return out if texts else out.drop("kept")


def _of_repeated(rows: DataFrame, sizes: DataFrame, crowd: int, texts: bool) -> DataFrame:
    """The same where ids repeat: distinct pairs of id and text are numbered in order, and the numbers take the ids' place."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = sizes.where("doc is not null").select("doc", "sha", "n_bytes").distinct()
    ordered = pairs.repartitionByRange(tasks, "doc", "sha").sortWithinPartitions("doc", "sha")
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    in_range, first = F.shiftright("at", 33).alias("range"), W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ordered.groupBy(in_range).agg(F.min("at").alias("start"), F.count("*").alias("n"))  # a row per range
    ranges = ranges.select("range", "start", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    number = (F.col("at") - F.col("start") + F.col("before")).alias("number")
    numbered = stored(ordered.withColumn("range", in_range).join(F.broadcast(ranges), "range").select("doc", "sha", "n_bytes", number), "numbered")
    own = rows.withColumn("sha", F.sha2("text", 256)).join(numbered, ["doc", "sha"]).select(F.col("number").alias("doc"), "text")
    found = _of_distinct(own.dropDuplicates(["doc"]), numbered.select(F.col("number").alias("doc"), "n_bytes", "sha"), crowd, texts)
    found = found.withColumnRenamed("doc", "number").drop("n_bytes")
    both = sizes.join(numbered.drop("n_bytes"), ["doc", "sha"], "left").join(found, "number", "left")
    none = F.lit(0).cast("bigint")
    return both.select(
        "doc", "n_bytes", *(F.coalesce(c, none).alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept"
    )


def _of_distinct(rows: DataFrame, sizes: DataFrame, crowd: int, texts: bool) -> DataFrame:
    """The same for ids that occur once, or are null."""
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = sizes.where((F.col("n_bytes") >= LENGTH) & F.col("doc").isNotNull())
    firsts = long.groupBy("sha").agg(F.min("doc").alias("first"))
    own = rows.where("doc is not null")
    packed = stored(own.mapInArrow(partial(_names, buckets=buckets), "bucket int, names binary, docs binary, many binary"), "packed-names")
    alone = packed.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_common, "doc bigint, name bigint")
    known = packed.where("bucket < 0").select("names", "docs").mapInArrow(_known, "doc bigint, name bigint")
    lists = alone.unionByName(known).join(firsts.select(F.col("first").alias("doc")), "doc", "left_semi").groupBy("doc")
    lists = stored(lists.agg(F.collect_set("name").alias("names")), "names")
    found = own.join(lists, "doc").select("doc", "text", "names")
    contexts = stored(found.mapInArrow(_contexts, "key bigint, doc bigint, place int, n int, bytes binary"), "contexts")
    ranges = _ranges(contexts, 2 * buckets, crowd)
    ranges = stored(ranges.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    schema = "doc bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    cut = own.join(ranges, "doc").select("doc", "text", "ranges").mapInArrow(partial(_cut, texts=texts), schema)
    copy = (F.col("first") < F.col("doc")) & (F.col("n_bytes") >= LENGTH)
    out = sizes.join(firsts, "sha", "left").join(cut, "doc", "left")
    return out.select(
        "doc", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("kept")).alias("kept"),
    )


def _ranges(contexts: DataFrame, tasks: int, crowd: int) -> DataFrame:
    """(doc, first, last) of windows that stand earlier too."""
    known = contexts.where("bytes is null").select("doc", F.col("place").alias("first"), (F.col("place") + F.col("n") - 1).alias("last"))
    whole = contexts.where("bytes is not null")
    crowded = stored(whole.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    if crowded.isEmpty():
        return known.unionByName(whole.repartition(tasks, "key").mapInArrow(_sorted, "doc bigint, first int, last int"))
    rest = whole.join(crowded, "key", "left_anti").repartition(tasks, "key").mapInArrow(_sorted, "doc bigint, first int, last int")
    windows = whole.join(crowded, "key", "left_semi").mapInArrow(_windows, "high bigint, low bigint, doc bigint, place int")
    return known.unionByName(rest).unionByName(_later(stored(windows, "windows")))
