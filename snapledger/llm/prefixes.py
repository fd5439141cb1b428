"""The prefix trie of conversations, as member intervals over their sorted order.

A conversation is its sequence of turn digests; equal sequences are one, with a count. Sorted, the members of a prefix stand
together: from any of them, the prefix reaches left and right as far as the longest common prefixes (LCPs) of neighbours are as
long as it is. Both ends are found by binary search over a sparse table of range minima, for each prefix by itself, with no
stack and no tree. What a node reports is a difference of running sums, or a range minimum, between these ends.

The order is cut into ranges, a range being one task's work. A range knows its own sequences and the next range's
first one. A node is told whole by its range, unless it reaches the range's first sequence, or the next range's: then each range
tells its part, and the parts, a few per range, are added. Sums over subtrees add up, as a distinct node counts in the range where it
ends, and a conversation in its own. Only children of such nodes look up their parent in another range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stored

TURNS = 1 << 19  # turns of distinct sequences per range
LISTED = 4096  # conversation ids that are packed in one string
DIGEST = 16  # bytes of a turn's digest
NOTHING = hashlib.sha256(b"").hexdigest()

_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODES = (
    "node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_PACKED = "seq binary, first bigint, n bigint, ids string"
_ENDS = "seq binary, conv_id bigint, n bigint, ends_sha256 string"


def sequences(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, digests, sizes) per conversation: its turns in order, as hexadecimal digests, and their texts' bytes.

    Turns are ordered by ``turn``, null first, ties by role and digest. A null role or text is an empty one. Rows without
    a conversation are left out; repeated rows are turns of their own.
    """
    said, spoken = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, spoken)
    rows = turns.where(F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        said.alias("role"),
        F.substring(F.sha2(whole, 256), 1, 2 * DIGEST).alias("digest"),
        F.octet_length(spoken).alias("size"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "size"))).alias("turns"))
    return listed.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation c with its first turns, crc32(c) modulo 9 of them, taken from c - c % 5.

    Up to five conversations share one such beginning, so they meet in a group of five.
    """
    c = F.col("conv_id")
    kept = F.crc32(c.cast("string").cast("binary")) % 9
    five = conversations.groupBy((c - c % 5).alias("base")).agg(F.collect_list(F.struct("conv_id", "digests", "sizes")).alias("all"))
    base = F.get(F.filter("all", lambda x: x["conv_id"] == F.col("base")), F.lit(0))
    rows = five.select(F.explode("all").alias("own"), base.alias("base")).select("own.*", "base")

    def joined(part: str) -> Column:
        own = F.col(part)
        ahead = F.coalesce(F.slice(F.col("base")[part], F.lit(1), kept.cast("int")), F.slice(own, F.lit(1), F.lit(0)))
        return F.concat(ahead, F.slice(own, (kept + 1).cast("int"), F.size(own))).alias(part)

    return rows.select("conv_id", joined("digests"), joined("sizes"))


# --- conversations of equal sequences ----------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of consecutive rows of one sequence, joined, some at a time; rows come sorted."""
    for batch in batches:
        seqs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, lo = [], 0
        while lo < len(seqs):
            hi = lo + 1
            while hi < len(seqs) and hi - lo < LISTED and seqs[hi] == seqs[lo]:
                hi += 1
            out.append((seqs[lo], ids[lo], hi - lo, ",".join(map(str, ids[lo:hi]))))
            lo = hi
        types = {"seq": pa.binary(), "first": pa.int64(), "n": pa.int64(), "ids": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types.values())], names=list(types))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence; the digest of its ids is made as they stream by."""
    types = {"seq": pa.binary(), "conv_id": pa.int64(), "n": pa.int64(), "ends_sha256": pa.string()}
    seq, first, n, state, out = None, 0, 0, None, []

    def to_batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types.values())], names=list(types))

    for batch in batches:
        for own, begin, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != seq:
                if seq is not None:
                    out.append((seq, first, n, state.hexdigest()))
                seq, first, n, state = own, begin, 0, hashlib.sha256()
            state.update(("," if n else "").encode() + ids.encode())
            n += count
        yield to_batch()
        out.clear()
    if seq is not None:
        out.append((seq, first, n, state.hexdigest()))
    yield to_batch()


def distinct_sequences(conversations: DataFrame, tasks: int) -> DataFrame:
    """(key, sizes, conv_id, n, ends_sha256): distinct sequences, their smallest conversation, how many have them, and a digest of all.

    The ids of a very common sequence are sorted and joined in ranges, each of many tasks; one task then digests the strings
    in order, as SHA-256 is sequential, and never holds more than some of them.
    """
    key = F.array_join("digests", "")
    rows = stored(conversations.select("conv_id", key.alias("key"), "sizes", F.unhex(F.sha2(key, 256)).alias("seq")), "conversations")
    ids = rows.select("seq", "conv_id").repartitionByRange(tasks, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    packed = ids.mapInArrow(_pack, _PACKED).repartition(tasks, "seq").sortWithinPartitions("seq", "first")
    ends = packed.mapInArrow(_ends, _ENDS)
    # Of all conversations of a sequence, the smallest brings the sequence itself.
    return rows.join(ends, ["seq", "conv_id"]).select("key", "sizes", "conv_id", "n", "ends_sha256")


# --- one range of the order -------------------------------------------------------


class Ranges:
    """Minimum over any stretch of an array, and how far a bound holds from a place, both from one sparse table."""

    def __init__(self, x: np.ndarray):
        self.n, self.table = len(x), [x]
        while 2 << (len(self.table) - 1) <= len(x):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of x[lo], ..., x[hi]."""
        level = (np.frexp(hi - lo + 1)[1] - 1).astype(np.int64)
        out = np.empty(len(lo), self.table[0].dtype)
        for t in np.unique(level):
            at = np.flatnonzero(level == t)
            out[at] = np.minimum(self.table[t][lo[at]], self.table[t][hi[at] - (1 << int(t)) + 1])
        return out

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on whose value is below the bound, or the end."""
        at = at.copy()
        for t in reversed(range(len(self.table))):
            low = self.table[t]
            holds = (at < len(low)) & (low[np.minimum(at, len(low) - 1)] >= bound)
            at += holds.astype(np.int64) << t
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` whose value is below the bound, or -1."""
        at = at.copy()
        for t in reversed(range(len(self.table))):
            begin = at - (1 << t) + 1
            holds = (begin >= 0) & (self.table[t][np.clip(begin, 0, len(self.table[t]) - 1)] >= bound)
            at -= holds.astype(np.int64) << t
        return at


def _neighbours(turns: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that each sequence has in common with the one before it; -1 for the first."""
    lcp = np.zeros(len(size), np.int64)
    lcp[:1] = -1
    open_, d = np.arange(1, len(size)), 0
    while len(open_):
        open_ = open_[(size[open_] > d) & (size[open_ - 1] > d)]
        open_ = open_[(turns[start[open_] + d] == turns[start[open_ - 1] + d]).all(axis=1)]
        d += 1
        lcp[open_] = d
    return lcp


def _names(key: bytes, depth: int) -> list[bytes]:
    """What the prefixes of a sequence, of 0 to ``depth`` turns, are called in all ranges."""
    state = hashlib.blake2b(digest_size=24)
    out = [state.digest()]
    for d in range(depth):
        state.update(key[DIGEST * d : DIGEST * (d + 1)])
        out.append(state.digest())
    return out


def _nodes(keys: list[bytes], bytes_: list[list[int]], convs: np.ndarray, counts: np.ndarray, ends: list[str], after: bytes | None) -> pa.RecordBatch:
    """All nodes that the sequences of one range have, whole ones and parts. ``after`` is the next range's first sequence."""
    m = len(keys)
    size = np.array([len(k) // DIGEST for k in keys])
    whole = [*keys, after] if after is not None else keys
    length = np.array([len(k) // DIGEST for k in whole])
    turns = np.frombuffer(b"".join(whole), "<u8").reshape(-1, DIGEST // 8)
    lcp = _neighbours(turns, np.cumsum(length) - length, length)
    nxt = np.append(lcp[1:], -1)[:m]  # with the one after it
    lcp = lcp[:m]
    # Running bytes of each sequence: cum[begin[p] + d] of its first d turns.
    begin = np.cumsum(size + 1) - (size + 1)
    cum = np.zeros(len(size) + int(size.sum()), np.int64)
    flat = np.fromiter((b for row in bytes_ for b in row), np.int64, int(size.sum()))
    inner = np.ones(len(cum), bool)
    inner[begin] = False
    cum[inner] = flat
    cum = np.cumsum(cum)
    cum -= np.repeat(cum[begin], size + 1)
    total = cum[begin + size]

    # Candidates: every prefix at the first sequence that has it.
    new = size - lcp
    first = np.repeat(np.arange(m), new)
    offset = np.cumsum(new) - new
    depth = np.arange(len(first)) - np.repeat(offset - lcp - 1, new)
    ranges, smallest = Ranges(lcp), Ranges(convs)
    lo = np.maximum(ranges.left(first, depth), 0)
    hi = ranges.right(first + 1, depth) - 1
    parent_depth = depth - 1
    ahead = np.where(parent_depth > lcp[first], first, np.maximum(ranges.left(first, parent_depth), 0))
    parent = np.where(depth > 0, offset[ahead] + parent_depth - lcp[ahead] - 1, -1)

    def over(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        running = np.append(0, np.cumsum(x))
        return running[hi + 1] - running[lo]

    def upto(p: np.ndarray, d: np.ndarray) -> np.ndarray:
        return cum[begin[p] + np.maximum(d, 0)]

    every = np.arange(m)
    leaf = (nxt < size).astype(np.int64)
    closing = total - upto(every, nxt)  # bytes of the nodes whose last member a sequence is
    closes = nxt[hi] < depth
    n = over(counts, lo, hi)
    told = over(counts * total, lo, hi) - upto(first, depth - 1) * n
    kept = over(closing, lo, hi - 1) + total[hi] - upto(hi, np.maximum(depth - 1, nxt[hi]))
    children = np.bincount(parent[closes & (depth > 0)], minlength=len(first))
    # A leaf whose sequence ends the range is told by the next one's first sequence, which is at hand.
    part = (lo == 0) | ~closes
    own = smallest.least(lo, hi)
    ended = np.where(size[first] == depth, first, -1)

    partial_parent = (depth > 0) & part[parent]
    ahead, behind = _names(keys[0], int(size[0])), _names(keys[-1], int(nxt[-1]))
    names = {i: (ahead if lo[i] == 0 and d <= size[0] else behind)[d] for i, d in zip(np.flatnonzero(part).tolist(), depth[part].tolist(), strict=True)}
    columns = [
        pa.array([names.get(i) for i in range(len(first))], pa.binary()),
        pa.array([names[p] if up else None for p, up in zip(parent.tolist(), partial_parent.tolist(), strict=True)], pa.binary()),
        pa.array(own),
        pa.array(depth),
        pa.array(own[parent], mask=(depth == 0) | partial_parent),
        pa.array(n),
        pa.array(children.astype(np.int64)),
        pa.array(over(leaf, lo, hi)),
        pa.array(told - kept),
        pa.array([ends[p] if p >= 0 else None for p in ended.tolist()], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODES.split(", ")])


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every range among sorted rows (pid, key, sizes, conv_id, n, ends_sha256); one without a conversation ends a range."""
    pid, held = None, []

    def told() -> Iterator[pa.RecordBatch]:
        after = bytes.fromhex(held.pop()[0]) if held and held[-1][2] is None else None
        if held:
            keys, sizes, convs, counts, ends = zip(*held, strict=True)
            yield _nodes([bytes.fromhex(k) for k in keys], list(sizes), np.array(convs), np.array(counts), list(ends), after)

    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != pid:
                yield from told()
                pid, held = own, []
            held.append(row)
    yield from told()


def trie(conversations: DataFrame, turns_per_range: int = TURNS) -> DataFrame:
    """One row per distinct prefix of (conv_id, digests, sizes) rows, the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, turns of the prefix,
    the parent's smallest member (null at the root), members, children, childless nodes of the subtree, what its nodes' last
    texts save in bytes when each is stored once, and the SHA-256 of the joined ids of members that end here. Conversation
    ids are expected once, as ``sequences`` and ``rebuilt`` give them. No conversation, no node. A conversation's digests, 16 bytes a
    turn, are in one row, and a range's in one task; texts are not.
    """
    spark = conversations.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = stored(distinct_sequences(conversations, shuffles), "sequences")
    turns = distinct.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    tasks = max(shuffles, math.ceil(turns / turns_per_range))
    ordered = distinct.repartitionByRange(tasks, "key").withColumn("pid", F.spark_partition_id())
    ordered = stored(ordered.select("pid", "key", "sizes", "conv_id", "n", "ends_sha256"), "ranges")
    # One row per range: the next one's first sequence.
    firsts = ordered.groupBy("pid").agg(F.min("key").alias("key")).withColumn("pid", F.lag("pid").over(W.orderBy("pid")))
    none = {c: F.lit(None).cast(t) for c, t in (("sizes", "array<int>"), ("conv_id", "bigint"), ("n", "bigint"), ("ends_sha256", "string"))}
    dealt = ordered.unionByName(firsts.where("pid is not null").withColumns(none))
    dealt = dealt.repartition(tasks, "pid").sortWithinPartitions("pid", "key")
    nodes = stored(dealt.mapInArrow(_trie, _NODES), "nodes")

    parts = nodes.where("node is not null").groupBy("node", "depth", "parent")
    merged = parts.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in _SUMS), F.max("ends_sha256").alias("ends_sha256"))
    merged = stored(merged, "shared-nodes")
    whole = nodes.where("node is null").select("parent", "conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256")
    both = whole.unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*whole.columns))
    known = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    return both.join(known, "parent", "left").select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        *_SUMS,
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


# The fold is the checksum CRC-32 of a decimal number, which the database has no function for.
SQL = """
with own as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
marked as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: ascii(ch)::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end)::bigint)), 4294967295::bigint) % 9 as h
  from own),
c as (
  select m.conv_id, list_concat(coalesce(b.turns[1:m.h], []), m.turns[m.h + 1:]) as turns
  from marked m left join own b on b.conv_id = m.conv_id - m.conv_id % 5),
prefix as (select conv_id, turns, d, turns[1:d] as node from (select *, unnest(range(len(turns) + 1)) as d from c)),
node as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(turns) = d), '')) as ends_sha256,
    (count(*) - 1) * coalesce(strlen(node[d].t), 0) as saved
  from prefix group by node, d),
kids as (select node[1:d - 1] as node, count(*) as n_children from node where d > 0 group by all),
whole as (select node.*, coalesce(n_children, 0) as n_children from node left join kids on node.node = kids.node),
under as (
  select node[1:k] as node, cast(count(*) filter (n_children = 0) as bigint) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
  from (select *, unnest(range(d + 1)) as k from whole) group by all)
select w.conv_id, cast(w.d as bigint) as depth, up.conv_id as parent_conv_id, w.n_convs, w.n_children, under.n_leaves, under.saved_tokens, w.ends_sha256
from whole w join under on under.node = w.node left join node up on w.d > 0 and up.node = w.node[1:w.d - 1]
"""
