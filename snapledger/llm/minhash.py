"""Near-duplicates by min-max hashing.

A document is the set of its distinct shingles. Under each of ``PERMUTATIONS`` multiplications modulo 2^64
both the smallest and the largest value are kept: two samples for one pass, and both agree between two sets
about as often as their Jaccard similarity says. A band joins the two values of two permutations. At a
similarity of 0.8 a pair misses all 32 bands with a chance of about 5e-8 (at most 1e-6 for sets of a few
shingles, where the two values are less independent).

Documents of equal sets are one node. In a bucket, every node is compared with the smallest one only;
linked nodes fall into components. Where a bucket still holds several, its other members meet a few of the
largest one's, which merges nearly all of a group of copies; what stays apart is compared pair by
pair, unless something rules a link out: the distances to the smallest one (the Jaccard distance is a metric), or
their bitmaps: each shingle flips one of ``BITS`` bits, so two sets differ in at least as many shingles as their bitmaps
in bits. So a group of copies costs about one comparison a copy and band, and no link is lost by that. Every link is
confirmed on the full sets.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import partial, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .components import components
from .textops import NOT_SPACE, chunks, constants, hashes, mix, runs, words

PERMUTATIONS = 64
BANDS = 32
BITS = 1024
PIVOTS = 4  # members of a bucket's largest component that its other members are compared with in a round
ROUNDS = 2
SIMILARITY = 0.8
_MULTIPLY = constants(PERMUTATIONS, 11)
_SIGNED = "doc bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of rows: sorted distinct shingle hashes, and where each row's begin."""
    for _lo, _hi, data, offsets in chunks(column):
        low, start, end, first = words(data, offsets, NOT_SPACE)
        h = hashes(low, start, end)
        count = np.diff(first)
        row = np.repeat(np.arange(len(count)), count)
        if len(h) >= width:
            s = runs(h, width, 3)
            whole = row[: len(s)] == row[width - 1 :]
            s, owner = s[whole], row[: len(s)][whole]
        else:
            s, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):  # the whole sequence as one shingle
            one = [runs(h[first[i] : first[i + 1]], count[i], 3 + int(count[i]))[0] for i in short]
            s, owner = np.concatenate([s, np.array(one, np.uint64)]), np.concatenate([owner, short])
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[new], owner[new]
        yield s, np.searchsorted(owner, np.arange(len(count) + 1))


def signatures(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band hashes, a row for each set; ``at``: where the sets, none empty, begin in s."""
    ends = np.zeros((len(at), 2 * PERMUTATIONS), np.uint64)
    for i, c in enumerate(_MULTIPLY):
        y = s * c
        ends[:, 2 * i] = np.minimum.reduceat(y, at)
        ends[:, 2 * i + 1] = np.maximum.reduceat(y, at)
    rows = 2 * PERMUTATIONS // BANDS
    spread = ends.reshape(len(at), BANDS, rows) * constants(rows, 12)
    return mix(spread.sum(axis=2, dtype=np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for s, at in shingle_sets(batch.column(1), width):
            n = np.diff(at)
            keys = np.zeros((len(n), 2), np.int64)
            for i in np.flatnonzero(n):
                keys[i] = np.frombuffer(blake2b(s[at[i] : at[i + 1]].tobytes(), digest_size=16).digest(), np.int64)
            full = n > 0
            bands = signatures(s, at[:-1][full]).astype(np.int64).ravel() if full.any() else np.zeros(0, np.int64)
            places = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(done, len(n)), pa.array(n.astype(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.ListArray.from_arrays(places, pa.array(bands))],
                names=["doc", "n_shingles", "k1", "k2", "bands"],
            )
            done += len(n)


def _compare(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, ta, tb = batch.columns
        ids = a.to_numpy(zero_copy_only=False)
        _, first, which = np.unique(ids, return_index=True, return_inverse=True)

        def sets(column: pa.Array) -> list[np.ndarray]:
            return [s[i:j] for s, at in shingle_sets(column, width) for i, j in zip(at[:-1], at[1:], strict=True)]

        left, right = sets(ta.take(pa.array(first))), sets(tb)
        both = np.array([len(np.intersect1d(left[w], r, assume_unique=True)) for w, r in zip(which, right, strict=True)], np.int64)
        total = np.array([len(left[w]) + len(r) for w, r in zip(which, right, strict=True)], np.int64) - both
        yield pa.RecordBatch.from_arrays([a, b, pa.array(both), pa.array(total)], names=["a", "b", "n_both", "n_all"])


def bitmaps(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per set, BITS bits: whether an odd number of its shingles falls on each."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place, count = np.unique(row * BITS + (mix(s) % np.uint64(BITS)).astype(np.int64), return_counts=True)
    place = place[count % 2 == 1]
    out = np.zeros((len(at) - 1) * (BITS // 64), np.uint64)
    np.bitwise_or.at(out, place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    return out.reshape(len(at) - 1, BITS // 64)


def _map(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for s, at in shingle_sets(batch.column(1), width):
            n = np.diff(at)
            places = np.arange(0, (len(n) + 1) * (BITS // 64), BITS // 64, dtype=np.int32)
            bits = pa.ListArray.from_arrays(places, pa.array(bitmaps(s, at).astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), pa.array(n.astype(np.int64)), bits], names=["node", "size", "bits"])
            done += len(n)


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Stored (a, b, n_both, n_all) of candidate pairs, counted on the full sets."""
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return stored(joined.mapInArrow(partial(_compare, width=width), "a bigint, b bigint, n_both bigint, n_all bigint"), "pairs")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc, n_shingles, component, kept) per document.

    Words are runs of anything but ASCII white space, A-Z lowered. A text with fewer words than
    ``width`` has one shingle; one without words, or null, has none and is linked with nothing. Equal ids count as one
    document: their sets' links meet. A null id is linked with nothing and kept. An empty table gives no rows.
    """
    texts = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    signed = stored(texts.mapInArrow(partial(_sign, width=width), _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc is not null")
    nodes = some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc").alias("node"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    centers = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    shared = stored(banded.join(centers.select("key", "a"), "key").distinct(), "buckets")
    # Only documents that share a bucket are read again.
    percent = round(100 * similarity)

    def fits(x: str, y: str) -> Column:
        """Whether sets can be similar by what their bitmaps differ in at least."""
        differ = F.abs(F.col(f"{x}.size") - F.col(f"{y}.size"))
        words = [F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITS // 64)]
        bits = reduce(operator.add, words)
        return (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size")) >= (100 + percent) * F.greatest(differ, bits)

    stars = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = _compared(stars, texts, width)
    linked = F.col("n_both") * 100 >= percent * F.col("n_all")
    done, links = first, first.where(linked)
    found = components(links)

    def labelled() -> DataFrame:
        """Members of the buckets that still hold several components."""
        own = F.coalesce("component", "node").alias("component")
        label = stored(shared.join(found, "node", "left").select("key", "a", "node", own), "labelled")
        several = label.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return label.join(several.select("key"), "key")

    label = labelled()
    members = label.select(F.col("node").alias("doc")).distinct()
    maps = texts.join(members, "doc", "left_semi").select("doc", "text").mapInArrow(partial(_map, width=width), "node bigint, size bigint, bits array<bigint>")
    maps = stored(maps, "bitmaps")

    # Buckets that still hold several components: some members of the largest one are compared with all others.
    for turn in range(ROUNDS):
        label = label if turn == 0 else labelled()
        picks = [F.max_by("node", F.xxhash64("node", F.lit(turn * PIVOTS + i))).alias(f"p{i}") for i in range(PIVOTS)]
        each = label.groupBy("key", "component").agg(F.count("*").alias("n"), *picks)
        top = each.groupBy("key").agg(
            F.count("*").alias("parts"), F.max(F.struct("n", "component", *(f"p{i}" for i in range(PIVOTS)))).alias("top")
        ).where("parts > 1")
        pivots = top.select("key", F.col("top.component").alias("chief"), F.array_distinct(F.array(*(f"top.p{i}" for i in range(PIVOTS)))).alias("p"))
        met = label.join(pivots, "key").where("component <> chief").select("node", F.explode("p").alias("a"))
        met = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        x, y = maps.alias("x"), maps.alias("y")
        met = met.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & fits("x", "y")).select("a", "b")
        more = _compared(met.distinct().join(done, ["a", "b"], "left_anti"), texts, width)
        done = done.union(more)
        if more.where(linked).isEmpty():
            break
        links = links.union(more.where(linked))
        found = components(links)

    # What is in different components of one bucket now is compared pair by pair, unless bitmaps or distances rule it out.
    label = labelled()
    far = first.select("a", F.col("b").alias("node"), (1 - F.col("n_both") / F.col("n_all")).alias("far"))
    rest = stored(label.where("node <> a").join(far, ["a", "node"]).join(maps, "node"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    reach = 1 - similarity + 1e-9
    met = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") < F.col("y.component"))
        & fits("x", "y")
        & (F.abs(F.col("x.far") - F.col("y.far")) <= reach),
    ).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    second = _compared(met.distinct().join(done, ["a", "b"], "left_anti"), texts, width)
    if not second.where(linked).isEmpty():
        found = components(links.union(second.where(linked)))

    named = nodes.select("k1", "k2", "node").join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    own = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return (
        signed.drop("bands").join(named, ["k1", "k2"], "left")
        .select("doc", "n_shingles", F.when(F.col("n_shingles") > 0, own).otherwise(F.col("doc")).alias("component"))
        .withColumn("kept", F.coalesce(F.col("doc") == F.col("component"), F.lit(True)))
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those of a group's other documents; columns as they are."""
    gone = near_duplicates(docs, id, text, width, similarity).where("not kept").select(F.col("doc").alias("_gone"))
    return docs.join(gone, docs[id].cast("bigint") == gone["_gone"], "left_anti")
