"""Benchmark decontamination over a distributed positional inverted index.

The index holds, per term and document, the term's positions in the corpus. Phrases and proximity matches are
found by intersecting offset-adjusted lists, rarest terms first: the postings of a window's rarest term give
candidate starts, those of its next rarest terms confirm them within the slop, and a last look at the text itself
slides over the adjusted positions of all the window's terms. A phrase is a match of spread 0. Only terms some window is anchored on are indexed by the query,
the terms rarest in the corpus, so that frequent words never leave their scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import stored
from .textops import ALNUM, chunks, hashes, words

WINDOW = 10
ANCHORS = 3
SLOP = 2  # words by which each term of a proximity match may stand off its place
MAX_TERMS = 2_000_000  # terms a task may hold (16 MB); beyond it they are joined instead
_POSTINGS = "term bigint, doc bigint, positions array<int>"
_NEAR = "array<struct<item:bigint,place:int,start:int,spread:int>>"
_WINDOWS = "item bigint, place int, n int, terms array<bigint>"


def _hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of rows: word hashes, and where each row's begin."""
    for _lo, _hi, data, offsets in chunks(column):
        low, start, end, first = words(data, offsets, ALNUM)
        yield hashes(low, start, end).astype(np.int64), first


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Windows of items: every ``width`` consecutive words; fewer are one window."""
    for batch in batches:
        done, out = 0, []
        for h, first in _hashed(batch.column(1)):
            for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                n = min(width, b - a)
                item = batch.column(0)[done + i].as_py()
                out += [(item, k, int(n), h[a + k : a + k + n].tolist()) for k in range(b - a - n + 1) if n]
            done += len(first) - 1
        names = ("item", "place", "n", "terms")
        types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))


def _count(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
    """(doc, n_words) per row, and (term, documents) partial counts in the same columns, marked by ``what``."""
    vocabulary = terms.value
    for batch in batches:
        done, total = 0, np.zeros(len(vocabulary), np.int64)
        for h, first in _hashed(batch.column(1)):
            n = len(first) - 1
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[at] == h
                row = np.repeat(np.arange(n), np.diff(first))[known]
                pairs = np.unique(row * len(vocabulary) + at[known])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            yield _row(np.zeros(n, np.int32), batch.column(0).slice(done, n), np.diff(first))
            done += n
        some = np.flatnonzero(total)
        yield _row(np.ones(len(some), np.int32), pa.array(vocabulary[some]), total[some])


def _row(what, key, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(what), key, pa.array(n.astype(np.int64))], names=["what", "key", "n"])


def _post(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
    vocabulary = None if terms is None else terms.value
    for batch in batches:
        done = 0
        for h, first in _hashed(batch.column(1)):
            n = len(first) - 1
            row = np.repeat(np.arange(n), np.diff(first))
            place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            if vocabulary is not None:
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                row, place, h = row[known], place[known], h[known]
            order = np.lexsort((place, h, row))
            row, place, h = row[order], place[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.append(np.flatnonzero(new), len(h)).astype(np.int32)
            docs = batch.column(0).slice(done, n).take(pa.array(row[new]))
            lists = pa.ListArray.from_arrays(at, pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), docs, lists], names=["term", "doc", "positions"])
            done += n


def _matches(slots: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, spread) of every match of a window; ``slots`` holds the sorted adjusted positions per word of it.

    A match is an interval of adjusted positions that holds one of every slot, no wider than 2 * ``slop``, and holds no
    smaller such interval. A start from which every word stands within ``slop`` of its place exists just if there is one.
    """
    ends = np.unique(np.concatenate(slots))
    low = ends.copy()
    for own in slots:  # the furthest start from which every slot is met up to each end
        at = np.searchsorted(own, ends, "right") - 1
        low = np.minimum(low, np.where(at >= 0, own[np.maximum(at, 0)], ends - 2 * slop - 1))
    met = ends - low <= 2 * slop
    low, ends = low[met], ends[met]
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    return low[new], (ends - low)[new]


def _confirm(batches: Iterator[pa.RecordBatch], slop: int) -> Iterator[pa.RecordBatch]:
    """Look for candidate windows in the text; (doc, n_hit, windows found whole, proximity matches)."""
    match = pa.struct([("window", pa.int64()), ("start", pa.int32()), ("spread", pa.int32())])
    for batch in batches:
        done, found, hit, near = 0, [], [], []
        for h, first in _hashed(batch.column(1)):
            for a, b in zip(first[:-1], first[1:], strict=True):
                own, mark, seen, matches = h[a:b], np.zeros(b - a + 1, np.int64), set(), []
                order = np.argsort(own, kind="stable")
                ordered = own[order]
                for c in batch.column(2)[done].as_py():
                    terms = np.array(c["terms"], np.int64)
                    lo, hi = np.searchsorted(ordered, terms, "left"), np.searchsorted(ordered, terms, "right")
                    if (lo == hi).any():
                        continue
                    for s, spread in zip(*_matches([order[x:y] - k for k, (x, y) in enumerate(zip(lo, hi, strict=True))], slop), strict=True):
                        matches.append({"window": c["window"], "start": int(s), "spread": int(spread)})
                        if not spread:
                            mark[s] += 1
                            mark[s + len(terms)] -= 1
                            seen.add(c["window"])
                hit.append(int((np.cumsum(mark[:-1]) > 0).sum()))
                found.append(sorted(seen))
                near.append(matches)
                done += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(near, pa.list_(match))],
            names=["doc", "n_hit", "windows", "near"],
        )


def windows(items: DataFrame, id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item, place, n, terms, window) of every window; ``window`` names its words, whatever the item."""
    cut = items.select(F.col(id).cast("bigint"), F.col(text)).mapInArrow(partial(_cut, width=width), _WINDOWS)
    return stored(cut.withColumn("window", F.xxhash64("terms")), "windows")


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """Stored postings (term, doc, positions) of whole texts; of the given ``terms`` only, if there are any.

    Terms are word hashes. A set of more than MAX_TERMS terms is joined to the full postings, not sent to tasks.
    """
    texts = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text))
    held = None if terms is None else _held(terms)
    full = texts.mapInArrow(partial(_post, terms=held), _POSTINGS)
    return stored(full if terms is None or held is not None else full.join(terms, "term", "left_semi"), "postings")


def _held(terms: DataFrame):
    """The sorted terms as a broadcast array, if they are few enough; else None."""
    if terms.limit(MAX_TERMS + 1).count() > MAX_TERMS:
        return None
    got = np.sort(terms.toArrow().column("term").to_numpy().astype(np.int64))
    return terms.sparkSession.sparkContext.broadcast(got)


def contaminated(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", width: int = WINDOW, slop: int = SLOP
) -> DataFrame:
    """(doc, n_words, n_hit, items array<bigint>, near array<struct<item, place, start, spread>>) per document.

    ``near`` has every proximity match of every window, phrases (of spread 0) included: the item and the window's place
    in it, the least of the words' positions less their offsets, and how far these differ, up to twice ``slop``. A word that
    a window repeats may be met by one occurrence within reach of both places. ``n_hit`` and ``items`` are of phrases alone.

    Words are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters. Null and empty texts have no
    words; an empty benchmark hits nothing. Ids are expected once: rows of a repeated id are each matched
    with the candidates of both. A null id has its words counted and no hits.
    """
    cut = windows(items, item, "text", width)
    terms = cut.select(F.explode("terms").alias("term")).distinct()
    texts = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    held = _held(terms)
    if held is None:
        words_of = stored(index(docs, id, text, terms), "all_terms")
        rare = words_of.groupBy("term").agg(F.count("*").alias("n"))
        empty = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64))
        counted = stored(texts.mapInArrow(partial(_count, terms=empty), "what int, key bigint, n bigint"), "counted")
    else:
        words_of = None
        counted = stored(texts.mapInArrow(partial(_count, terms=held), "what int, key bigint, n bigint"), "counted")
        rare = counted.where("what = 1").groupBy(F.col("key").alias("term")).agg(F.sum("n").alias("n"))

    unique = cut.dropDuplicates(["window"]).select("window", "terms")
    spread = unique.select("window", F.posexplode("terms").alias("offset", "term"))
    spread = spread.groupBy("window", "term").agg(F.min("offset").alias("offset")).join(rare, "term", "left")
    order = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "term")
    anchors = stored(spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ANCHORS), "anchors")
    # A window with a term that the corpus lacks occurs nowhere.
    lacking = anchors.where("n is null").select("window").distinct()
    anchors = anchors.join(lacking, "window", "left_anti").select("window", "term", "offset", "rank")
    postings = words_of if words_of is not None else index(docs, id, text, anchors.select("term").distinct())

    first = anchors.where("rank = 1").join(postings, "term").where("doc is not null")
    starts = first.select("window", "doc", F.explode("positions").alias("position"), "offset")
    starts = starts.select("window", "doc", (F.col("position") - F.col("offset")).alias("start")).where(F.col("start") >= -2 * slop)
    for rank in range(2, ANCHORS + 1):
        # Windows with fewer distinct terms have no anchor of this rank and pass.
        own = anchors.where(F.col("rank") == rank).select("window", "term", "offset")
        needed = starts.join(own, "window", "left")
        starts = needed.join(postings, ["term", "doc"], "left").where(
            F.col("term").isNull() | F.exists("positions", lambda p: F.abs(p - F.col("offset") - F.col("start")) <= 2 * slop)
        ).select("window", "doc", "start")
    candidates = starts.select("window", "doc").distinct().join(unique, "window")
    candidates = candidates.groupBy("doc").agg(F.collect_list(F.struct("window", "terms")).alias("found"))
    checked = texts.join(candidates, "doc").select("doc", "text", "found")
    schema = "doc bigint, n_hit bigint, windows array<bigint>, near array<struct<window:bigint,start:int,spread:int>>"
    hits = stored(checked.mapInArrow(partial(_confirm, slop=slop), schema).where(F.size("near") > 0), "hits")
    near = hits.select("doc", F.explode("near").alias("m")).select("doc", "m.window", "m.start", "m.spread")
    near = near.join(cut.select("window", "item", "place"), "window").distinct()
    near = near.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("item", "place", "start", "spread"))).alias("near"))
    named = hits.select("doc", F.explode("windows").alias("window")).join(cut.select("window", "item"), "window")
    named = named.groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return (
        counted.where("what = 0").select(F.col("key").alias("doc"), F.col("n").alias("n_words"))
        .join(hits.groupBy("doc").agg(F.max("n_hit").alias("n_hit")).join(named, "doc", "left").join(near, "doc", "left"), "doc", "left")
        .select("doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                F.coalesce("near", F.array().cast(_NEAR)).alias("near"))
    )


def _slid(batches: Iterator[pa.RecordBatch], slop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for window, doc, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start, spread = _matches([np.sort(np.array(x, np.int64)) for x in slots], slop)
            out += [(window, doc, int(a), int(b)) for a, b in zip(start, spread, strict=True)]
        types = {"window": pa.int64(), "doc": pa.int64(), "start": pa.int32(), "spread": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types.values())], names=list(types))


def proximity(postings: DataFrame, cut: DataFrame, slop: int) -> DataFrame:
    """(window, doc, start, spread) of every match in which each word of a window stands within ``slop`` of its place.

    ``postings`` of all the windows' terms, ``cut`` from ``windows``. The query finds the same over its smaller index.
    """
    unique = cut.dropDuplicates(["window"]).select("window", F.size("terms").alias("need"), F.posexplode("terms").alias("offset", "term"))
    at = unique.join(postings, "term").select("window", "doc", "need", F.transform("positions", lambda p: p - F.col("offset")).alias("own"))
    met = at.groupBy("window", "doc").agg(F.first("need").alias("need"), F.collect_list("own").alias("slots")).where(F.size("slots") == F.col("need"))
    return met.select("window", "doc", "slots").mapInArrow(partial(_slid, slop=slop), "window bigint, doc bigint, start int, spread int")


def digest(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("near", lambda m: F.concat_ws(":", *(m[k].cast("string") for k in ("item", "place", "start", "spread")))), ",").alias("near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that no window of an item occurs in; columns as they are."""
    gone = contaminated(docs, items, id).where("n_hit > 0").select(F.col("doc").alias("_gone"))
    return docs.join(gone, docs[id].cast("bigint") == gone["_gone"], "left_anti")
