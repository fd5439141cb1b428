"""Periodic runs of words, from the branching tandem repeats of an enhanced suffix array.

A run is a stretch of words with a smallest period that no neighbouring word extends. Its last square, two periods
long, is a branching one: its halves are occurrences of one LCP interval whose depth is the period, and they lie
in different children of the interval. So for each LCP interval the suffixes of all children but the largest look up, in the inverse suffix
array, whether the suffix one depth further or one depth before belongs to the interval too. Each square found is rotated
to the left as long as words one period apart agree, which gives its run; squares of one run, and those of multiples of its
period, merge.

There are no tree nodes: intervals are bounds found by binary search on range minima of the LCP array, and all steps are
array operations over some documents at a time. Suffixes are sorted by doubling; the ranks of every round are kept, and tell
in one look whether two strings of a power of two words are equal, for LCPs and rotations alike. Documents have
disjoint alphabets, so no run crosses documents, and a document's result doesn't depend on its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPONENT, LEAST = 4, 6  # a run has this many periods and this many words at least
WORDS = 1 << 17  # words worked on at once; one longer document is worked on by itself
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_WORD = r"[^\x20\x09-\x0D]+"


def _sorted_suffixes(ids: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks by the first 1, 2, 4, ... words)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.append(True, ids[order[1:]] != ids[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, k = [rank.copy()], 1
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of suffixes not yet told from all others
    while len(open_):
        at = order[open_]
        ahead = at + k
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1).astype(np.int64)
        key = rank[at].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[open_], key = at[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        ranks.append(rank.copy())
        open_ = open_[~(new & np.append(new[1:], True))]
        k *= 2
    return order, rank, ranks


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b have in common, a and b differing."""
    n, a, b, total = len(ranks[0]), a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for t in reversed(range(len(ranks))):
        inside = (a < n) & (b < n)
        same = inside & (ranks[t][np.minimum(a, n - 1)] == ranks[t][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << t
        a, b, total = a + step, b + step, total + step
    return total


def _minima(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Sparse table: at t, the minimum of every 2**t consecutive values, up to ``longest``."""
    out, size = [x], 1
    while 2 * size <= min(longest, len(x)):
        out.append(np.minimum(out[-1][:-size], out[-1][size:]))
        size *= 2
    return out


def _extents(lcp: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place, in the suffix array, of the LCP interval that each boundary ``at`` belongs to."""
    depth, table = lcp[at], _minima(lcp, longest)
    left, right = at.copy(), at.copy()
    for t in reversed(range(len(table))):
        low = table[t]
        ahead = (right + (1 << t) <= len(lcp)) & (low[np.minimum(right, len(low) - 1)] >= depth)
        right += ahead.astype(np.int64) << t
        back = left - (1 << t)
        behind = (back >= 0) & (low[np.clip(back, 0, len(low) - 1)] >= depth)
        left -= behind.astype(np.int64) << t
    return left - 1, right - 1


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every stretch."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


def _squares(order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every branching square in an LCP interval of at least ``exponent`` suffixes."""
    n, at = len(order), np.flatnonzero(lcp[:-1] > 0)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    zero = np.flatnonzero(lcp == 0)
    left, right = _extents(lcp, at, int(np.diff(zero).max()))
    some = right - left + 1 >= exponent
    at, left, right = at[some], left[some], right[some]
    if not len(at):
        return none, none
    by = np.argsort(left * n + right, kind="stable")
    at, left, right = at[by], left[by], right[by]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    head = np.flatnonzero(new)
    # An interval of c boundaries has c + 1 children: one before each boundary, and one after the last.
    which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))) + 1)
    first = np.insert(at, head, left[head])
    last = np.append(first[1:] - 1, right[-1])
    tail = np.append(np.flatnonzero(which[1:] != which[:-1]), len(which) - 1)
    last[tail] = right[head]
    size = last - first + 1
    begin = np.append(0, tail[:-1] + 1)
    largest = np.repeat(np.maximum.reduceat(size, begin), np.diff(np.append(begin, len(size))))
    big = np.flatnonzero(size == largest)
    small = np.ones(len(size), bool)
    small[big[np.unique(which[big], return_index=True)[1]]] = False
    child = np.flatnonzero(small)
    row = np.repeat(child, size[child])
    place = order[_spread(first[child], size[child])]
    group = which[row]
    depth, lo, hi = lcp[at[head]][group], left[head][group], right[head][group]

    def hits(other: np.ndarray) -> np.ndarray:
        there = inverse[np.clip(other, 0, n - 1)]
        mine = (there >= first[row]) & (there <= last[row])
        return (other >= 0) & (other < n) & (there >= lo) & (there <= hi) & ~mine

    ahead, behind = hits(place + depth), hits(place - depth)
    start, period = np.append(place[ahead], (place - depth)[behind]), np.append(depth[ahead], depth[behind])
    both = np.unique(start * (n + 1) + period)
    return both // (n + 1), both % (n + 1)


def runs(ids: np.ndarray, end: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.

    ``ids`` are words as numbers, ``end`` the end of the document of each; no number occurs in two documents.
    """
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none
    order, inverse, ranks = _sorted_suffixes(ids, end)
    lcp = np.zeros(len(ids) + 1, np.int64)  # of the suffixes before and at a place
    near = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    lcp[near + 1] = _common(ranks, order[near], order[near + 1])
    place, period = _squares(order, inverse, lcp, exponent)
    start = place.copy()
    for t in reversed(range(len(ranks))):
        back = start - (1 << t)
        same = (back >= 0) & (ranks[t][np.maximum(back, 0)] == ranks[t][np.maximum(back, 0) + period])
        start -= same.astype(np.int64) << t
    length = place + 2 * period - start
    long = length >= np.maximum(least, exponent * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, anew in every document, and where the words of each document end."""
    ids, known = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        ids.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + known)
        known += len(own)
    return np.concatenate(ids), np.cumsum([len(w) for w in texts])


def _found(docs: list, texts: list[list[bytes]], exponent: int, least: int, collapse: bool) -> pa.RecordBatch:
    ids, ends = _numbered(texts)
    size = np.diff(np.append(0, ends))
    start, length, period = runs(ids, np.repeat(ends, size), exponent, least)
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone[:-1]) == 0
    cut = np.searchsorted(start, np.append(0, ends))
    own = np.searchsorted(ends, start, "right")
    first = ends - size
    struct = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[own], length, period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), struct)
    left = [b" ".join(compress(w, kept[a:b].tolist())) for w, a, b in zip(texts, first, ends, strict=True)] if collapse else [None] * len(docs)
    arrays = [pa.array(docs, pa.int64()), pa.array(size.astype(np.int64)), lists, pa.array(left, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "n_words", "runs", "collapsed"])


def _search(batches: Iterator[pa.RecordBatch], exponent: int, least: int, collapse: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, held = [], [], 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or b"").split()  # on bytes, at the six ASCII blanks only
            if texts and held + len(words) > WORDS:
                yield _found(docs, texts, exponent, least, collapse)
                docs, texts, held = [], [], 0
            docs.append(doc.as_py())
            texts.append(words)
            held += len(words)
        if texts:
            yield _found(docs, texts, exponent, least, collapse)


def find_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST, collapse: bool = True
) -> DataFrame:
    """(doc, n_words, runs, collapsed) per row of ``docs``, no row depending on another.

    ``runs`` are all runs of at least ``exponent`` (2 or more) periods and ``least`` words, as (start, length, period) in words
    from 0, by start and period. ``collapsed`` (with ``collapse``) is the text, in UTF-8, of the words that are in no run or in the
    first period of every run that has them, joined by a space. A null or blank text has no words, no runs, and is empty.
    Repeated rows and null ids are rows like others; an empty table gives none. Other columns are not looked at.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(id).cast("bigint"), F.col(text).cast("binary"))
    task = partial(_search, exponent=exponent, least=least, collapse=collapse)
    return rows.mapInArrow(task, f"doc bigint, n_words bigint, runs {RUNS}, collapsed binary")


def planted(id: Column, text: Column) -> Column:
    """The text, made periodic from some word on for about a tenth of the ids, as the checksum of the id says."""
    mark = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(mark / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        pieces = F.concat(F.array(F.slice(w, F.lit(1), a.cast("int"))), F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.slice(F.flatten(pieces), F.lit(1), n), " ")).otherwise("")

    # The one-element array binds the words to a name, so that they are cut once.
    words = F.array(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    return F.when((mark % 10 == 0) & text.isNotNull(), F.transform(words, periodic)[0]).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Per row the number of runs, the one of the greatest exponent, and checksums of all runs and of the collapsed text."""

    def before(a: Column, b: Column) -> Column:
        mine, other = a["length"] * b["period"], b["length"] * a["period"]
        rule = ((mine > other, mine < other), *((a[k] < b[k], a[k] > b[k]) for k in ("start", "period")))
        out = F.lit(0)
        for less, more in reversed(rule):
            out = F.when(less, -1).when(more, 1).otherwise(out)
        return out

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), "runs", "collapsed", lines.alias("lines")).select(
        "doc",
        "n_runs",
        *(F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
