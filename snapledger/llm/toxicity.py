"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts without any label (U) train a linear classifier; label 0 is not
used but for the class prior. With prior p and logistic loss l, the risk is
``p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])``: the middle term estimates the risk on clean texts and
is never negative in truth; where the estimate falls under zero the step goes against it, so
that a flexible model cannot profit from overfitting. Features are presences of words and of their
beginnings of 4, 5 and 6 bytes, hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import ALNUM, chunks, hashes, words

BITS = 22
PREFIXES = (4, 5, 6)
MAX_POSITIVE = 6_000  # texts to fit on, at most; the bound of what reaches the driver
MAX_UNLABELLED = 12_000
MIN_PRESENT = 5
FEATURES = 20_000
MIN_GAIN = 5.0  # standard errors by which a feature's share in the two samples must differ
ROUNDS = 300
FOLDS = 5
TEXTS = 1000  # texts counted at once while fitting


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per chunk of rows: (row, feature) pairs, each once, and the number of rows."""
    for lo, hi, data, offsets in chunks(column):
        low, start, end, first = words(data, offsets, ALNUM)
        row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(first))
        found = [(row << BITS) | (hashes(low, start, end) >> np.uint64(64 - BITS)).astype(np.int64)]
        for k in PREFIXES:
            long = np.flatnonzero(end - start >= k)
            h = hashes(low, start[long], start[long] + k) * np.uint64(2 * k + 1)
            found.append((row[long] << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
        keys = np.unique(np.concatenate(found))
        yield keys >> BITS, keys & ((1 << BITS) - 1), hi - lo


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for row, feature, n in features(batch.column(1)):
            at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), lists], names=["y", "features"])
            done += n


def _score(batches: Iterator[pa.RecordBatch], weights, bias: float, name: str = "score") -> Iterator[pa.RecordBatch]:
    w = weights.value
    for batch in batches:
        scores = [
            1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[feature], n), -30, 30)))
            for row, feature, n in features(batch.column(batch.schema.get_field_index("_text")))
        ]
        scores = np.concatenate(scores) if scores else np.zeros(0)
        kept = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores)], names=[*kept, name])


def _parts(y: np.ndarray, lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, mark, feature) of some texts at a time, so that all of them together are never spread out."""
    for lo in range(0, len(lists), TEXTS):
        part = lists[lo : lo + TEXTS]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        yield row, y[lo : lo + TEXTS][row], np.concatenate(part)


def fit(y: np.ndarray, lists: list[np.ndarray], prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weight per hashed feature, bias) from confirmed (y = 1) and unlabelled (y = 0) texts."""
    size = 1 << BITS
    n_p, n_u = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    held_p, held_u = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for _, own, col in _parts(y, lists):
        held_p += np.bincount(col[own == 1], minlength=size)
        held_u += np.bincount(col[own != 1], minlength=size)
    some = np.flatnonzero(held_p + held_u >= MIN_PRESENT)
    p, u = (held_p[some] + 0.5) / (n_p + 1), (held_u[some] + 0.5) / (n_u + 1)
    gain = np.abs((p - u) / np.sqrt(u * (1 - u) / n_p + p * (1 - p) / n_p))
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = some[chosen[gain[chosen] >= MIN_GAIN]]
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for first, (row, _, col) in zip(range(0, len(lists), TEXTS), _parts(y, lists), strict=True):
        seen = place[col] >= 0
        kept.append((first + row[seen], place[col[seen]]))
    row, col = (np.concatenate(x) for x in zip(*kept, strict=True))
    positive = y == 1
    # Starting weights and Adam; the step goes up the clean risk's slope while that is negative.
    theta, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        g = bias + np.bincount(row, theta[col], len(y))
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        clean = np.logaddexp(0, g[~positive]).sum() / n_u - prior * np.logaddexp(0, g[positive]).sum() / n_p
        slope_clean = np.where(positive, -prior * s / n_p, s / n_u)
        slope = slope_clean + np.where(positive, -prior * (1 - s) / n_p, 0.0) if clean >= 0 else -slope_clean
        grad = np.append(np.bincount(col, slope[row], len(chosen)) + 1e-5 * theta, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        theta, bias = theta - step[:-1], bias - step[-1]
    weights = np.zeros(size, np.float64)
    weights[chosen] = theta
    return weights, float(bias)


def _bucket(id: str) -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic"):
    """(weights, bias) learnt from rows outside the held-out fold.

    At most MAX_POSITIVE confirmed and MAX_UNLABELLED other texts, the first in the order of a hash of their ids,
    are fitted; the prior comes from all labels outside the held-out fold. Labelled rows stand in
    where nothing is unlabelled. Without a confirmed text every score is the prior's.
    """
    marks = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).where(_bucket(id) != 0)
    marks = marks.groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_y"))
    n, n_toxic = marks.agg(F.count("*"), F.sum(F.when(F.col("_y") == 1, 1).otherwise(0))).first()
    prior = min(0.9, max(0.001, (n_toxic or 0) / n)) if n else 0.01
    if not n_toxic:
        return np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    order = F.xxhash64("_id"), F.col("_id")
    ids = docs.where(_bucket(id) != 0).select(F.col(id).alias("_id")).where("_id is not null")
    confirmed = marks.where("_y = 1").orderBy(*order).limit(MAX_POSITIVE).select("_id", F.lit(1).alias("y"))
    unlabelled = ids.join(labels.select(F.col(id).alias("_id")), "_id", "left_anti").orderBy(*order).limit(MAX_UNLABELLED)
    if unlabelled.isEmpty():
        unlabelled = marks.where("_y <> 1").orderBy(*order).limit(MAX_UNLABELLED).select("_id")
    sample = confirmed.union(unlabelled.select("_id", F.lit(0).alias("y")))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").select("y", "_text")
    got = rows.mapInArrow(_featurise, "y int, features array<int>").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    lists = [x.values.to_numpy()[x.offsets[i].as_py() : x.offsets[i + 1].as_py()] for x in got.column("features").chunks for i in range(len(x))]
    return fit(y, lists, prior)


def score(docs: DataFrame, model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``score``: the chance that the text is toxic.

    Whole texts, each where it is. A null or empty text has no features and so the score of the bias.
    A column named score is replaced.
    """
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.drop("score").withColumn("_text", F.col(text)).drop(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema.fields)
    return rows.mapInArrow(partial(_score, weights=shared, bias=bias), f"{schema}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", (_bucket("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under a half; columns as they are.

    The text passes through the scoring task beside its score, so that nothing is joined.
    """
    weights, bias = train(docs, labels, id, text)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.withColumn("_text", F.col(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    own = partial(_score, weights=shared, bias=bias, name="_toxic_score")
    return rows.mapInArrow(own, f"{schema}, _toxic_score double").where("_toxic_score < 0.5").select(*docs.columns)
