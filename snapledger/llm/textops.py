"""Words of whole texts as 64-bit hashes, a chunk of documents at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21  # bytes of text worked on at once; one longer document is a chunk of its own

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
# Word bytes of the two word rules, after lowering A-Z. Bytes from 0x80 belong to non-ASCII characters.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same for the same seed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes padded by 8 zeros, offsets) of consecutive rows; null is empty."""
    flat = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1 + flat.offset)[flat.offset :]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(flat):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = np.zeros(offsets[hi] - offsets[lo] + 8, np.uint8)
        part[:-8] = data[offsets[lo] : offsets[hi]]
        yield lo, hi, part, offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """(lowered bytes, start and end of every word, words before each document's first)."""
    if lower:
        data = LOWER[data]
    n = len(data) - 8
    mask = rule[data[:n]]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    start = np.flatnonzero(mask & (~before | cut[:n]))
    end = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return data, start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; spans of up to 8 bytes and equal length never collide."""
    eight = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = mix(h ^ (eight[start] & _MASKS[np.minimum(length, 8)]))
    at, rest = np.flatnonzero(length > 8), 8
    while len(at):
        left = np.minimum(length[at] - rest, 8)
        h[at] = mix(h[at] ^ (eight[start[at] + rest] & _MASKS[left]))
        rest += 8
        at = at[length[at] > rest]
    return h


def runs(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i, c in enumerate(constants(k, seed)):
        out += h[i : len(h) - k + 1 + i] * c
    return mix(out)
