"""Sampled segmentations without replacement, and decoding, over a SentencePiece vocabulary.

A text is a lattice: its nodes are characters, its edges the vocabulary's pieces, a piece of rank r having
log-probability -ALPHA * log(r + 1). Pieces hold a space only at their beginning, so words are lattices of their
own; each distinct word's is built once and keeps, per node, the chances of its edges given all that follows.

Gumbel top-k: give every segmentation its log-probability plus independent Gumbel noise, and the k largest are a
sample of k distinct ones. They are found without listing them, by best-first search over sets of
segmentations: the noise of a set's largest member is known when the set is, so a path is followed down by
drawing edges, and at every node the rest (all segmentations that leave the path there) is a set with an upper bound of
its own, drawn truncated at the path's. The next best is under the set of the largest bound. The bound left
after k gives each its inclusion score, 1 - exp(-exp(log p - bound)).

Draws are hashes of seed, row key, sample, word and step, so a row's result does not depend on its neighbours.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import mix

SPACE = "\u2581"
MARK = "\udc00"  # stands for that character where it is in a text itself; no text has a lone surrogate
ALPHA = 1.0
CACHE = 1 << 21  # edges of words' lattices, about 25 bytes each, that a task keeps; beyond it the words are forgotten
CHARACTERS = 1 << 19  # of texts worked on at once; one longer text is worked on by itself
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_SCHEMA = "sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids array<int>"


_ALL = (1 << 64) - 1
_SEED, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x9E3779B97F4A7C15)


def _spelling(piece: str) -> int:
    """Hash of a string's characters, as ``Vocabulary.edges`` makes it."""
    h = int(_SEED)
    for ch in piece:
        h = ((h ^ ord(ch)) * int(_PRIME)) & 0xFFFFFFFFFFFFFFFF
    return h


class Spellings:
    """Pieces and all their beginnings by hash, at a direct address; the few whose address is taken are in a further table."""

    BITS = 19

    def __init__(self, edge: dict[str, tuple[int, float]]):
        known: dict[str, tuple[int, float]] = {p[:n]: (-1, 0.0) for p in edge for n in range(1, len(p) + 1)} | edge
        self.hash = np.array([_spelling(p) for p in known], np.uint64)
        self.piece, self.cost = (np.array(x, t) for x, t in zip(zip(*known.values(), strict=True), (np.int32, np.float64), strict=True))
        if len(np.unique(self.hash)) < len(known):
            raise ValueError("two spellings of the vocabulary share a hash")
        self.tables, left = [], np.arange(len(known))
        while len(left):
            slot = self._slot(self.hash[left], len(self.tables))
            _, at = np.unique(slot, return_index=True)
            table = np.zeros(1 << self.BITS, np.int32)
            table[slot[at]] = left[at]
            self.tables.append(table)
            left = np.delete(left, at)

    def _slot(self, h: np.ndarray, level: int) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS - 7 * level)) & np.uint64((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are of a known spelling, the number of each of these)."""
        place = self.tables[0][self._slot(h, 0)]
        for level in range(1, len(self.tables)):
            other = np.flatnonzero(self.hash[place] != h)
            place[other] = self.tables[level][self._slot(h[other], level)]
        hit = np.flatnonzero(self.hash[place] == h)
        return hit, place[hit]


def _from_the_end(source: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """The edges of all last characters of words, of all last but one, and so on."""
    far = left[source]
    by_left = np.argsort(far.astype(np.uint16) if len(left) and left.max() < 1 << 16 else far, kind="stable")
    cuts = np.searchsorted(far[by_left], np.unique(left))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(source)), strict=True):
        yield by_left[lo:hi]


class Vocabulary:
    """Pieces of a model file, with the lattices of the words met lately.

    A node is a character of a word. Its edges are the pieces that begin there, the longest first: ``within`` are their chances
    summed up, ``step`` the characters they take, ``last`` whether they end the word, ``id`` the piece and ``logp`` the log-chance.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        cost = {i: -ALPHA * math.log(r + 2) for r, i in enumerate(plain)}
        edge = {self.pieces[i]: (i, cost[i]) for i in plain if SPACE not in self.pieces[i].lstrip(SPACE)}
        self.longest = max(map(len, edge))
        if self.longest > 255:
            raise ValueError("a piece of more than 255 characters")
        self.spellings = Spellings(edge)
        self.byte_cost = -ALPHA * math.log(len(plain) + 2)
        spelt = {i: bytes([b]) for b, i in self.bytes.items()}
        self._raw = [spelt.get(i, piece.replace(SPACE, " ").encode()) for i, piece in enumerate(self.pieces)]
        self._spelt = pa.array(self._raw, pa.large_binary())
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self._room = [np.zeros(CACHE, t) for t in (np.float64, np.uint8, bool, np.int32, np.float64)]
        self._first = np.zeros(CACHE // 2, np.int32)
        self.special: list[list[int]] = []
        self.states = self._edges = 0
        self._view()

    def _view(self) -> None:
        self.within, self.step, self.last, self.id, self.logp = (a[: self._edges] for a in self._room)
        self.first = self._first[: self.states + 1]

    def edges(self, words: list[str], special: list[list[int]] | None = None) -> tuple[np.ndarray, ...]:
        """(source, characters, piece, log-probability) of all pieces in words, by source, the longest first; sources number the characters.

        A character without a piece is one edge, spelt in bytes, and has a negative number for a piece; ``special``, or that of the lattices, gets its bytes.
        """
        special = self.special if special is None else special
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
        found, at, h = [], np.arange(len(codes)), np.full(len(codes), _SEED)
        single = np.zeros(len(codes), bool)
        for n in range(1, self.longest + 1):
            if n > 1:
                on = left[at] >= n
                at, h = at[on], h[on]
            if not len(at):
                break
            h = (h ^ codes[at + n - 1]) * _PRIME
            # Only beginnings of pieces are read on from.
            hit, place = self.spellings.find(h)
            at, h = at[hit], h[hit]
            piece = self.spellings.piece[place]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], np.full(len(whole), n, np.int32), piece[whole], self.spellings.cost[place[whole]]))
            if n == 1:
                single[at[whole]] = True
        for i in np.flatnonzero(~single):
            raw = (SPACE if chr(codes[i]) == MARK else chr(codes[i])).encode()
            special.append([self.bytes[b] for b in raw])
            found.append((np.array([i]), np.array([1], np.int32), np.array([-len(special)], np.int32), np.array([self.byte_cost * len(raw)])))
        source, n, piece, cost = (np.concatenate(x) for x in zip(*reversed(found), strict=True))
        order = np.argsort(source, kind="stable")
        return source[order], n[order], piece[order], cost[order], left

    def add(self, words: list[str]) -> None:
        """Backward sums from the words' ends, then each node's edges by their chances."""
        source, n, piece, cost, left = self.edges(words)
        last = left[source] == n
        beta, score = np.zeros(len(left) + 1), np.zeros(len(source))
        for e in _from_the_end(source, left):
            src = source[e]
            own = cost[e] + np.where(last[e], 0.0, beta[src + n[e]])
            score[e] = own
            head = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
            top = np.maximum.reduceat(own, head)
            spread = np.repeat(top, np.diff(np.append(head, len(e))))
            beta[src[head]] = top + np.log(np.add.reduceat(np.exp(own - spread), head))
        logp = np.minimum(0.0, score - beta[source])
        head = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        tail = np.append(head[1:], len(source)) - 1
        # Summed up node by node, so that a word's chances do not depend on the words it came with.
        within, at, stop = np.exp(logp), head + 1, tail
        while len(at):
            on = np.flatnonzero(at <= stop)
            at, stop = at[on], stop[on]
            within[at] += within[at - 1]
            at = at + 1
        within = np.minimum(within, 1.0)
        within[tail] = 1.0
        end, states = self._edges + len(source), self.states + len(left)
        for k, new in enumerate((within, n, last, piece, logp)):
            if len(self._room[k]) < end:
                self._room[k] = np.concatenate([self._room[k][: self._edges], np.zeros(end - self._edges, self._room[k].dtype)])
            self._room[k][self._edges : end] = new
        if len(self._first) < states + 1:
            self._first = np.concatenate([self._first[: self.states], np.zeros(states + 1 - self.states, np.int32)])
        self._first[self.states : states] = self._edges + head
        self._first[states] = end
        begin = self.states + np.cumsum([0, *(len(w) for w in words)])
        self.known.update(zip(words, begin[:-1].tolist(), strict=True))
        self.states, self._edges = states, end
        self._view()

    def look_up(self, words: list[str]) -> np.ndarray:
        """The first nodes of distinct words."""
        new = [w for w in words if w not in self.known]
        if new:
            self.add(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def best(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The likeliest pieces of each word, the longest first among equals, and the sums of their log-probabilities."""
        special: list[list[int]] = []  # not that of the lattices kept, which number theirs
        source, n, piece, cost, left = self.edges(words, special)
        reach, choice = np.zeros(len(left) + 1), np.zeros(len(left), np.int64)
        for e in _from_the_end(source, left):
            src = source[e]
            own = cost[e] + np.where(left[src] == n[e], 0.0, reach[src + n[e]])
            head = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
            top = np.maximum.reduceat(own, head)
            hit = np.flatnonzero(own == np.repeat(top, np.diff(np.append(head, len(e)))))
            first = hit[np.append(True, src[hit[1:]] != src[hit[:-1]])]
            reach[src[head]], choice[src[first]] = top, e[first]
        begin = np.cumsum([0, *map(len, words)])[:-1]
        word, at, steps = np.arange(len(words)), begin, []
        while len(word):
            e = choice[at]
            steps.append((word, piece[e]))
            on = np.flatnonzero(left[at] > n[e])
            word, at = word[on], at[on] + n[e[on]]
        word, ids = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(word, kind="stable")
        out, cuts = self._as_ids(ids[order], special, np.append(0, np.cumsum(np.bincount(word, minlength=len(words)))))
        return [out[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], reach[begin]

    def spelt(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The pieces of paths of edges."""
        ids, cuts = self.id[np.concatenate([np.zeros(0, np.int64), *paths])], np.cumsum([0, *map(len, paths)])
        out, cuts = self._as_ids(ids, self.special, cuts)
        return [out[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def _as_ids(self, ids: np.ndarray, special: list[list[int]], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, with characters that have none spelt in bytes, and where the cuts between them are then."""
        low = np.flatnonzero(ids < 0)
        if not len(low):
            return ids, cuts
        parts = [special[-i - 1] for i in ids[low].tolist()]
        size = np.ones(len(ids), np.int64)
        size[low] = [len(x) for x in parts]
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = np.fromiter(chain.from_iterable(parts), np.int32)
        return out, np.append(0, np.cumsum(size))[cuts]

    def decodes(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The texts of segmentations that stand one after another in ids."""
        found = self._spelt.take(pa.array(ids))
        at = np.frombuffer(found.buffers()[1], np.int64)[cuts].tolist()
        raw = memoryview(found.buffers()[2] or b"")
        return [str(raw[a + 1 : b], "utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; byte pieces are put together again."""
        return b"".join(map(self._raw.__getitem__, ids))[1:].decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def words_of(text: str) -> list[str]:
    """Runs of spaces with what follows them, a space put before the text. A mark in the text itself is no space."""
    marked = (" " + text).replace(SPACE, MARK) if SPACE in text else " " + text
    if "  " not in marked:  # so each word has one space before it
        return marked.replace(" ", " " + SPACE).split(" ")[1:]
    return _WORD.findall(marked.replace(" ", SPACE))


def _nodes(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the first nodes of all. Most texts are cut and their words numbered without an object a word."""
    even = np.array([not (SPACE in t or "  " in t or t.startswith(" ")) for t in texts], bool)  # one space before each word, and no mark
    split = pc.split_pattern(pa.array([t for t, e in zip(texts, even, strict=True) if e], pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    odd = [words_of(t) for t, e in zip(texts, even, strict=True) if not e]
    n = np.zeros(len(texts), np.int64)
    n[even], n[~even] = pc.list_value_length(split).to_numpy(), [len(ws) for ws in odd]
    distinct = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
    distinct = distinct.to_numpy(zero_copy_only=False).tolist()
    nodes = v.look_up([*distinct, *chain.from_iterable(odd)])
    base, own = np.empty(int(n.sum()), np.int64), np.repeat(even, n)
    base[own], base[~own] = nodes[coded.indices.to_numpy(zero_copy_only=False)], nodes[len(distinct) :]
    return n, base


def _mixed(x: np.ndarray, part) -> np.ndarray:
    """Keys made of keys and of numbers."""
    return mix(x ^ (np.atleast_1d(part).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))


def _drawn(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Draws in (0, 1) that are functions of a key and of numbers."""
    x = np.asarray(key)
    for p in parts:
        x = _mixed(x, p)
    return _drawn(x)


def _one_uniform(key: int, *parts: int) -> float:
    """The same for a single key."""
    for p in parts:
        key ^= (p * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _ALL
        key ^= key >> 30
        key = key * 0xBF58476D1CE4E5B9 & _ALL
        key ^= key >> 27
        key = key * 0x94D049BB133111EB & _ALL
        key ^= key >> 31
    return ((key >> 11) + 0.5) / (1 << 53)


def _walk(v: Vocabulary, key, sample: int, doc, word, state) -> tuple[np.ndarray, ...]:
    """Follow every word from its state to its end; (doc, word, edge, state) in path order."""
    out, step = [], 0
    own = _mixed(_mixed(key, sample)[doc], word) if len(state) else None
    while len(state):
        u = _drawn(_mixed(own, step))
        edge = v.first[state].astype(np.int64)
        late = np.flatnonzero(v.within[edge] < u)
        while len(late):
            edge[late] += 1
            late = late[v.within[edge[late]] < u[late]]
        out.append((doc, word, edge, state))
        on = np.flatnonzero(~v.last[edge])
        state = state[on] + v.step[edge[on]]
        doc, word, own, step = doc[on], word[on], own[on], step + 1
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    d, w, e, s = (np.concatenate(x) for x in zip(*out, strict=True))
    # Steps of a word stay in order, as the sort is stable.
    order = np.argsort(d * (w.max() + 1) + w, kind="stable")
    return d[order], w[order], e[order], s[order]


def _bounds(v: Vocabulary, key, sample: int, value, doc, word, edge, before, at) -> np.ndarray:
    """Bounds of the sets that leave a path at each of its nodes."""
    first = np.searchsorted(doc, np.arange(len(value)))
    lp = v.logp[edge]
    total = np.cumsum(lp)
    prefix = total - lp - np.repeat(np.append(0.0, total)[first], np.diff(np.append(first, len(doc)))) + before[doc]
    with np.errstate(divide="ignore"):
        mass = prefix + np.log(np.maximum(0.0, -np.expm1(lp)))
    noise = -np.log(_drawn(_mixed(_mixed(_mixed(key, 1000 + sample)[doc], word), at)))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(mass == -np.inf, -np.inf, mass - np.log(np.exp(np.minimum(mass - value[doc], 700)) + noise))


def sample(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple]]:
    """Per text, up to k of (log-probability, perturbed value, log of the inclusion score, ids), the largest first."""
    if v._edges > CACHE:
        v.reset()
    n, base = _nodes(v, texts)
    start = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(texts)), n)
    word = np.arange(len(base)) - start[:-1][doc]
    value = -np.log(-np.log(_uniform(keys, 0)))  # the noise of the best of all, whose log-probability is 0
    alive = np.ones(len(texts), bool)
    leaves: list[list[dict]] = [[] for _ in texts]
    todo, prefix = (doc, word, base), [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in texts]
    before = np.zeros(len(texts))
    for r in range(k):
        d, w, e, s = _walk(v, keys, r, *todo)
        at = np.arange(len(d))
        bound = _bounds(v, keys, r, value, d, w, e, before, at - np.searchsorted(d, np.arange(len(texts)))[d])
        cut = np.searchsorted(d, np.arange(len(texts) + 1))
        for i in np.flatnonzero(alive):
            a, b = cut[i], cut[i + 1]
            leaves[i].append(
                {"edges": np.concatenate([prefix[i][0], e[a:b]]), "words": np.concatenate([prefix[i][1], w[a:b]]), "from": len(prefix[i][0]),
                 "bound": bound[a:b].copy(), "most": float(bound[a:b].max(initial=-np.inf)), "states": s[a:b], "logp": before[i] + float(v.logp[e[a:b]].sum()), "value": value[i], "out": {}}
            )
        parts = []
        for i in np.flatnonzero(alive):
            best = max(leaves[i], key=lambda leaf: leaf["most"])
            if not best["most"] > -np.inf:
                alive[i] = False
                continue
            if r == k - 1:
                continue
            parts.append(_branch(v, keys, i, r, best, start, base, before, value, prefix))
        todo = tuple(np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in range(3))
    spelt, out = iter(v.spelt([x["edges"] for own in leaves for x in own])), []
    for own in leaves:
        left = max((leaf["most"] for leaf in own), default=-np.inf)
        out.append([(x["logp"], x["value"], _log_inclusion(x["logp"] - left), next(spelt)) for x in own])
    return out


def _log_inclusion(above: float) -> float:
    """Log of 1 - exp(-exp(above)), also where that underflows."""
    return above if above < -30 else math.log(-math.expm1(-math.exp(min(700.0, above))))


def _branch(v, keys, i, r, leaf, start, base, before, value, prefix) -> tuple:
    """Take the set of the largest bound: draw its edge, bound what remains of it, and name the words still to walk."""
    j = int(np.argmax(leaf["bound"]))
    top, state, place = leaf["bound"][j], leaf["states"][j], leaf["from"] + j
    gone = leaf["out"].setdefault(j, [int(leaf["edges"][place])])
    lo, hi = v.first[state], v.first[state + 1]
    free = np.array([x for x in range(lo, hi) if x not in gone])
    p = np.exp(v.logp[free])
    key = int(keys[i])
    u = _one_uniform(key, 2000 + r, place, len(gone))
    edge = int(free[min(np.searchsorted(np.cumsum(p), u * p.sum()), len(free) - 1)])
    gone.append(edge)
    ahead = float(v.logp[leaf["edges"][:place]].sum())
    rest = p.sum() - math.exp(v.logp[edge])
    if len(free) > 1 and rest > 0:
        mass = ahead + math.log(rest)
        noise = -math.log(_one_uniform(key, 3000 + r, place, len(gone)))
        leaf["bound"][j] = mass - math.log(math.exp(min(700, mass - top)) + noise)
    else:
        leaf["bound"][j] = -np.inf
    leaf["most"] = float(leaf["bound"].max())
    w = int(leaf["words"][place])
    prefix[i] = (np.append(leaf["edges"][:place], edge), np.append(leaf["words"][:place], w))
    before[i], value[i] = ahead + v.logp[edge], top
    later = np.arange(start[i] + w + 1, start[i + 1])
    words, states = later - start[i], base[later]
    if not v.last[edge]:
        words, states = np.append(w, words), np.append(state + v.step[edge], states)
    return np.full(len(words), i), words, states


def _segment(batches: Iterator[pa.RecordBatch], path: str, k: int, seed: int, check: bool) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHARACTERS, "right")))
            piece, lo = batch.slice(lo, hi - lo), hi
            ids, texts = piece.column(0).to_pylist(), [t or "" for t in piece.column(1).to_pylist()]
            keys = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest(), "little") for i in ids], np.uint64)
            rows = []
            for i, text, found in zip(ids, texts, sample(v, texts, keys, k), strict=True):
                for nth, (logp, value, score, pieces) in enumerate(found):
                    rows.append((i, nth, len(pieces), logp, value, score, pieces, text))
            own, cuts = np.concatenate([r[6] for r in rows]), np.cumsum([0, *(r[2] for r in rows)])
            back = [a == r[7] for a, r in zip(v.decodes(own, cuts), rows, strict=True)] if check else [None] * len(rows)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own, pa.int32()))
            types = {"doc": pa.int64(), "sample": pa.int32(), "n_pieces": pa.int32(), "log_prob": pa.float64(), "perturbed": pa.float64(),
                     "log_inclusion": pa.float64()}
            columns = [pa.array([r[x] for r in rows], t) for x, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(back, pa.bool_())], names=[*types, "ids", "decoded"])


def segmentations(
    docs: DataFrame, path: str, k: int = 2, seed: int = 0, id: str = "doc_id", text: str = "text", check: bool = False
) -> DataFrame:
    """Up to ``k`` rows per document: (doc, sample, n_pieces, log_prob, perturbed, log_inclusion, ids, decoded).

    Samples of a document are distinct, the most perturbed first. A null or empty text is a lone space mark, which has
    one segmentation. Rows of equal ids draw alike. ``decoded``, with ``check``, says whether the ids give back the text.
    """
    rows = docs.select(F.col(id).cast("bigint"), F.col(text))
    return rows.mapInArrow(partial(_segment, path=path, k=k, seed=seed, check=check), f"doc bigint, {_SCHEMA}, decoded boolean")


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHARACTERS, "right")))
            piece, lo = batch.slice(lo, hi - lo), hi
            split = [words_of(t or "") for t in piece.column(1).to_pylist()]
            words = list(dict.fromkeys(w for ws in split for w in ws))
            ids, logp = v.best(words)
            place = {w: i for i, w in enumerate(words)}
            at = [[place[w] for w in ws] for ws in split]
            lists = [np.concatenate([ids[i] for i in own]) for own in at]
            total = [float(sum(logp[i] for i in own)) for own in at]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([len(x) for x in lists], pa.int32()), pa.array(total), pa.array(lists, pa.list_(pa.int32()))],
                names=["doc", "n_pieces", "log_prob", "ids"],
            )


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_pieces, log_prob, ids) per row: the likeliest segmentation of its text, nothing drawn.

    A null or empty text is a lone space mark. Repeated rows and null ids are rows like others; an empty table gives none.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text))
    return rows.mapInArrow(partial(_encode, path=path), "doc bigint, n_pieces int, log_prob double, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        texts = [None if ids is None else v.decode(ids) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])


def decode(rows: DataFrame, path: str, id: str = "doc", ids: str = "ids") -> DataFrame:
    """(doc, text) per row of piece ids, the other way round; a null list gives a null text."""
    return rows.select(F.col(id).cast("bigint").alias("doc"), F.col(ids)).mapInArrow(partial(_decode, path=path), "doc bigint, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])


def digest(found: DataFrame) -> DataFrame:
    """The samples with a checksum in place of their ids."""
    schema = "doc bigint, sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, decoded boolean, ids_crc32 bigint"
    return found.mapInArrow(_digest, schema).withColumnRenamed("doc", "doc_id")
