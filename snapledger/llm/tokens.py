"""Token-id files: static range asymmetric numeral coding in interleaved blocks.

A file holds whole documents in order. Its tokens share one frequency table (scaled to 2^SCALE) and
are cut into blocks that decode on their own: ``LANES`` coder states are interleaved, so that a
step codes one token in every lane at once. The file's index gives each block's first token, place, length
and checksum, which are the checkpoints of a parallel or partial read.

    file   := magic, u64 length of index, index (zlib JSON), tables (zlib), blocks
    block  := LANES final states (u64), then 32-bit words in the decoder's order
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import new_folder, stored

MAGIC = b"SNAPTOK1"
SCALE = 20
LANES = 2048
BLOCK = 1 << 18
FILE_TOKENS = 1 << 22
END = 0
_LOW = np.uint64(1 << 31)
_RANGES = "part int, path string, first_in_part bigint, first_doc bigint, n_docs bigint, first_token bigint, n_tokens bigint"
RANGE_TOKENS = 1 << 20  # tokens that are read back in one go
CHUNK = 1 << 23  # bytes of text whose words are looked up at once


# --- coder -----------------------------------------------------------------------------------


def frequencies(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols present, their frequencies, which add up to 2^SCALE and are at least 1)."""
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    if not len(symbols):
        return symbols, symbols
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError(f"more than {total} distinct tokens in one file")
    exact = counts[symbols] * ((total - len(symbols)) / counts.sum())
    freq = exact.astype(np.int64) + 1
    rest = total - int(freq.sum())
    freq[np.argsort(-(exact % 1), kind="stable")[:rest]] += 1
    return symbols, freq


def encode_block(places: np.ndarray, freq: np.ndarray) -> bytes:
    """One block; ``places`` are indices into the table."""
    f64 = freq.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    x = np.full(LANES, _LOW, np.uint64)
    out = []
    for at in range((len(places) - 1) // LANES * LANES, -1, -LANES):
        s = places[at : at + LANES]
        f, own = f64[s], x[: len(s)]
        full = own >= f << np.uint64(63 - SCALE)
        out.append((own[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        own = np.where(full, own >> np.uint64(32), own)
        whole = own // f
        x[: len(s)] = (whole << np.uint64(SCALE)) + (own - whole * f) + start[s]
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(out))


def decode_block(data: bytes, n: int, freq: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """n indices into the table; ``slots``: the index that owns each of the 2^SCALE slots."""
    f64 = freq.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    x = np.frombuffer(data, "<u8", LANES).copy()
    words, read = np.frombuffer(data, "<u4", offset=8 * LANES).astype(np.uint64), 0
    out = np.empty(n, np.int64)
    mask = np.uint64((1 << SCALE) - 1)
    for at in range(0, n, LANES):
        own = x[: min(LANES, n - at)]
        slot = own & mask
        s = slots[slot]
        out[at : at + LANES] = s
        own = f64[s] * (own >> np.uint64(SCALE)) + slot - start[s]
        low = np.flatnonzero(own < _LOW)
        own[low] = (own[low] << np.uint64(32)) | words[read : read + len(low)]
        read += len(low)
        x[: len(own)] = own
    return out


def pack(ids: list, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A file of documents ``ids`` (null allowed) with ``lengths`` of the ``tokens``."""
    symbols, freq = frequencies(tokens)
    table = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
    table[symbols] = np.arange(len(symbols))
    places = table[tokens]
    blocks = [encode_block(places[i : i + BLOCK], freq) for i in range(0, len(tokens), BLOCK)]
    tables = [zlib.compress(np.asarray(t, "<i8").tobytes(), 1) for t in (symbols, freq, [0 if i is None else i for i in ids], lengths)]
    sizes = [len(b) for b in blocks]
    index = {
        "n": len(tokens), "block": BLOCK, "tables": [len(t) for t in tables], "nulls": [k for k, i in enumerate(ids) if i is None],
        "tables_crc": zlib.crc32(b"".join(tables)), "blocks": [[s, zlib.crc32(b)] for s, b in zip(sizes, blocks, strict=True)],
    }
    head = zlib.compress(json.dumps(index).encode())
    return b"".join([MAGIC, struct.pack("<QI", len(head), zlib.crc32(head)), head, *tables, *blocks])


class TokenFile:
    """A packed file; ``tokens(first, last)`` decodes only the blocks that it needs."""

    def __init__(self, data: bytes | pa.NativeFile):
        source = pa.BufferReader(data) if isinstance(data, bytes) else data
        begin = source.read_at(20, 0)
        size, crc = struct.unpack_from("<QI", begin, 8) if len(begin) == 20 else (0, 0)
        head = source.read_at(size, 20)
        if begin[:8] != MAGIC or zlib.crc32(head) != crc:
            raise ValueError("not a token file, or a broken one")
        self._index = json.loads(zlib.decompress(head))
        at, tables = 20 + size, []
        raw = source.read_at(sum(self._index["tables"]), at)
        if zlib.crc32(raw) != self._index["tables_crc"]:
            raise ValueError("broken tables")
        for n in self._index["tables"]:
            tables.append(np.frombuffer(zlib.decompress(raw[:n]), "<i8"))
            at, raw = at + n, raw[n:]
        self._symbols, self._freq, ids, self.lengths = tables
        nulls = set(self._index["nulls"])
        self.ids = [None if k in nulls else int(i) for k, i in enumerate(ids)]
        self._slots = np.repeat(np.arange(len(self._freq)), self._freq)
        self._source, self._at = source, at
        self.n = self._index["n"]

    def tokens(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n if last is None else last
        block, at, out = self._index["block"], self._at, []
        for k, (size, crc) in enumerate(self._index["blocks"]):
            lo, hi = k * block, min(self.n, (k + 1) * block)
            if lo < last and hi > first:
                data = self._source.read_at(size, at)
                if zlib.crc32(data) != crc:
                    raise ValueError(f"block {k} is broken")
                part = self._symbols[decode_block(data, hi - lo, self._freq, self._slots)]
                out.append(part[max(0, first - lo) : last - lo])
            at += size
        return np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.uint32)


# --- tokenizer -------------------------------------------------------------------------------

# White space, as Python has it, before a space.
_BLANKS = "[\t-\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
# Letters that are letters in every version of Unicode: Latin, Cyrillic, kana, Han, Hangul.
LETTERS = ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x400, 0x481), (0x48A, 0x513), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
# Words of these and of all that ASCII prints but the apostrophe, which begins pieces of its own.
_EVEN = "\\A[!-&(-~" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in LETTERS) + "]+\\z"
_KIND = re.compile("\u0120?([A-Za-z]+|[0-9]+|[!-/:-@[-`{-~]+)")
_tokenizers: dict = {}


class _Words:
    """A byte-level BPE tokenizer that encodes every distinct word of some texts once.

    Its pre-tokenizer always cuts before a space that follows no white space, and no other piece of a word begins with a space.
    Texts with only such spaces are cut there, and their distinct words are encoded joined by spaces in long strings, whose ids
    are cut again at the pieces that begin with a space. Other texts are encoded as they are.

    Most time goes into the pre-tokenizer's pattern. In words of ``_EVEN`` it cuts only where letters, digits and other signs meet. Where no
    piece of the vocabulary has two of these kinds, no merge crosses such a cut, so these words are encoded without the pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        pieces = self._tokenizer.get_vocab(with_added_tokens=True)
        # Byte-level vocabularies spell a space with this letter.
        self._spaced = np.zeros(max(pieces.values()) + 1, bool)
        self._spaced[[i for piece, i in pieces.items() if piece.startswith("\u0120")]] = True
        self._uncut = None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if told["normalizer"] is None and plain.items() <= (told["pre_tokenizer"] or {}).items() and _of_one_kind(told["model"]["vocab"]):
            self._uncut = Tokenizer.from_file(path)
            self._uncut.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: pa.Array, encoder) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words, each after a space; how many each has)."""
        cuts = np.append(np.arange(0, len(words), 1000), len(words))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar(" ", pa.large_string())).to_pylist() if len(words) else []
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for text, lo, hi in zip(texts, cuts, cuts[1:], strict=False):
            own = np.array(encoder.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.uint32)
            begin = np.flatnonzero(self._spaced[own])
            if len(begin) != hi - lo or begin[0]:
                raise ValueError("the tokenizer does not cut at spaces")
            ids.append(own)
            sizes.append(np.diff(np.append(begin, len(own))))
        return np.concatenate(ids), np.concatenate(sizes)

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, each after a space: (all ids, how many of them each list has, the list of each word)."""
        even = pc.match_substring_regex(words, _EVEN).to_numpy(zero_copy_only=False) & (self._uncut is not None)
        other = np.flatnonzero(~even)
        # One that ends in white space would change what the pre-tokenizer does with the next.
        alone = np.array([not w or w[-1].isspace() for w in words.take(pa.array(other)).to_pylist()], bool)
        groups = [np.flatnonzero(even), other[~alone], other[alone]]
        parts = [self._joined(words.take(pa.array(g)), e) for g, e in zip(groups, (self._uncut, self._tokenizer), strict=False)]
        single = self._encode([" " + w for w in words.take(pa.array(groups[2])).to_pylist()])
        place = np.empty(len(words), np.int64)
        place[np.concatenate(groups)] = np.arange(len(words))
        ids = np.concatenate([*(i for i, _ in parts), *single])
        return ids, np.concatenate([*(n for _, n in parts), np.fromiter(map(len, single), np.int64, len(single))]), place

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with an end; how many each has). A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _BLANKS)
        some, n = whole.to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
        split = pc.split_pattern(texts.filter(pc.invert(whole)), " ")
        words, n[~some] = split.flatten(), pc.list_value_length(split).to_numpy()
        # The first word of a text has no space before it.
        first = (np.cumsum(n) - n)[~some]
        heads = np.empty(len(texts), object)
        heads[some], heads[~some] = texts.filter(whole).to_pylist(), words.take(pa.array(first)).to_pylist()
        heads = self._encode(heads.tolist())
        later = np.ones(len(words), bool)
        later[first] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        pool, size, place = self._ids_of(coded.dictionary)
        # Lists of ids in order: per text its head, its other words, and the end.
        lists = np.concatenate([[0], size, np.fromiter(map(len, heads), np.int64, len(heads)), [1]]).cumsum()
        pool = np.concatenate([pool, *heads, np.array([END], np.uint32)])
        count = np.maximum(n, 1) + 1
        stop = np.cumsum(count)
        take, inner = np.empty(int(count.sum()), np.int64), np.ones(int(count.sum()), bool)
        inner[stop - count] = inner[stop - 1] = False
        take[inner] = place[coded.indices.to_numpy(zero_copy_only=False)]
        take[stop - count], take[stop - 1] = len(size) + np.arange(len(heads)), len(lists) - 2
        found = pa.LargeListArray.from_arrays(pa.array(lists), pa.array(pool)).take(pa.array(take))
        ends = found.offsets.to_numpy()
        return found.values.to_numpy(), ends[stop] - ends[stop - count]


def _of_one_kind(pieces: Iterable[str]) -> bool:
    """Whether no piece spans two kinds of signs (letters, digits, others) of words of ``_EVEN``, but for a space before it.

    Their characters beyond ASCII are letters, so a piece that has another one, whole, is in none of them.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are spelt by themselves; the others from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    for piece in pieces:
        if _KIND.fullmatch(piece) or not byte.keys() >= set(piece):  # an added token
            continue
        text = bytes(map(byte.__getitem__, piece)).removeprefix(b" ").decode("utf-8", "surrogateescape")
        if any(c == "'" or not ("!" <= c <= "~" or c.isalpha() or "\udc80" <= c <= "\udcff") for c in text):
            continue
        # What is left of a cut character is of a letter.
        if len({"N" if c in "0123456789" else "P" if c.isascii() and not c.isalpha() else "L" for c in text}) > 1:
            return False
    return True


def tokenizer(path: str) -> _Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    return _tokenizers[path]


# --- jobs ------------------------------------------------------------------------------------


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode, part = tokenizer(vocabulary), TaskContext.get().partitionId()
    files, top = _filesystem(folder)
    files.create_dir(top, recursive=True)
    ids, held, lengths, size, done = [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        """Write a file, and tell its ranges of documents."""
        n = np.concatenate(lengths)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        with files.open_output_stream(f"{top}/{name}") as out:
            out.write(pack(ids, n, np.concatenate(held)))
        before = np.cumsum(n) - n
        first = np.unique(np.searchsorted(before, np.arange(0, int(n.sum()), RANGE_TOKENS)))
        first = np.unique(np.append(0, first[first < len(n)]))
        last = np.append(first[1:], len(n))
        tokens = before[first]
        rows = {
            "part": pa.array([part] * len(first), pa.int32()), "path": pa.array([f"{folder}/{name}"] * len(first)),
            "first_in_part": pa.array(done + tokens), "first_doc": pa.array(first), "n_docs": pa.array(last - first),
            "first_token": pa.array(tokens), "n_tokens": pa.array(np.append(tokens[1:], n.sum()) - tokens),
        }
        return pa.RecordBatch.from_pydict(rows)

    for batch in batches:
        for lo, hi in _pieces(batch.column(1)):
            piece = batch.slice(lo, hi - lo)
            tokens, n = encode(piece.column(1))
            ids += piece.column(0).to_pylist()
            held.append(tokens)
            lengths.append(n)
            size += len(tokens)
            if size >= FILE_TOKENS:
                yield flush()
                done, ids, held, lengths, size = done + size, [], [], [], 0
    if ids:
        yield flush()


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about CHUNK bytes at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
        yield lo, hi
        lo = hi


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, path = _filesystem(row["path"])
            with files.open_input_file(path) as f:
                file = TokenFile(f)
                tokens = file.tokens(row["first_token"], row["first_token"] + row["n_tokens"]).astype("<u4")
            some = slice(row["first_doc"], row["first_doc"] + row["n_docs"])
            lengths = file.lengths[some]
            at = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(tokens[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.ids[some], pa.int64()), pa.array(at[:-1] + row["first"]), pa.array(lengths), pa.array(crc, pa.int64())],
                names=["doc", "start", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files in ascending order of ``id`` (null first) and return their stored register.

    (path, first_doc, n_docs, first_token, n_tokens, first) per range of documents, about RANGE_TOKENS each, ``first`` being the number of
    tokens in all documents before. A null or empty text is one end token; rows of equal ids stand in the order of a hash of their
    texts; an empty table writes nothing. Documents are dealt out by ranges of ids and that hash, of which a sample goes to the driver,
    and of texts none; files of a lost attempt are in no register. Of the files only a total per task goes to the driver.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    dealt = rows.repartitionByRange(F.col("doc"), F.col("tie")).sortWithinPartitions("doc", "tie", "text").select("doc", "text")
    spark = docs.sparkSession
    files = stored(dealt.mapInArrow(partial(_write, folder=folder, vocabulary=vocabulary), _RANGES), "token-files")
    totals, before, offsets = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect(), 0, []
    for r in totals:
        offsets.append((r["part"], before))
        before += r["n"]
    offset = spark.createDataFrame(offsets, "part int, before bigint")
    place = (F.col("before") + F.col("first_in_part")).alias("first")
    return files.join(F.broadcast(offset), "part").select("path", "first_doc", "n_docs", "first_token", "n_tokens", place)


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document: ranges of documents are read in parallel, of each file the blocks they need."""
    shuffles = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffles, math.ceil(files.count() / 64))
    spread = files.repartition(tasks, "path", "first_doc")
    return spread.mapInArrow(_read, "doc bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, vocabulary)).withColumnRenamed("doc", "doc_id")
