"""Ids of words are those that the tokenizer gives whole texts, however the words are handed to it."""

import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from snapledger.llm import tokens
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a b", "a  b", "a\tb c\n d", "it's 3rd's x'st", "x  y", "a ", "  z q", "a<|endoftext|> b <|endoftext|> c",
       "é1 1é é. .é ñu. 12,3% (a)[b]{c} ~a~", "x–y “z” 😀 a😀b �.� éa ½a ²b", "Привет, мир. 漢字かな カナ 한국어!", "\x00a \x7f b\x1cc"]


def _texts():
    rng = np.random.default_rng(0)
    signs = [chr(c) for c in range(33, 127)] + [chr(c) for a, b in tokens.LETTERS for c in range(a, b + 1, max(1, (b - a) // 40))] + list("–½²😀́ \t")
    words = ["".join(rng.choice(signs, rng.integers(1, 9))) for _ in range(3000)]
    return [*ODD, *(" ".join(rng.choice(words, 40)) for _ in range(120)), " ".join(words)]


def _whole(texts):
    plain = Tokenizer.from_file(BPE)
    return [[*plain.encode(t or "", add_special_tokens=False).ids, tokens.END] for t in texts]


@pytest.mark.parametrize("uncut", [True, False])
def test_ids_are_those_of_whole_texts(uncut):
    texts = _texts()
    encode = tokens._Words(BPE)
    assert encode._uncut is not None
    encode._uncut = encode._uncut if uncut else None
    for column in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
        ids, n = encode(column)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == _whole(texts)


def test_ordinary_words_need_no_pattern():
    """Most of the time went into the pre-tokenizer's pattern, for words that it does not cut in any way of its own."""
    encode = tokens.tokenizer(BPE)
    seen, plain = [], encode._tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **how)

    encode._tokenizer = Counted()
    try:
        encode(pa.array([" ".join(["first", *(f"word{i}, más. слово" for i in range(500)), "don't"])]))
    finally:
        encode._tokenizer = plain
    assert sorted(seen) == [" don't", "first"]


def test_letters_are_letters():
    letters = [chr(c) for a, b in tokens.LETTERS for c in range(a, b + 1)]
    assert all(unicodedata.category(c)[0] == "L" for c in letters)
    words = [f"a{c}a" for c in letters]
    cut = Tokenizer.from_file(BPE).pre_tokenizer.pre_tokenize_str(" ".join(words))
    assert len(cut) == len(words)
    assert pc.match_substring_regex(pa.array(words), tokens._EVEN).to_pylist() == [True] * len(words)


def test_a_piece_of_two_kinds_forbids_the_short_way(tmp_path):
    assert [tokens._of_one_kind([x]) for x in ("ab", "Ġab", "Ã©a", "..", "'s")] == [True] * 5
    assert [tokens._of_one_kind([x]) for x in ("a1", "Ġa.", "Ã©1", "1Ã")] == [False] * 4
    told = json.load(open(BPE, encoding="utf-8"))
    told["model"]["vocab"]["e."] = len(told["model"]["vocab"]) + 1
    told["model"]["merges"].insert(0, ["e", "."])
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    assert tokens._Words(str(path))._uncut is None
