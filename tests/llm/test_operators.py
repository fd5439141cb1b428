"""Every operator against brute force on texts with all the awkward cases, and on an empty table."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from snapledger.llm import components, contamination, licenses, minhash, quality, secrets, segment, substrings, tokens, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, id="doc_id"):
    return {r[id]: r for r in df.collect()}


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# --- 1 ---


def base_spans(t):
    out = []
    for m in re.finditer(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        out += [(m.start(), 0, m.end())] * (len(m[1]) >= 12)
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(docs, texts, nothing):
    got = by_id(secrets.digest(secrets.find_secrets(docs)))
    for i, t in texts.items():
        spans = base_spans(t)
        assert got[i].base_sha256 == sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
    assert got[9].n_random >= 1 and "random" not in got[10].spans
    assert secrets.find_secrets(nothing).count() == 0


def test_redaction_leaves_the_rest(docs, texts, nothing):
    out = secrets.redact(docs)
    got = by_id(out)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert got[9].text == 'say [SECRET]" and [SECRET], é\U0001f600 [SECRET] end'
    assert got[4].text is None and got[0].text == texts[0] and got[16].text == texts[16]
    assert secrets.redact(nothing).count() == 0


def test_thresholds_do_not_flag_ordinary_strings(spark):
    rng = np.random.default_rng(1)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(300)]
    plain = ["".join(rng.choice(["inter", "nation", "al", "isation", "ment"], 7)) for _ in range(300)]
    got = by_id(secrets.digest(secrets.find_secrets(spark.createDataFrame(list(enumerate(hexes + plain)), "doc_id long, text string"))))
    assert sum(got[i].n_random for i in range(300)) >= 285
    assert sum(got[i].n_random for i in range(300, 600)) <= 15


@pytest.mark.parametrize("kind, n, found", [("hex", 40, 250), ("base32", 40, 0), ("base64", 40, 250), ("base64", 24, 0), ("hex", 100, 250)])
def test_control_in_every_class(spark, kind, n, found):
    """A class of ordinary identifiers flags next to none, one of random strings nearly all, and a mixed one keeps the rate.

    Of a mixed class at least ``found`` of 300 random strings are: where strings are short for their alphabet, the tests tell few or none.
    """
    rng = np.random.default_rng(n)
    letters = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}[kind]
    words = ["cafe", "decade", "facade", "beef", "20210329", "0000", "dead", "12"] if kind == "hex" else "inter nation Value get_user -id 12 total Count max_ of table price".split()
    plain = ["".join(rng.choice(words, n))[:n] for _ in range(300)]
    plain = [x.upper().replace("_", "A").replace("-", "B").replace("1", "C") for x in plain] if kind == "base32" else plain
    random = ["".join(rng.choice(list(letters), n)) for _ in range(300)]

    def flagged(strings):
        df = spark.createDataFrame(list(enumerate(strings)), "doc_id long, text string")
        got = by_id(secrets.digest(secrets.find_secrets(df)))
        return [got[i].n_random for i in range(len(strings))]

    assert sum(flagged(plain)) <= 15
    assert sum(flagged(random)) >= 270
    both = flagged(plain + random)
    assert sum(both[300:]) >= found and sum(both[:300]) <= 0.1 * sum(both)


# --- 2 ---


def test_licenses(docs, texts, nothing):
    got = by_id(licenses.digest(licenses.scan(docs)))
    for i, t in texts.items():
        w = alnum(t)
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want = (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert 0 <= got[i].score <= 1
    assert got[11].labels == "apache-2,cc-by-nc,mit" and got[12].labels == "mpl" and got[0].labels == ""
    assert licenses.digest(licenses.scan(nothing)).count() == 0


def test_contained_detections_are_suppressed(spark):
    one = spark.createDataFrame([(1, "Licensed under the terms of the GNU Lesser General Public License version 2")], "doc_id long, text string")
    found = licenses.scan(one).first().detections
    assert [(d.label, d.priority) for d in found] == [("lgpl", 2)]
    assert len(licenses.RULES) >= 200


LICENCE_SPELLINGS = [
    ("This is licensed under the GNU General Public License.", "gpl"),
    ("It is licensed under the GNU General Public Licence.", "gpl"),
    ("Distributed under the GNU General Public License v3.0 or later", "gpl-3"),
    ("See the GNU General Public License v2 for details", "gpl-2"),
    ("under version 2 of the GNU General Public License", "gpl-2"),
    ("GNU General Public License as published by the Free Software Foundation; either version 3 of it", "gpl-3"),
    ("released under GPLv3", "gpl-3"),
    ("the GNU GPL v2 applies", "gpl"),
    ("available under the GNU Lesser General Public Licence v2.1", "lgpl"),
    ("GNU Affero General Public License v3.0", "agpl-3"),
    ("GNU Affero General Public License", "agpl-3"),
    ("licensed under the Apache License v2.0", "apache-2"),
    ("Apache Licence 2.0", "apache-2"),
    ("Apache License, Version 1.1", "apache-1.1"),
    ("see the Apache License", "apache"),
    ("released under the Mozilla Public License v2.0", "mpl-2"),
    ("governed by the Mozilla Public License v1.1", "mpl-1.1"),
    ("Mozilla Public Licence", "mpl"),
    ("under the Eclipse Public License v2.0", "epl-2"),
    ("Eclipse Public License - v 1.0", "epl-1"),
    ("the Eclipse Public Licence", "epl"),
    ("European Union Public Licence", "eupl"),
    ("European Union Public License v. 1.2", "eupl"),
    ("Common Development and Distribution License 1.0", "cddl"),
    ("GNU Free Documentation Licence, version 1.3", "fdl"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa"),
    ("https://creativecommons.org/licenses/by-nc/4.0/", "cc-by-nc"),
    ("released under a BSD 3-Clause License", "bsd-3"),
    ("a two clause BSD licence", "bsd-2"),
    ("Artistic License 2.0", "artistic-2"),
    ("Boost Software License 1.0", "boost-1"),
    ("Open Database Licence v1.0", "odbl"),
    ("SIL Open Font License, Version 1.1", "ofl-1.1"),
    ("Microsoft Public Licence", "ms-pl"),
    ("Business Source License 1.1", "busl-1.1"),
    ("Neither the name of X nor the names of its contributors may be used to endorse or promote products", "bsd-3"),
    ("The Software shall be used for Good, not Evil.", "json"),
    ("The origin of this software must not be misrepresented", "zlib"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl"),
    ("the mozilla in the common garden has a general public", ""),
    ("an apache pilot read version 2 of the clause in public", ""),
]


def test_names_in_their_usual_spellings(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENCE_SPELLINGS)], "doc_id long, text string")
    got = by_id(licenses.digest(licenses.scan(rows)))
    assert [(t, got[i].labels) for i, (t, _) in enumerate(LICENCE_SPELLINGS)] == LICENCE_SPELLINGS
    assert all((got[i].score > 0) == bool(label) for i, (_, label) in enumerate(LICENCE_SPELLINGS))
    assert licenses.HAND_WRITTEN >= 200


def test_every_named_licence_is_found_where_it_is_granted():
    trade = re.compile(licenses.TRADE)
    for key, gate, rules in licenses.GROUPS:
        assert re.compile(gate) and all(key == rule[1] and re.compile(rule[4]) for rule in rules)
    for label, key, name in licenses.NAMES + licenses.FALLBACKS:
        assert trade.search(f" under the {name} "), label


# --- 3 ---


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def reference_components(sets):
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, texts, nothing, width):
    got = by_id(minhash.near_duplicates(docs, width=width), "doc")
    sets = {i: shingles(t, width) for i, t in texts.items()}
    for i, c in reference_components(sets).items():
        assert (got[i].n_shingles, got[i].component, got[i].kept) == (len(sets[i]), c, c == i)
    assert got[None].component is None and got[None].kept
    kept = minhash.keep_one(docs, width=width)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2)").count() == 0 and kept.where("doc_id is null").count() == 1
    assert minhash.near_duplicates(nothing).count() == 0


def test_chains_and_large_groups(spark):
    """A chain whose ends are unlike, and a group of copies with one changed word each."""
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[: 60 + 4 * k]) if k < 10 else " ".join(words) for k in range(10)]
    copies = [" ".join(["z%d" % j if j != 7 * (k % 9) else f"c{k}" for j in range(80)]) for k in range(60)]
    rows = list(enumerate(chain + copies))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4), "doc")
    for i, c in reference_components({i: shingles(t, 4) for i, t in rows}).items():
        assert got[i].component == c


def test_bitmaps_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (0, 1, 50, 900, 2500)]
    at = np.cumsum([0, *map(len, sets)])
    bits = minhash.bitmaps(np.concatenate(sets), at)
    for x, a in zip(sets, bits, strict=True):
        for y, b in zip(sets, bits, strict=True):
            differ = sum(int(v).bit_count() for v in a ^ b)
            assert differ <= len(np.setxor1d(x, y)) and (len(x) > 1 or len(y) > 1 or differ == len(np.setxor1d(x, y)))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


# --- 4 ---


def test_warc(spark, docs, nothing, tmp_path):
    pages = docs.select(docs.doc_id.alias("page_id"), docs.source.alias("url"), docs.text.alias("html"), "key", "score")
    got = by_id(warc.round_trip(pages), "page_id")
    rows = pages.collect()
    last = {}
    for r in rows:
        if r.page_id is not None:
            last[r.html or ""] = max(last.get(r.html or "", -1), r.page_id)
    for r in rows:
        raw, first = (r.html or "").encode(), last[r.html or ""]
        alone = r.page_id is None or first == r.page_id
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if alone else "revisit", None if alone else first)
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == want
    assert warc.round_trip(nothing.select(docs.doc_id.alias("page_id"), docs.source.alias("url"), docs.text.alias("html"))).count() == 0


def test_warc_pushdown_and_plain_members(spark, docs, tmp_path):
    import gzip

    path = f"{tmp_path}/a"
    warc.write_pages(docs, path, "doc_id", "source", "text")
    some = warc.read(spark, path, payload=False).where("record_type = 'revisit' and record_id in ('<urn:page:0>', '<urn:page:9>')")
    assert [(r.record_id, r.payload) for r in some.collect()] == [("<urn:page:0>", None)]
    row = dict(record_type="response", record_id="<urn:page:1>", target_uri=None, refers_to=None, payload_digest="d", payload_bytes=3, payload=b"abc")
    joined = gzip.compress(warc.record(row)) + warc.member(warc.record(row)) + gzip.compress(warc.record(row))
    assert [p() for _, p in warc.members(memoryview(joined))] == [b"abc"] * 3


# --- 5 ---


def test_contamination(spark, docs, texts, nothing):
    items = [(7, "zz beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu"), (12, "one two THREE"), (3, None), (4, "café"), (5, "unseen words"), (12, "word1 thing1 word2 thing2")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(contamination.digest(contamination.contaminated(docs, table)))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t or "")
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(i)
    for i, t in texts.items():
        w, hit, found = alnum(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        want = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want
    assert got[None].n_hit == 0
    assert contamination.contaminated(docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert contamination.contaminated(nothing, table).count() == 0
    kept = contamination.drop_contaminated(docs, table)
    assert kept.columns == docs.columns and kept.where("doc_id in (8, 19)").count() == 0


def test_terms_too_many_to_send(spark, docs, monkeypatch):
    table = spark.createDataFrame([(1, "one two three"), (2, "word1 thing1 word2")], "item_id long, text string")
    want = {r.doc: (r.n_words, r.n_hit) for r in contamination.contaminated(docs, table).collect()}
    monkeypatch.setattr(contamination, "MAX_TERMS", 2)
    assert {r.doc: (r.n_words, r.n_hit) for r in contamination.contaminated(docs, table).collect()} == want


def test_proximity(spark, docs):
    table = spark.createDataFrame([(1, "alpha gamma epsilon")], "item_id long, text string")
    cut = contamination.windows(table)
    near = lambda slop: {r.doc for r in contamination.proximity(contamination.index(docs), cut, slop).collect()}
    assert near(0) == set() and near(2) == {13}


def near_centres(words, terms, slop):
    reach = range(-2 * slop - len(terms), len(words) + 2 * slop)
    fits = lambda s: all(t in words[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, t in enumerate(terms))
    return {s for s in reach if fits(s)}


@pytest.mark.parametrize("slop", [0, 1, 2, 4])
def test_every_proximity_match_at_any_shift(spark, slop):
    rng = np.random.default_rng(slop)
    passages = ["a x x b x x c", "b a c", "a b c", "c x a b", "a x b x x x x c", "d d a d", "d a d", "a b c x x a x b x c"]
    rows = [" ".join(["y"] * k + [p] + ["y"] * 4 + [p]) for p in passages for k in range(7)]
    rows += [" ".join(rng.choice(list("abcdxy"), 30)) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    items = {1: "a b c", 2: "d a d", 3: "c b a d b", 4: "a"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(i, j): near_centres(r.split(), items[j].split(), slop) for i, r in enumerate(rows) for j in items}
    want = {k: v for k, v in want.items() if v}
    cut = contamination.windows(bench)
    item = {r.window: r.item for r in cut.collect()}
    alone, query = collections.defaultdict(set), collections.defaultdict(set)
    for r in contamination.proximity(contamination.index(table), cut, slop).collect():
        alone[r.doc, item[r.window]] |= set(range(r.start + r.spread - slop, r.start + slop + 1))
    for r in contamination.contaminated(table, bench, slop=slop).collect():
        for m in r.near:
            query[r.doc, m.item] |= set(range(m.start + m.spread - slop, m.start + slop + 1))
    assert alone == want and query == want


def test_the_query_returns_proximity_matches(spark):
    table = spark.createDataFrame([(1, "x alpha beta x gamma x"), (2, "alpha beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = by_id(contamination.digest(contamination.contaminated(table, bench)))
    assert [(got[i].contaminated, got[i].near) for i in (1, 2, 3)] == [(False, "7:0:1:1"), (True, "7:0:0:0"), (False, "")]


# --- 6 ---


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(3)
    common = [f"plain{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        w = list(rng.choice(common, 40)) + (["scumbag" + str(i % 5)] if toxic else [])
        rows.append((i, " ".join(rng.permutation(w))))
        if rng.random() < 0.5:
            marks.append((i, int(toxic)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = by_id(toxicity.digest(table, labels))
    held = [i for i in range(1200) if got[i].held_out]
    assert held == [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 8 == 0) for i in held]) > 0.97
    model = toxicity.train(table, labels)
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score < 0 or score > 1 or score is null").count() == 0
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.digest(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(nothing, model).count() == 0


# --- 7 ---


def test_quality(docs, texts, nothing):
    got = by_id(quality.digest(quality.judge(docs)))
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (g.kept and g.base_failed)
    assert got[0].kept and not got[15].kept
    assert quality.judge(nothing).count() == 0


def test_weighing_finds_the_accurate_rule(spark):
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.7
    votes = [(int(x if rng.random() < 0.95 else not x), int(x if rng.random() < 0.75 else not x), int(x if rng.random() < 0.8 else not x)) for x in truth]
    share, chances = quality.weigh(spark.createDataFrame(votes, "a int, b int, c int"), ["a", "b", "c"])
    right = {r: chances[r][1][0] for r in "abc"}
    assert abs(share - 0.7) < 0.05 and right["a"] > right["c"] > right["b"]


# --- 8 ---


def test_repeated_strings(docs, texts, nothing):
    got = by_id(substrings.remove_repeats(docs, texts=True), "doc")
    seen = set()
    for i, t in texts.items():
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), int(gone.sum()), spans, sha(kept))
    assert substrings.remove_repeats(nothing).count() == 0


def brute_repeats(rows):
    """Rows of an id and a text are one document; documents are in the order of id and digest."""
    seen, found = set(), {}
    for doc, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], sha(r[1]))):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        found[doc, text] = (doc, len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), sha(kept))
    return sorted((found.get(r, (None, len(r[1].encode()), 0, 0, sha(r[1]))) for r in rows), key=repr)


def shared_passages(seed, n):
    """Copies, near copies and passages in surroundings of their own."""
    rng = np.random.default_rng(seed)

    def words(k):
        return " ".join(f"w{x}" for x in rng.integers(0, 5000, k))

    passages = [words(40) for _ in range(4)]
    whole = words(120)
    out = []
    for i in range(n):
        kind = rng.integers(0, 4)
        own = f"{words(int(rng.integers(0, 30)))} {passages[rng.integers(0, 4)]} {words(int(rng.integers(0, 30)))}"
        out.append((i, [whole, whole.replace("w1", f"x{i}", 1), own, f"{own} {own}"][kind]))
    return out


@pytest.mark.parametrize("crowd", [1, 5, substrings.CROWD])
def test_passages_among_many(spark, crowd):
    rows = shared_passages(crowd, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, substrings.remove_repeats(df, crowd=crowd).collect()), key=repr) == brute_repeats(rows)


def test_repeated_ids(spark):
    a, b = "".join(f"text {i} " for i in range(40)), "".join(f"other {i * 7} " for i in range(40))
    cases = [
        [(1, a), (1, a), (2, b)],
        [(1, a), (1, b)],
        [(1, a + b), (1, b + a), (1, a), (2, a), (2, a), (0, "short"), (0, "short"), (None, a), (None, a), (3, "")],
    ]
    for rows in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, substrings.remove_repeats(df).collect()), key=repr) == brute_repeats(rows)


def test_a_common_name_meets_once_a_batch(spark):
    """What is sent to a name's bucket, and to its sorting task, does not grow with the documents of a batch."""
    import pyarrow as pa

    passage = "".join(f"passage {i} " for i in range(30))
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(1000)), "text": pa.array([f"{i} {passage} {i}" for i in range(1000)])})
    sent = next(substrings._names(iter([batch]), 4)).to_pylist()
    names = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in sent if r["bucket"] >= 0])
    assert len(names) == len(np.unique(names))
    common = [np.frombuffer(r["names"], np.int64) for r in sent if r["bucket"] < 0][0]
    lists = batch.append_column("names", pa.array([np.unique(common).tolist()] * 1000, pa.list_(pa.int64())))
    out = next(substrings._contexts(iter([lists]))).to_pylist()
    whole = [r for r in out if r["bytes"] is not None]
    inner = {r["key"] for r in out if r["bytes"] is None}
    assert inner and all(sum(r["key"] == k for r in whole) < 1000 for k in inner)


# --- 9 ---


def test_token_files(docs, texts, nothing):
    from tokenizers import Tokenizer

    own, at = Tokenizer.from_file(BPE), 0
    got = by_id(tokens.round_trip(docs, BPE))
    for i in [None, *texts]:
        ids = [*own.encode(texts[7] if i is None else texts[i], add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.round_trip(nothing, BPE).count() == 0


def test_blocks_decode_alone_and_breakage_is_seen():
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.zipf(1.3, 600_000) % 50_000, [7] * 1000]).astype(np.uint32)
    packed = tokens.pack([1, None], np.array([600_000, 1000]), data)
    file = tokens.TokenFile(packed)
    assert np.array_equal(file.tokens(), data) and np.array_equal(file.tokens(300_000, 300_100), data[300_000:300_100])
    assert file.ids == [1, None]
    broken = bytearray(packed)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="broken"):
        tokens.TokenFile(bytes(broken)).tokens()
    assert np.array_equal(tokens.TokenFile(tokens.pack([1], np.array([1]), np.array([0]))).tokens(), [0])


# --- 10 ---


def test_segmentations_decode_and_differ(docs, texts, nothing):
    rows = segment.segmentations(docs, MODEL, k=4, check=True).collect()
    own = collections.defaultdict(list)
    for r in rows:
        assert r.decoded and r.log_inclusion <= 0
        own[r.doc].append(r)
    assert set(own) == {*texts, None}
    for group in own.values():
        assert len({tuple(r.ids) for r in group}) == len(group)
        assert [r.perturbed for r in sorted(group, key=lambda r: r.sample)] == sorted((r.perturbed for r in group), reverse=True)
    assert len(own[5]) == 1 and len(own[0]) == 4
    again = {(r.doc, r["sample"]): r.ids for r in segment.segmentations(docs.repartition(5), MODEL, k=4).collect()}
    assert again == {(r.doc, r["sample"]): r.ids for r in rows}
    assert segment.segmentations(nothing, MODEL).count() == 0


def test_samples_follow_the_distribution():
    v = segment.Vocabulary(MODEL)
    words = segment.words_of("abc a")
    paths = [((), 0.0)]
    for w in words:
        source, n, piece, cost, _ = v.edges([w])
        out, full = [((), 0.0, 0)], []
        while out:
            ids, lp, at = out.pop()
            if at == len(w):
                full.append((ids, lp))
            else:
                out += [((*ids, int(p)), lp + c, at + int(k)) for s, k, p, c in zip(source, n, piece, cost) if s == at]
        paths = [(a + b, x + y) for a, x in paths for b, y in full]
    total = math.log(sum(math.exp(x) for _, x in paths))
    chance = {a: math.exp(x - total) for a, x in paths}
    n, first, weight = 8000, collections.Counter(), collections.Counter()
    keys = segment.mix(np.arange(1, n + 1, dtype=np.uint64))
    for got in segment.sample(v, ["abc a"] * n, keys, 2):
        assert all(abs(x[0] - math.log(chance[tuple(x[3].tolist())])) < 1e-9 for x in got)
        first[tuple(got[0][3].tolist())] += 1
        for x in got:
            weight[tuple(x[3].tolist())] += math.exp(x[0] - x[2])
    for path, p in chance.items():
        assert abs(first[path] / n - p) < 0.02
        if p > 0.01:
            assert abs(weight[path] / n - p) < 0.03  # inclusion scores give unbiased sums


# --- queries and pipeline ---


def test_queries_cover_the_operators():
    import corpus_pipeline
    from snapledger.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and set(corpus_pipeline.ORACLE_SQL or {}) <= {"pipeline"}


def test_pipeline_equals_its_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in toxicity.reject_toxic(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    label = reference_components({i: shingles(t or "", 5) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if label[i] == i}
    wins = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = alnum(r.text or "")
        wins |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9)) if w}
    lens = {len(x) for x in wins}

    def clean(t):
        w = alnum(t or "")
        return not any(tuple(w[k : k + n]) in wins for n in lens for k in range(len(w) - n + 1))

    want = {i for i, t in kept.items() if clean(t)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want and len(got) == 2 * len(want)
    v = segment.Vocabulary(MODEL)
    for r in got:
        if not base_spans(kept[r.doc_id] or "") and r["sample"] == 0 and not re.search(secrets.CANDIDATE, kept[r.doc_id] or ""):
            assert v.decode(r.ids) == (kept[r.doc_id] or "")
