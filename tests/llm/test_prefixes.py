"""The prefix trie against one made of dictionaries, in one range and in many."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from snapledger.llm import prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def conversations(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, nodes = collections.defaultdict(list), []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    under, children = collections.defaultdict(list), collections.Counter(p[:-1] for p in members if p)
    for p in members:
        for d in range(len(p) + 1):
            under[p[:d]].append(p)
    for p, own in members.items():
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under[p] if x)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        leaves = sum(not children[x] for x in under[p])
        nodes.append((min(own), len(p), up, len(own), children[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=repr)


def found(df, **options):
    got = prefixes.trie(prefixes.rebuilt(prefixes.sequences(df)), **options)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=repr)


def test_query_and_sql(spark, testdata):
    folder = f"{testdata}/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(*"conv_id turn role text".split()).collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_prefix_trie"](spark, folder).collect()), key=repr)
    assert got == brute(rebuild(conversations(rows)))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet')")
    assert sorted(con.execute(queries.ORACLE_SQL["op11_prefix_trie"]).fetchall(), key=repr) == got


def mixed(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = rng.randint(1, 7)
        for t in range(turns):
            text = "hello" if t == 0 and c % 3 == 0 else rng.choice(["yes", "no", "é\U0001f600", "", None, f"own {rng.random()}" if rng.random() < 0.2 else "maybe"])
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", "assistant", None]) if t else "user", text))
    rows += [(c, 0, "user", "the very same") for c in range(1000, 1120)]  # equal conversations
    rows += [(None, 0, "user", "of no conversation"), (2001, 1, "user", "x"), (2001, 1, "user", "x"), (2001, 1, "a", "x")]  # repeated and tied turns
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("per_range", [3, 40, prefixes.TURNS])
def test_any_cut_of_the_order(spark, per_range):
    rows = mixed(60, per_range)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), turns_per_range=per_range) == brute(rebuild(conversations(rows)))


def test_without_rebuilding(spark):
    rows = mixed(30, 9)
    got = prefixes.trie(prefixes.sequences(spark.createDataFrame(rows, SCHEMA)), turns_per_range=10).collect()
    assert sorted(map(tuple, got), key=repr) == brute(conversations(rows))


def test_small_ones_and_extra_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    rows = [(7, 1, "user", "x" * 2_000_000), (7, 2, "user", "y")]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA + ", key string, n int, depth int")
    assert found(df) == brute(rebuild(conversations(rows)))


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (5, 10) for t in range(4000)] + [(11, 0, "user", "turn 0")]
    got = prefixes.trie(prefixes.sequences(spark.createDataFrame(rows, SCHEMA)), turns_per_range=1000).collect()
    assert len(got) == 4001
    root = min(got, key=lambda r: r.depth)
    assert (root.n_convs, root.n_leaves, root.saved_tokens) == (3, 1, sum(len(f"turn {t}") for t in range(4000)) + len("turn 0"))


def test_ids_of_a_sequence_stream_in_chunks(spark):
    rows = [(c, 0, "user", "x") for c in range(3 * prefixes.LISTED)]
    got = prefixes.trie(prefixes.sequences(spark.createDataFrame(rows, SCHEMA).repartition(7))).where("depth = 1").first()
    assert got.ends_sha256 == hashlib.sha256(",".join(str(c) for c in range(3 * prefixes.LISTED)).encode()).hexdigest()
