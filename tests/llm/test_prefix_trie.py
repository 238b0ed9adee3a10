import random
from hashlib import sha256
from zlib import crc32

import pytest

from headway.llm.oracle import ORACLE
from headway.llm.prefix_trie import block_chain, prefix_trie, rebuild, rebuilt_trie, turn_digests
from headway.llm.queries import prepare
from tests.compare import difference, connect

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, parent string, block string, n string"


@pytest.fixture
def conversations(spark):
    def build(rows):
        prepare(spark)
        return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)

    return build


def rebuilt(rows):
    """The turns of each conversation as they are rebuilt, from (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    found = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        found[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return found


def brute(convs):
    """All nodes by trying every prefix of every conversation, and subtrees by comparing all nodes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for way, own in members.items():
        below = [w for w in members if w[: len(way)] == way]
        leaves = [w for w in below if not any(len(x) == len(w) + 1 and x[: len(w)] == w for x in below)]
        saved = sum((len(members[w]) - 1) * (len(w[-1][1].encode()) if w else 0) for w in below)
        ends = sorted(c for c in own if len(convs[c]) == len(way))
        rows.append((
            min(own), len(way), min(members[way[:-1]]) if way else None, len(own),
            sum(len(w) == len(way) + 1 for w in below), len(leaves), saved,
            sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def random_rows(seed, convs, turns, texts):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randint(1, turns)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(texts)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_prefixes(conversations, seed):
    rows = random_rows(seed, 60, 11, ["a", "bé", ""])
    assert nodes(rebuilt_trie(conversations(rows))) == brute(rebuilt(rows))


@pytest.mark.parametrize("block", [1, 3])
def test_block_lengths_give_one_trie(conversations, block):
    """Long shared beginnings, a long way of its own, copies, and one that ends in the middle of others."""
    rows = []
    for c in range(40):
        shared = [(c, t, "user", f"s{t}") for t in range(c % 13)]
        rows += shared + [(c, len(shared) + t, "user", f"own {c % 7} {t}") for t in range(c % 3)]
    rows += [(100, t, "user", f"s{t}") for t in range(60)]
    turns = turn_digests(conversations(rows))
    convs = {}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role, text))
    assert nodes(prefix_trie(turns, turns.select("conv_id").distinct(), block)) == brute(convs)


def test_nulls_ties_and_what_is_absent(conversations):
    rows = [
        (7, None, None, None), (7, 0, "user", "x"), (7, 1, None, "y"), (8, 0, "user", "x"), (8, 0, "user", "x"),
        (9, 3, "user", None), (9, 1, "", ""), (None, 0, "user", "nobody"), (11, 5, "user", "w " * 50_000), (12, 5, "user", "w " * 50_000),
    ]
    assert nodes(rebuilt_trie(conversations(rows))) == brute(rebuilt(rows))


def test_turnless_conversations_and_no_conversations(spark, conversations):
    turns = turn_digests(conversations([(3, 0, "user", "x")]))
    ids = spark.createDataFrame([(1,), (3,)], "conv_id long")
    assert nodes(prefix_trie(turns, ids)) == brute({1: [], 3: [("user", "x")]})
    assert nodes(prefix_trie(turns.limit(0), ids)) == brute({1: [], 3: []})
    assert rebuilt_trie(conversations([])).collect() == []


def test_a_large_group_of_copies_is_hashed_by_ranges(spark, conversations):
    ids = spark.range(3).selectExpr("explode(sequence(id * 200000, id * 200000 + 700)) AS conv_id")
    turns = turn_digests(ids.selectExpr("conv_id", "0L AS turn", "'user' AS role", "'same' AS text"))
    found = {r["depth"]: r for r in prefix_trie(turns, ids).collect()}
    ordered = sorted(r[0] for r in ids.collect())
    assert found[1]["ends_sha256"] == sha256(",".join(map(str, ordered)).encode()).hexdigest()
    assert (found[1]["n_convs"], found[0]["saved_tokens"], found[0]["n_leaves"]) == (2103, 2102 * 4, 1)


def test_rebuilding(conversations):
    rows = random_rows(9, 30, 12, ["a", "b"])
    turns = turn_digests(conversations(rows))
    got = {}
    for r in rebuild(turns, turns.select("conv_id").distinct()).collect():
        got.setdefault(r["conv_id"], []).append((r["place"], r["digest"]))
    assert {c: len(t) for c, t in got.items()} == {c: len(t) for c, t in rebuilt(rows).items() if t}
    blocks = block_chain(turns, 2).collect()
    assert sum(len(b["turns"]) for b in blocks) == len(rows) and sum(b["last"] for b in blocks) == 30


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_sql(spark, folder):
    from headway.llm.queries import registered

    found = registered()["op11_prefix_trie"](spark, folder)
    assert difference(found, connect(folder), ORACLE["op11_prefix_trie"]) is None
