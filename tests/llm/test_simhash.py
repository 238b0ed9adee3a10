import random

import numpy as np
import pytest

from headway.llm import simhash
from headway.llm.components import components


def brute_groups(prints, radius):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    found = set()
    while len(found) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_linked_in_finds_all_groups_of_dense_clusters(seed, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 32)
    points = np.array(clustered(700, seed), dtype=np.uint64)
    a, b = simhash.linked_in(points, 2)
    label = np.arange(len(points))
    label[a] = b
    assert label.tolist() == brute_groups(points.tolist(), 2)


def test_every_close_pair_shares_a_shard():
    points = np.array(clustered(800, 9), dtype=np.uint64)
    nodes = simhash.fit_tree(points[::3], 2, shard_sample=20)
    at, shard = simhash.shards_of(points, nodes, 2)
    assert len(set(shard.tolist())) > 4 and set(at.tolist()) == set(range(len(points)))
    shards = [set() for _ in points]
    for i, s in zip(at.tolist(), shard.tolist(), strict=True):
        shards[i].add(s)
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert all(shards[i] & shards[j] for i, j in zip(x.tolist(), y.tolist(), strict=True))


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint("É b c") == xxhash.xxh64_intdigest("É b c".encode(), 42)  # only A-Z get lower case


def test_fingerprint_against_a_plain_count_of_bits():
    import random

    import xxhash

    rnd = random.Random(3)
    for _ in range(200):
        words = [rnd.choice(["a", "É", "the", "Fox", "日本", "x" * 50, "b"]) for _ in range(rnd.randint(3, 60))]
        text = "".join(w + rnd.choice([" ", "\n\t", "  "]) for w in words)
        lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        hashes = [xxhash.xxh64_intdigest(" ".join(lower[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(100, i) for i in range(101, 160)] + [(5000, 5000)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_near_duplicates_of_messy_rows(messy):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == 13
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by_id[7]] == [1, 1] and by_id[6][0]["component_id"] == 5
    assert {by_id[i][0]["component_id"] for i in (2, 3, 4)} == {2} and by_id[2][0]["fingerprint"] == "0" * 16
    assert sorted(r["component_id"] for r in by_id[None]) == [1, 2]


def test_near_duplicates_against_brute_force(documents):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 400))] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(rng.randrange(1, 8)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
    found = simhash.near_duplicates(documents(list(enumerate(texts)))).collect()
    want = brute_groups([simhash.fingerprint(t) for t in texts], 2)
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(want))


def test_no_rows(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
