import random

import numpy as np

from headway.llm import decontaminate
from headway.llm.decontaminate import Benchmark, _counts, find_items, shingle_hashes, window_fingerprints, words_of


def brute(docs, items):
    found = {}
    for doc_id, text in docs:
        words = words_of(text)
        for item_id, item in items:
            own = words_of(item)
            if not own:
                continue
            size, length = min(5, len(own)), min(len(own), len(words))
            want = _counts(own, size)
            for start in range(max(0, len(words) - length + 1)):
                got = _counts(words[start : start + length], size)
                least = sum((got & want).values())
                whole = got.total() + want.total() - least
                if whole and least / whole >= 0.8 and least / whole > found.get((doc_id, item_id), (0,))[0]:
                    found[doc_id, item_id] = (least / whole, start)
    return found


def case(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 8, 30, 31, 45])))) for i in range(12)]
    items += [(50, ""), (51, None), (52, "  ")]
    docs = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            item = words_of(rng.choice(items[:12])[1])
            item = [w.decode() for w in item]
            for _ in range(rng.randrange(2)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() for w in item]
        docs.append((i, " ".join(text)))
    return docs, items


def test_against_brute_force(spark, documents):
    for seed in range(3):
        docs, items = case(seed)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        found = find_items(documents(docs), benchmark).collect()
        want = brute(docs, items)
        assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in found} == want
        assert len(want) > 20 and any(r["similarity"] < 1 and r["bits"] > 0 for r in found)
        clean = decontaminate.decontaminate(documents(docs), benchmark).collect()
        assert {r["doc_id"] for r in clean} == {i for i, _ in docs} - {i for i, _ in want}


def test_items_in_several_passes(spark, documents, monkeypatch):
    docs, items = case(7)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in find_items(documents(docs), benchmark).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 4)
    assert {tuple(r) for r in find_items(documents(docs), benchmark).collect()} == whole


def test_tables_find_every_item_within_the_radius():
    rng = np.random.default_rng(1)
    items = [(i, [str(x).encode() for x in rng.integers(0, 99, 20)]) for i in range(60)]
    of = decontaminate._Class(20, items)
    prints = of.prints[rng.integers(0, 60, 400)]
    for _ in range(30):
        flip = rng.random(400) < 0.7
        prints = np.where(flip, prints ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), prints)
    window, item, distance = of.candidates(prints)
    true = np.bitwise_count(prints[:, None] ^ of.prints[None, :]) <= decontaminate.RADIUS
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(true)), strict=True))


def test_window_fingerprints_are_those_of_the_windows():
    words = [str(i % 13).encode() for i in range(50)]
    hashes = shingle_hashes(words, 5)
    all_ = window_fingerprints(hashes, np.arange(30), 10)
    assert all_.tolist() == [window_fingerprints(hashes[i : i + 10], np.array([0]), 10)[0] for i in range(30)]


def test_messy_rows_and_no_rows(spark, messy, documents):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog. it barks."), (2, "one."), (3, None)], "item_id long, text string")
    found = find_items(messy, items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in found) == [(-1, 1), (1, 1), (7, 1), (7, 1), (8, 2)]
    assert decontaminate.decontaminate(messy, items).columns == messy.columns
    assert find_items(documents([]), items).count() == 0 and find_items(messy, items.limit(0)).count() == 0
    assert Benchmark([(1, "")]).matches("any words here") == []


def test_items_without_an_id_and_with_a_repeated_one_are_items_each(spark, documents):
    first, second, third, fourth = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    benchmark = spark.createDataFrame([(None, first), (None, second), (4, third), (4, fourth)], "item_id long, text string")
    docs = documents([(1, f"{fourth} {third} {second} {first}"), (2, first), (3, "nothing of these")])
    rows = find_items(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["start"]) for r in rows) == [
        (1, 0, 24), (1, 0, 36), (1, 4, 0), (1, 4, 12), (2, 0, 0)
    ]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark).collect()] == [3]


def test_a_phrase_that_many_items_share_is_searched_in_parts(monkeypatch):
    """Windows times items in memory are bounded, and the parts give what the whole gives."""
    import tracemalloc

    phrase = "the quick brown fox jumps"
    items = [(i, f"{phrase} " + " ".join(f"w{i}x{k}" for k in range(15))) for i in range(400)]
    text = " ".join([phrase] * 1500 + [items[7][1], *[phrase] * 500, items[3][1]])
    whole = decontaminate.Benchmark(items).matches(text)
    assert {m[0] for m in whole} == {3, 7}
    monkeypatch.setattr(decontaminate, "PAIRS", 20_000)
    index = decontaminate.Benchmark(items)
    tracemalloc.start()
    assert index.matches(text) == whole
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
