import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from headway.llm import spelling
from headway.llm.oracle import ORACLE
from headway.llm.spelling import Direction, WordIndex, count_words, near_words, spelling_groups
from tests.compare import connect, difference


def near(a, b):
    """Whether one inserted, deleted or replaced code point tells the words apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(rnd, letters, n, longest=9):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(2, longest))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(20))
def test_searches_against_all_pairs(seed):
    rnd = random.Random(seed)
    letters = ["ab", "abcdé÷z", "aé日𝄞"][seed % 3]
    words = random_words(rnd, letters, 150)
    queries = words + random_words(rnd, letters + "q", 40)
    index = WordIndex(words, queries)
    for right in (False, True):
        query, place = index.near(queries, right)
        want = sorted(
            (i, j) for i, a in enumerate(queries) for j, b in enumerate(words)
            if near(a, b) and (b.endswith(a[len(a) // 2 :]) if right else b.startswith(a[: len(a) // 2]))
        )
        assert sorted(zip(query.tolist(), place.tolist(), strict=True)) == want


def test_ranks_are_those_of_sorted_suffixes():
    words = ["ab", "abab", "abb", "b", "ba", "babab"]
    codes = np.concatenate([[ord(c) - 96 for c in w] for w in words])
    direction = Direction(codes, np.cumsum([0, *map(len, words)]), 2)
    counts = direction.counts(np.array([1, 2, 0]), np.array([7, 22, 22]))
    symbols = direction.symbols
    assert [(int((symbols[:i] < c).sum()), int((symbols[:i] <= c).sum())) for c, i in ((1, 7), (2, 22), (0, 22))] == list(
        zip(*map(list, counts), strict=True)
    )


def brute(words, times=5):
    rows = {}
    for word, n in words.items():
        others = [w for w in words if near(word, w)]
        best = min(others, key=lambda w: (-words[w], w), default=None)
        form = best if best is not None and words[best] >= times * n else None
        rows[word] = [form, n, len(others), words[form] if form else None]
    found = []
    for word, (form, n, n_near, form_n) in rows.items():
        root = word
        while rows[root][0]:
            root = rows[root][0]
        found.append((word, form, root, n, n_near, form_n))
    return sorted(found, key=repr)


@pytest.mark.parametrize(("seed", "half_rows"), [(1, 1 << 16), (2, 20), (3, 7)])
def test_groups_against_all_pairs(spark, monkeypatch, seed, half_rows):
    """Also with half of the words under one beginning, cut into many parts."""
    monkeypatch.setattr(spelling, "HALF_ROWS", half_rows)
    monkeypatch.setattr(spelling, "SHARD_ROWS", 100)
    rnd = random.Random(seed)
    words = {w: int(5 * 3 ** rnd.uniform(0, 9)) for w in random_words(rnd, "abé", 300)}
    words |= {"aaaaaaaa" + w: rnd.randint(5, 5000) for w in random_words(rnd, "ab", 120, 4)}
    words["x" * 5000], words["x" * 5001] = 5, 26
    got = spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(words)


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def test_words(documents, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rnd = random.Random(4)
    pool = [w.upper() if rnd.random() < 0.2 else w for w in random_words(rnd, "abcdefghÉé", 60, 10)]
    rows = [(i, " 1".join(rnd.choice(pool) for _ in range(60))) for i in range(300)]
    rows += [(None, "Überfall überfall " * 9), (5, None), (6, ""), (7, "ÀÉÎÕÜ÷×ÿ " * 3), (7, "ÀÉÎÕÜ÷×ÿ " * 3), (8, "x" * 300_000 + " ")] * 1
    got = {r["word"]: r["n"] for r in count_words(documents(rows)).collect()}
    assert got == counted(rows) and any(len(w) >= 6 for w in got)


def test_nulls_ties_and_empty_tables(documents, messy):
    assert spelling_groups(count_words(documents([]))).collect() == []
    assert near_words(count_words(documents([(1, None), (2, "")]))).collect() == []
    rows = [(1, "almost " * 100), (1, "almost " * 100), (3, "almoss almosk almost " * 5), (4, "almos1 " * 9)]
    got = spelling_groups(count_words(documents(rows), slip=None))
    assert sorted(tuple(r) for r in got.collect()) == brute({"almost": 205, "almoss": 5, "almosk": 5})
    spelling_groups(count_words(messy)).collect()


def test_sql(spark):
    from headway.llm.queries import registered

    folder = "/root/testdata/sf0.001"
    found = registered()["op12_spelling_groups"](spark, folder)
    assert difference(found, connect(folder), ORACLE["op12_spelling_groups"]) is None
