import random
from itertools import combinations

import numpy as np
import pytest

from headway.llm import similar

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def corpus(seed):
    """Texts and near copies with up to a few words replaced, half of them within a shared frame."""
    rng = random.Random(seed)
    frame, rows = [f"frame{i}" for i in range(60)], []
    for group in range(50):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 9, 40, 90]))]
        for _ in range(rng.choice([1, 2, 4])):
            own = edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))
            rows.append(frame + own if group % 2 else own)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (None, "w1 w2")]


def brute(rows):
    """Components by the similarity of all pairs."""
    sets = {i: similar.shingle_set(t) for i, t in rows if i is not None}
    least = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if similar.similar(sets[a], sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least, links


@pytest.mark.parametrize(("run", "every"), [(256, 64), (2, 1), (256, 1)])
def test_against_brute_force(documents, monkeypatch, run, every):
    monkeypatch.setattr(similar, "RUN", run)
    monkeypatch.setattr(similar, "SAMPLE_EVERY", every)
    rows = corpus(run + every)
    want, links = brute(rows)
    assert len(links) > 30
    found = similar.near_copies(documents(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want and len(found) == len(want)


def test_the_stage_drops_copies_with_a_replaced_word(spark, documents):
    """Two replaced words in a hundred: similarity 86/106, and far more than two bits of SimHash."""
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[30] = near[60] = "other"
    for i in (10, 30, 50, 70, 90):
        far[i] = "else"
    docs = documents([(i, " ".join(w)) for i, w in enumerate([words, near, far])])
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 2}


def test_rows_that_repeat_an_id(documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, b + " more"), (11, c)]
    found = {r["doc_id"]: r["component_id"] for r in similar.near_copies(documents(rows)).collect()}
    assert found == {3: 3, 5: 3, 7: 3, 9: 3, 11: 11}
    assert similar.near_copies(documents([])).count() == 0


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    common = np.sort(rng.choice(2**62, 40, replace=False).astype(np.uint64))
    ranks = rng.permutation(40) + 1
    for _ in range(500):
        n = int(rng.integers(1, 80))
        both = np.concatenate([rng.choice(common, min(n, 20), replace=False), rng.integers(0, 2**62, n).astype(np.uint64)])
        left = max(1, int(np.ceil(0.8 * len(both))))
        a, b = np.unique(both), np.unique(rng.choice(both, left, replace=False))
        if len(b) < 0.8 * len(a):
            continue
        shared = np.intersect1d(similar.prefix(a, common, ranks)[0], similar.prefix(b, common, ranks)[0])
        assert len(shared)


def test_bitmaps_never_part_similar_sets():
    rng = np.random.default_rng(9)
    passed = 0
    for _ in range(2000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.5, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        may = similar.may_be_similar(similar.bitmap(a), similar.bitmap(b), len(a), len(b))
        assert may or common < 0.8 * (len(a) + len(b) - common)
        passed += may
    assert 100 < passed < 1500


@pytest.mark.parametrize("k", [40, 160])
def test_near_copies_of_one_text_cost_links_not_pairs(documents, monkeypatch, k):
    """A group of k near copies, and another text that shares its half: the pairs looked at grow like k."""
    monkeypatch.setattr(similar, "RUN", 16)
    rng = random.Random(k)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(k)] + [(k, " ".join(base[:100] + [f"o{i}" for i in range(100)]))]
    docs = documents(rows)
    prints = similar.set_prints(docs, *similar._common(docs, k))
    assert similar.first_links(prints).count() <= similar.FIRST * k
    links = similar.verified(similar.first_links(prints), prints, docs)
    groups = similar.components(links).select("node", "component").withColumnRenamed("component", "group")
    grouped = prints.join(groups, "node", "left").selectExpr("node", "size", "bits", "firsts", "known", "coalesce(group, node) AS group")
    assert grouped.select("group").distinct().count() <= 2 + k // 20
    assert similar.candidates(grouped).count() <= 8 * k
    assert {r["component_id"] for r in similar.near_copies(docs).collect()} == {0, k}
