import zlib
from pathlib import Path

import numpy as np
import pytest

from headway.llm import toxicity
from headway.llm.toxicity import Model, TermReader, drop_toxic, fit, score, train

FOLDER = "/root/testdata/sf0.01"
WORDS = [f"word{i}" for i in range(200)]


def texts(n, seed, kind):
    """`insult` and `group` are harmless alone and toxic together."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        own = list(rng.choice(WORDS, 12))
        insult, group = rng.random(2) < 0.5
        own += ["insult"] * bool(insult) + ["group"] * bool(group)
        rng.shuffle(own)
        rows.append((" ".join(own), int(insult and group) if kind == "pair" else int(insult)))
    return rows


def fitted(rows, **changes):
    read = TermReader()
    labels = np.array([label for _, label in rows])
    return fit([read(t) for t, _ in rows], labels, np.ones(len(rows)))


@pytest.mark.parametrize("kind", ["pair", "single"])
def test_interactions_are_learned(kind, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 40)
    model = fitted(texts(1500, 1, kind))
    read = TermReader(model.buckets)
    right = [(model.score(read(t)) >= 0.5) == bool(label) for t, label in texts(400, 2, kind)]
    assert np.mean(right) > 0.97


def test_pairs_need_factors(monkeypatch):
    """Whether two terms agree is beyond linear weights."""
    monkeypatch.setattr(toxicity, "EPOCHS", 60)
    monkeypatch.setattr(toxicity, "LEAST_DIFFERENCE", 0.0)
    rows = [(f"{a} {b}", int(a[0] == b[0])) for a in ("xa", "ya") for b in ("xb", "yb")] * 100
    model = fitted(rows)
    linear = Model(model.buckets, model.weights, np.zeros_like(model.factors), model.bias)
    read = TermReader(model.buckets)
    assert all((model.score(read(t)) >= 0.5) == bool(label) for t, label in rows)
    assert not all((linear.score(read(t)) >= 0.5) == bool(label) for t, label in rows)


def test_a_group_with_equal_shares_in_both_classes_is_learned():
    """Half of either class name the group; an insult is toxic beside it only, and a threat without it only."""
    rng = np.random.default_rng(11)

    def rows(n):
        for _ in range(n):
            group, insult = rng.random(2) < 0.5
            own = [*rng.choice(WORDS, 12), "insult" if insult else "threat", *["group"] * bool(group)]
            yield " ".join(own), int(insult == group)

    taught = list(rows(1500))
    model = fitted(taught)
    assert zlib.crc32(b"=group") % toxicity.BUCKETS in model.buckets
    read = TermReader(model.buckets)
    assert np.mean([(model.score(read(t)) >= 0.5) == bool(label) for t, label in rows(400)]) > 0.97


def test_insults_too_rare_for_a_marginal_test_are_learned():
    """Each of the rare insults is in 10 of 1000 toxic documents and in no clean one."""
    rng = np.random.default_rng(12)
    noise = [" ".join(rng.choice(WORDS, 12)) for _ in range(2000)]
    taught = [(f"{t} slur{'abcdefghij'[i // 10]}" if i < 100 else f"{t} insult", 1) for i, t in enumerate(noise[:1000])]
    model = fitted(taught + [(t, 0) for t in noise[1000:]])
    read = TermReader(model.buckets)
    found = [model.score(read(f"{' '.join(rng.choice(WORDS, 12))} slur{x}")) >= 0.5 for x in "abcdefghij" * 10]
    clean = [model.score(read(" ".join(rng.choice(WORDS, 12)))) < 0.5 for _ in range(100)]
    assert np.mean(found) > 0.9 and np.mean(clean) > 0.95


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = Model(np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)), 0.3)
    at = np.array([1, 4, 7])
    raw = 0.3 + model.weights[at].sum() + sum(model.factors[i] @ model.factors[j] for i in at for j in at if i < j)
    assert model.score(at) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_messy_rows_and_no_rows(spark, messy, documents):
    labels = spark.createDataFrame(
        [(1, 0, 1), (2, 1, 0), (7, 1, None), (5, 0, 2), (None, 1, 1), (8, 1, 0), (8, 1, 1), (999, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    model = train(messy, labels)
    rows = score(messy, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    kept = drop_toxic(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    nothing = train(documents([]), labels.limit(0))
    assert {r["predicted"] for r in score(messy, nothing).collect()} == {0}
    assert score(documents([]), model).count() == 0


def test_held_out_labels_do_not_teach(spark, documents):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 1, 1) for i in ids], "doc_id long, quality int, toxic int")
    assert len(train(documents([(i, "bad") for i in ids]), labels).buckets) == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not there")
def test_held_out_accuracy(spark, documents):
    table, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    documents([])
    found = score(table, train(table, labels)).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in found]) > 0.9


def test_an_id_with_very_many_rows_gives_few_texts(spark, documents, monkeypatch):
    """Two thousand rows of one labelled id, of different texts and of one, beside ids with a text each."""
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda lists, labels, weights: taken.append((len(lists), labels.tolist())))
    rows = [(1, f"text number {i} of one id") for i in range(2000)] + [(1, "the same")] * 2000
    rows += [(i, f"own text {i}") for i in range(2, 12)] + [(2, "own text 2")] * 50
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    toxicity.train(documents(rows), labels)
    known = [i for i in range(1, 12) if zlib.crc32(str(i).encode()) % 5]
    assert taken[0][0] == len(known) - 1 + toxicity.TEXTS_PER_ID * (1 in known) + (1 not in known)
