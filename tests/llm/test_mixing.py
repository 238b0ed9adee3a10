import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm.mixing import fit, mix_documents


def nearest(sizes, counts, budget):
    """The least distance of any choice from the budget, by trying all."""
    choices = itertools.product(*[range(c + 1) for c in counts])
    return min(abs(sum(s * k for s, k in zip(sizes, ks, strict=True)) - budget) for ks in choices)


@pytest.mark.parametrize("case", range(60))
def test_fit_against_all_choices(case):
    rnd = random.Random(case)
    sizes = rnd.sample(range(1, 60), rnd.randint(1, 5))
    counts = [rnd.randint(1, 4) for _ in sizes]
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    budget = rnd.randint(0, total)
    taken = fit(np.array(sizes), np.array(counts), float(budget), seed=case)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert abs(int((taken * sizes).sum()) - budget) == nearest(sizes, counts, budget)


def test_fit_of_long_documents_and_many():
    sizes, counts = np.array([40_000, 70_001, 3]), np.array([900, 300, 5])
    taken = fit(sizes, counts, 20_000_007.0)
    assert (taken <= counts).all() and abs(int((taken * sizes).sum()) - 20_000_007) < 20_000
    sizes = np.arange(1, 3000)
    counts = np.full(len(sizes), 7)
    for budget in (1.0, 12_345.0, 9_876_543.0, float((sizes * counts).sum())):
        taken = fit(sizes, counts, budget)
        assert (taken <= counts).all() and int((taken * sizes).sum()) == budget


def targets(sizes, weights=(3, 1, 2)):
    """Targets by sharing again and again; sizes in the order of their sources."""
    w = {i: weights[i % len(weights)] for i in range(len(sizes))}
    budget, given = Fraction(3, 2) * sum(sizes), {}
    while True:
        rest = [i for i in w if i not in given]
        level = (budget - sum(given.values())) / sum(w[i] for i in rest) if rest else 0
        over = [i for i in rest if level * w[i] > 2 * sizes[i]]
        if not over:
            return [float(given.get(i, level * w[i])) for i in range(len(sizes))]
        given |= {i: Fraction(2 * sizes[i]) for i in over}


def rows_of(rnd, sources):
    rows, n = [], 0
    for source in sources:
        for _ in range(rnd.randint(3, 40)):
            rows.append((n, " \n".join(["w"] * rnd.choice([1, 2, 3, 5, 8, 13, 40])), source))
            n += 1
    return rows


@pytest.mark.parametrize("case", range(4))
def test_targets_and_what_is_taken(spark, case):
    rnd = random.Random(case)
    sources = [None, "b", "a", "Z", "é", "𝄞", "ﬀ"][: 2 + 2 * case]
    rows = rows_of(rnd, sources)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    got = {r["doc_id"]: r for r in mix_documents(docs).collect()}
    assert set(got) == {r[0] for r in rows}
    ordered = sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])
    by_source = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in ordered}
    want = dict(zip(ordered, targets(list(by_source.values())), strict=True))
    for source in ordered:
        mine = [(got[r[0]], len(r[1].split())) for r in rows if r[2] == source]
        assert all(r["size"] == n and r["target"] == want[source] and r["source_size"] == by_source[source] for r, n in mine)
        assert all(r["taken"] in (0, n, 2 * n) for r, n in mine)
        assert abs(sum(r["taken"] for r, _ in mine) - want[source]) <= 3
    again = {r["doc_id"]: r["taken"] for r in mix_documents(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_nulls_ties_and_empty_tables(spark, documents, messy):
    got = mix_documents(messy).collect()
    assert len(got) == messy.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert [r["size"] for r in got if r["doc_id"] in (2, 3, 4)] == [0, 0, 0]
    assert mix_documents(documents([])).collect() == []
    empty = mix_documents(documents([(1, None), (2, "")])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in empty] == [(0, 0, 0.0, 0)] * 2


def test_one_length_of_one_source(spark):
    """All documents alike: the draw takes the number that is due, over all its parts."""
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source")
    )
    by = {r[0]: r[1:] for r in mix_documents(docs).groupBy("source_size").agg(F.sum("taken"), F.max("target")).collect()}
    assert by[3000] == (6000, 6000.0)
    assert abs(by[12000][0] - by[12000][1]) <= 1.5
