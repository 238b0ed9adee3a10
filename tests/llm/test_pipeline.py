"""The pipeline against a version in plain Python, and its stages on messy rows."""

import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from headway.llm import simhash, similar, toxicity
from headway.llm.decontaminate import Benchmark
from tests.llm.test_repeats import brute as repeats_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, documents, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]

    def text(n):
        return " ".join(rng.choice(words, n)) + "."

    item = text(30)
    shared = f"{text(40)} {text(30)}"
    rows = [(i, text(60)) for i in range(60)]
    rows += [(60 + i, f"{text(10)} insult {text(20)}") for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, f"{text(20)} {item} {text(20)}"), (103, None), (104, "")]
    rows += [(110 + i, " ".join([*rows[40 + i][1].split()[: 58 - i], "changed"])) for i in range(3)]  # near copies
    rows += [(105 + i, f"{text(20)}\n{shared}\n{text(15)}") for i in range(4)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(60 <= i < 100)) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(rows), labels, item


def brute(texts, labels, item):
    terms = toxicity.TermReader()
    taught = [(i, label) for i, _, label in labels if zlib.crc32(str(i).encode()) % 5]
    known = sorted(((label, terms(texts[i])) for i, label in taught), key=lambda x: (x[0], x[1].tobytes()))
    model = toxicity.fit([t for _, t in known], np.array([x for x, _ in known]), np.ones(len(known)))
    read = toxicity.TermReader(model.buckets)
    texts = {i: t for i, t in texts.items() if model.score(read(t)) < 0.5}
    kept = {}
    least = {i: i for i in texts}
    sets = {i: similar.shingle_set(t) for i, t in texts.items()}
    for _ in texts:
        for a, b in combinations(sorted(texts), 2):
            if similar.similar(sets[a], sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    kept = [(i, texts[i]) for i in sorted(texts) if least[i] == i]
    clean = dict(zip([i for i, _ in kept], repeats_brute([(i, t or "") for i, t in kept]), strict=True))
    clean = {i: texts[i] and t for i, t in clean.items()}
    index = Benchmark([(1, item)])
    return {i: t for i, t in clean.items() if not index.matches(t)}


def test_run_against_plain_python(spark, folder):
    place, texts, labels, item = folder
    want = brute(texts, labels, item)
    assert not {100, 101, 102} & set(want) and {103, 105} <= set(want) and len(want) < 70
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, place).collect()
    assert {
        (r["doc_id"], r["length"], r["ids_crc32"]) for r in pieces
    } == {
        (i, len(ids), zlib.crc32(ids.tobytes()))
        for i, ids in (
            (i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")) for i, t in want.items()
        )
    }


def test_stages_keep_the_columns_of_messy_rows(spark, folder, messy, documents):
    place, *_ = folder
    for docs in (messy, documents([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, place)
            assert docs.columns == messy.columns and [f.dataType for f in docs.schema] == [f.dataType for f in messy.schema]
        assert docs.count() >= 0


def test_near_duplicates_go_by_fingerprints_and_by_shingles(spark, documents, tmp_path):
    """1 and 2 have one fingerprint but few shingles in common, 5 and 6 nearly all shingles; 4 is like none."""
    many = "p q r " * 200
    texts = {1: many + "a b c d e", 2: many + "f g h i j k l m n o", 4: "alone in the world"}
    words = [f"w{i}" for i in range(60)]
    texts |= {5: " ".join(words), 6: " ".join([*words[:58], "x", "y"])}
    assert simhash.fingerprint(texts[1]) == simhash.fingerprint(texts[2])
    assert not similar.similar(similar.shingle_set(texts[1]), similar.shingle_set(texts[2]))
    assert (simhash.fingerprint(texts[5]) ^ simhash.fingerprint(texts[6])).bit_count() > 2
    docs = documents([*texts.items(), (None, texts[1])])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 4, 5, None]
