"""Encoder, packing, token files, token counts."""

import bisect
import json
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from headway.llm import packing, token_counts, token_files, tokenizing

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "the", "é", "\n", " ", "  ", "\t", "▁", "\r\n", "\x00", "<s>", "<0x0A>", "<|endoftext|>", "日本", "　", "\xa0",
    "'s", "12", ".", "!?", "ﬁ", "\x1c", "\x85", "😀", "1's", "²", "abc.", "x!,", "́",
]


def scraps(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(10))) for _ in range(n)]


def ids_of(text):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_encoder_equals_the_library():
    encode = tokenizing.encoder(BYTE_BPE)
    texts = [*scraps(4000, 1), None, "word " * 50_000 + "end"]
    ids, bounds = encode(pa.array(texts), 0)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == [*encode.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_of_another_kind_of_file():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, bounds = tokenizing.encoder(path)(pa.array(["Hello  World", None]), 7)
    assert ids.tolist() == [*Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids, 7, 7]
    assert bounds.tolist() == [0, len(ids) - 1, len(ids)]


def test_new_words_take_no_call_of_the_library_each(monkeypatch):
    """op5 took 411 CPU seconds a GB, most of them in one call for each word that wasn't kept."""
    monkeypatch.setattr(tokenizing, "MEMO_WORDS", 100)
    encode, calls = tokenizing.TextEncoder(BYTE_BPE), []
    library = encode.tokenizer

    class Counting:
        def encode(self, text, **options):
            calls.append(text)
            return library.encode(text, **options)

    encode.tokenizer = Counting()
    words = [f"{a}{b}{c}" for a in ("se", "Ör", "n1", "x-") for b in ("ta", "ne", "ß") for c in scraps(300, 3) if c.isalnum()]
    words = list(dict.fromkeys([*words, *(w + "." for w in words), *(f"w{i}" for i in range(2000))]))
    texts = [" ".join(words[a : a + 40]) for a in range(0, len(words), 40)]
    for _ in range(2):
        calls.clear()
        ids, bounds = encode(pa.array(texts), 0)
        assert len(calls) < len(words) / 20
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == ids_of(text).tolist()


def test_encoder_of_all_characters_beside_others():
    points = [c for c in [*range(1, 0x3100), *range(0xA640, 0xABFF, 3), *range(0x10000, 0x1F000, 41)]]
    texts = [
        " ".join(f"a{chr(c)} {chr(c)}. {chr(c)}b?! b{chr(c)},\nc{chr(c)}:" for c in points[a : a + 8])
        for a in range(0, len(points), 8)
    ]
    ids, bounds = tokenizing.encoder(BYTE_BPE)(pa.array(texts), 0)
    library = Tokenizer.from_file(BYTE_BPE)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text


def test_encoder_of_a_file_with_a_special_token_over_two_words(tmp_path):
    with open(BYTE_BPE, encoding="utf-8") as file:
        kind = json.load(file)
    kind["added_tokens"].append({**kind["added_tokens"][0], "id": 50_257, "content": "é1 ü1"})
    (tmp_path / "t.json").write_text(json.dumps(kind), encoding="utf-8")
    library, texts = Tokenizer.from_file(str(tmp_path / "t.json")), ["q é1", "q ü1", "q é1 ü1"]
    ids, bounds = tokenizing.TextEncoder(str(tmp_path / "t.json"))(pa.array(texts), 0)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_encoder_keeps_and_takes_little_memory():
    """Many distinct words, and one large batch of texts: both ran an executor out of memory that other stages had filled."""
    encode = tokenizing.TextEncoder(BYTE_BPE)
    texts = pa.array(["some plain words and then a few more of them " * 100] * 2500)
    tracemalloc.start()
    try:
        ids, _ = encode(texts, 0)
        assert tracemalloc.get_traced_memory()[1] < 2 * ids.nbytes + (15 << 20)
        del ids
        before, words = tracemalloc.get_traced_memory()[0], tokenizing._Words(lambda w: bytes(8))
        for i in range(800_000):
            words[f"word{i}"]
        assert tracemalloc.get_traced_memory()[0] - before < 80 << 20
    finally:
        tracemalloc.stop()


def test_places_start_no_python_workers_of_rows(documents, monkeypatch):
    docs = documents([(i, "a few words " * i) for i in range(40)])
    monkeypatch.setattr(type(docs.sparkSession.sparkContext), "parallelize", lambda *_, **__: pytest.fail("rows for Python workers"))
    rows = packing.pack_documents(docs, BYTE_BPE, 16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) > 40


def best_fit_decreasing(counts, limit):
    gaps, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(gaps, length)
            opened += at == len(gaps)
            gap = (gaps.pop(at) if at < len(gaps) else limit) - length
            if gap:
                bisect.insort(gaps, gap)
    return opened


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all_pieces_and_is_as_good_as_best_fit(seed):
    rng = random.Random(seed)
    counts = {length: rng.randrange(1, 40) for length in rng.sample(range(1, 257), 200)}
    left, total = dict(counts), 0
    for pattern, times in packing.plan(counts, 256):
        assert sum(pattern) <= 256 and times > 0
        total += times
        for length in pattern:
            left[length] -= times
    assert not any(left.values())
    assert total <= best_fit_decreasing(counts, 256)


def test_plan_fills_all_gaps_if_short_pieces_abound():
    counts = {**{length: 9 for length in range(100, 256, 5)}, **{length: 200 for length in range(1, 24)}}
    assert sum(times for _, times in packing.plan(counts, 256)) == -(-sum(k * n for k, n in counts.items()) // 256)


def test_plan_of_lengths_without_complements():
    plan = packing.plan({200: 5, 100: 3}, 256)
    assert sum(times for _, times in plan) == 7


@pytest.mark.parametrize("limit", [16, 2048])
def test_packing_of_messy_rows(messy, limit):
    rows = packing.pack_documents(messy, BYTE_BPE, limit, with_ids=True).collect()
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    found = sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows)
    want = []
    for _, text in docs:
        ids = ids_of(text).tolist()
        head = len(ids) % limit or limit
        want += [ids[:head], *(ids[a : a + limit] for a in range(head, len(ids), limit))]
    assert found == sorted(want)
    places = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] == len(r["ids"]) // 4
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit


@pytest.mark.parametrize("bits", [0, 1, 5, 13, 30, 59, 60])
def test_simple8b_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 70_000, dtype=np.uint64) if bits else np.zeros(70_000, dtype=np.uint64)
    for n in (0, 1, 239, 241, 1000, 65_536):
        assert np.array_equal(token_files.decode_block(token_files.encode_block(ids[:n]), n), ids[:n])


def test_file_round_trip_with_escapes(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rng = np.random.default_rng(2)
    writer, docs = token_files.Writer(), []
    for i in range(40):
        ids = rng.integers(0, 1 << int(rng.integers(1, 63)), int(rng.integers(0, 200)), dtype=np.uint64)
        ids[::7] = np.uint64((1 << 64) - 1)
        docs.append((None if i == 3 else i, ids))
        writer.add(*docs[-1])
    start = 0
    for (doc_id, at, got), (want_id, want) in zip(token_files.documents_of(writer.content()), docs, strict=True):
        assert (doc_id, at) == (want_id, start) and np.array_equal(got, want)
        start += len(want)
    with pytest.raises(ValueError, match="whole"):
        list(token_files.documents_of(writer.content()[:-1]))


def test_token_files_of_messy_rows(messy, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 1000)
    rows = token_files.encode_documents(messy, BYTE_BPE).collect()
    rows.sort(key=lambda r: r["start"])
    assert len(rows) == 13 and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))
    start, texts = 0, {}
    for r in messy.collect():
        texts.setdefault(r["doc_id"], set()).add(zlib.crc32(ids_of(r["text"]).tobytes()))
    for r in rows:
        assert r["start"] == start and r["ids_crc32"] in texts[r["doc_id"]]
        start += r["n_tokens"]


def test_pre_tokens_count_as_the_model_does():
    model, count = SentencePieceProcessor(model_file=PIECES), token_counts.counter(PIECES)
    for text in [*scraps(4000, 3), " ", "  a ", "a \n b", "\n\n", "▁▁"]:
        assert sum(map(count, token_counts.pre_tokens(text))) == len(model.encode(text)), repr(text)


@pytest.mark.parametrize("head", [0, 3, 1 << 19])
def test_token_counts_of_messy_rows(messy, monkeypatch, head):
    monkeypatch.setattr(token_counts, "HEAD", head)
    model = SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.count_tokens(messy, PIECES, limit=50).collect()
    want = sorted(
        (r["doc_id"] or -1, len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in messy.collect()
    )
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in rows)


def test_no_rows(documents):
    none = documents([])
    assert packing.pack_documents(none, BYTE_BPE).count() == 0
    assert token_files.encode_documents(none, BYTE_BPE).count() == 0
    assert token_counts.count_tokens(none, PIECES).count() == 0
