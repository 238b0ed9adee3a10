"""Language of texts and of their spans: per-word scores, and the cheapest path through the languages.

A word is a run of letters. Its score under a language sums the log frequencies of its letters' trigrams, word bounds
included; languages whose training text hardly uses the word's script are no candidates for it. Viterbi's
algorithm finds the labels of all words that score best when every change of language costs SWITCH.
Texts are cut into chunks that are solved for every language before them, side by side, and joined exactly
afterwards, so one long text costs no more than many short ones.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import remainder

BUCKETS, SMOOTHING = 1 << 17, 0.5
#: Documents per language that the model is fitted on at most (about).
SAMPLE_PER_LANGUAGE = 5_000
#: Cost of a change of language, in natural logarithms of likelihood.
SWITCH = 12.0
#: Share of a language's letters from which a script counts as one of its own.
SCRIPT_SHARE = 0.01
CHUNK = 256
UNKNOWN = "und"

# Code point ranges of scripts. Letters elsewhere are of script "other".
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter or a mark on one, and its script. Made once per worker."""
    letter = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), dtype=bool, count=0x110000)
    script = np.zeros(0x110000, dtype=np.int8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return letter, script


@dataclass(frozen=True)
class Words:
    """Words of a list of texts: per text the number of its words; per word its begin and end in its text, the script
    of its first letter, and where its trigrams begin."""

    per_text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray
    trigrams: np.ndarray


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def read_words(texts: list[str | None]) -> Words:
    """Words and trigram buckets of texts; a trigram per letter, with a bound before the first and after the last."""
    letter, script = _letters()
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    points = np.frombuffer("\n".join(_lower(t or "") for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.concatenate([[10], points, [10]]).astype(np.uint32)
    inside = letter[points]
    kept = np.where(inside, points, 0).astype(np.uint64)
    mixed = (kept[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (kept[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (kept[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(inside)
    trigrams = (mixed[at - 1] >> np.uint64(40)).astype(np.int64) % BUCKETS
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1
    text = np.searchsorted(offsets, begins, side="right") - 1
    return Words(
        np.bincount(text, minlength=len(texts)), begins - offsets[text], ends - offsets[text], script[points[begins]],
        np.cumsum(np.concatenate([[0], ends - begins]))[:-1], trigrams,
    )


@dataclass(frozen=True)
class Model:
    """Languages, log frequencies per trigram bucket and language, and which scripts each language uses."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """A row per word: its score under each language; hopeless ones where the script rules it out."""
        if not len(words.start):
            return np.zeros((0, len(self.languages)))
        scores = np.add.reduceat(self.logs[words.trigrams], words.first, axis=0).astype(np.float64)
        allowed = self.uses[:, words.script].T
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, scores - 1e6)


def best_labels(scores: np.ndarray, per_text: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of every word: per text, the sequence of most score less `switch` for every change."""
    k = scores.shape[1]
    firsts, lengths, texts = [], [], []
    at = 0
    for text, n in enumerate(per_text.tolist()):
        for a in range(0, n, CHUNK):
            firsts.append(at + a)
            lengths.append(min(CHUNK, n - a))
            texts.append(text)
        at += n
    if not firsts:
        return np.zeros(0, dtype=np.int64)
    first, length = np.array(firsts), np.array(lengths)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    running = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # chunks that have a word there
    value = np.full((len(first), k, k), -1e18)  # chunk, language before it, language now
    value[:, np.arange(k), np.arange(k)] = 0.0
    back = []
    for step, n in enumerate(running.tolist()):
        now = value[:n]
        best = now.argmax(axis=2)
        change = np.take_along_axis(now, best[:, :, None], axis=2) - switch
        stays = now >= change
        back.append(np.where(stays, np.arange(k), best[:, :, None]).astype(np.int16))
        value[:n] = np.where(stays, now, change) + scores[first[:n] + step][:, None, :]
    # Chunks of a text one after the other: the best language before each, given the one that it ends in.
    place = np.argsort(order)
    before, ends = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = i
        while j < len(texts) and texts[j] == texts[i]:
            j += 1
        total, froms = np.zeros(k), []
        for chunk in place[i:j]:
            sums = total[:, None] + value[chunk]
            froms.append(sums.argmax(axis=0))
            total = sums.max(axis=0)
        state = int(total.argmax())
        for chunk, source in zip(place[i:j][::-1], froms[::-1], strict=True):
            ends[chunk], before[chunk] = state, source[state]
            state = int(source[state])
        i = j
    labels = np.zeros(len(scores), dtype=np.int64)
    state = ends.copy()
    for step in range(len(running) - 1, -1, -1):
        n = running[step]
        labels[first[:n] + step] = state[:n]
        state[:n] = back[step][np.arange(n), before[:n], state[:n]]
    return labels


def train(documents: DataFrame) -> Model:
    """Fits the model on texts with a language whose crc32 of the id modulo 4 isn't 2, a bounded sample per language.

    At most BUCKETS rows per language reach the driver. Null texts and languages are left out.
    """
    known = documents.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(
        remainder(F.col("doc_id"), 4) != 2
    )
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    share = F.lit(0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], int(min(1, SAMPLE_PER_LANGUAGE / row["n"]) * (1 << 30))).otherwise(share)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + len(SCRIPT_NAMES), dtype=np.int64))
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, own in texts.items():
                words = read_words(own)
                counts[lang][:BUCKETS] += np.bincount(words.trigrams, minlength=BUCKETS)
                letters = words.end - words.start
                counts[lang][BUCKETS:] += np.bincount(words.script, letters, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(own[used])], schema=schema
            )

    rows = known.where(drawn < share).select("lang", "text")
    table = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    lang = np.array([number[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
    counts[lang, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    trigrams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log((trigrams + SMOOTHING) / (trigrams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray(logs.T.astype(np.float32)), uses)


def _texts_in_parts(column: pa.Array, most: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts in lists of bounded length in characters; a longer text is alone."""
    part, size = [], 0
    for text in column:
        text = text.as_py()
        if part and size + len(text or "") > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The language that most letters are labelled with, and its share of them; of equal ones the first by
    name. Texts without letters, and all texts if nothing was learned, give `und` with score 0. Rows that repeat a
    doc_id are labelled each; null ids are carried and count as learned from; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        k = max(1, len(of.languages))
        for batch in batches:
            names, scores = [], []
            for texts in _texts_in_parts(batch.column(2)):
                words = read_words(texts)
                if of.languages:
                    labels = best_labels(of.word_scores(words), words.per_text)
                    key = np.repeat(np.arange(len(texts)), words.per_text) * k + labels
                    letters = np.bincount(key, words.end - words.start, len(texts) * k).reshape(-1, k)
                else:
                    letters = np.zeros((len(texts), k))
                written_in = pc.match_substring_regex(pa.array(texts, type=pa.string()), r"\p{L}")  # not marks alone
                letters[~pc.fill_null(written_in, False).to_numpy(zero_copy_only=False).astype(bool)] = 0
                most, total = letters.argmax(axis=1), letters.sum(axis=1)
                names += [of.languages[m] if t else UNKNOWN for m, t in zip(most.tolist(), total.tolist(), strict=True)]
                scores += (letters.max(axis=1) / np.maximum(total, 1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())],
                schema=schema,
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text"
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_spans(documents: DataFrame, model: Model) -> DataFrame:
    """A row per span of one language: doc_id, start, length (code points of the text), lang, n_words.

    Spans reach from their first word's begin to their last word's end. Texts without letters have none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for texts in _texts_in_parts(batch.column(1)):
                own, done = ids[done : done + len(texts)], done + len(texts)
                words = read_words(texts)
                if not of.languages or not len(words.start):
                    continue
                labels = best_labels(of.word_scores(words), words.per_text)
                text = np.repeat(np.arange(len(texts)), words.per_text)
                new = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(labels, prepend=-1))
                last = np.concatenate([new[1:], [len(labels)]]) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([own[t] for t in text[new].tolist()], type=pa.int64()), pa.array(words.start[new]),
                    pa.array(words.end[last] - words.start[new]),
                    pa.array([of.languages[x] for x in labels[new].tolist()], type=pa.string()), pa.array(last - new + 1),
                ], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, lang string, n_words long")
