"""Toxicity of documents by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, hashed into BUCKETS; a document is the set of its terms.
The model adds to linear weights the product of two terms' factors for every pair, so that an insult
next to a group's name can weigh more than both alone. It is fitted on a bounded sample of labelled documents, drawn by
hash per class and weighted back to the classes' true sizes; whole texts are scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import keep_rows, remainder

BUCKETS = 1 << 20
#: Documents of each class that the model is fitted on at most (about), and of those, how many a term must be in.
SAMPLE_PER_CLASS, LEAST_DOCUMENTS = 6_000, 4
#: Different texts of one labelled id that are drawn at most.
TEXTS_PER_ID = 4
#: Standard errors by which a term's shares in the two classes differ at least if it is fitted before the others.
LEAST_DIFFERENCE = 5.0
#: Multiples of a slope's error by chance that weights and factors are shrunk by, and the first steps' damping.
DOUBT, FACTOR_DOUBT, STEADY = 3.0, 0.3, 1e-4
#: Lengths of the beginnings of words that are terms, too.
BEGINNINGS = (4, 5, 6)
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 12, 256, 0.05, 1e-4
_WORD = re.compile(r"\w+")
_HELD_WORDS = 200_000


@dataclass(frozen=True)
class Model:
    """Sorted buckets of the known terms with their weights and factors, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, places: np.ndarray) -> float:
        """Probability for a document with the known terms at these places."""
        factors = self.factors[places]
        total = factors.sum(axis=0)
        pairs = 0.5 * float(total @ total - np.einsum("ij,ij->", factors, factors))
        return float(_sigmoid(self.bias + float(self.weights[places].sum()) + pairs))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def hashed_terms(word: str) -> list[int]:
    """Buckets of a word and its beginnings."""
    terms = ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


class TermReader:
    """Sets of buckets of whole texts; a worker keeps the buckets of words it has seen, up to a bound."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = None if known is None else {int(b): i for i, b in enumerate(known)}
        self.held: dict[str, tuple[int, ...]] = {}

    def _terms(self, word: str) -> tuple[int, ...]:
        found = self.held.get(word)
        if found is None:
            found = tuple(hashed_terms(word))
            if self.known is not None:
                found = tuple(self.known[b] for b in found if b in self.known)
            if len(self.held) < _HELD_WORDS and len(word) <= 40:
                self.held[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """The text's buckets, or places of known buckets, ascending and each once."""
        terms: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            terms.update(self._terms(word))
        return np.array(sorted(terms), dtype=np.int64)


def _places(documents: list[np.ndarray], buckets: np.ndarray) -> list[np.ndarray]:
    """The places of the documents' terms among the buckets, without unknown ones."""
    places = []
    for terms in documents:
        at = np.searchsorted(buckets, terms)
        at[at == len(buckets)] = 0
        places.append((at[buckets[at] == terms] if len(buckets) else at[:0]).astype(np.int32))
    return places


def _descend(places: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float,
             rng: np.random.Generator, steady: float, noise: np.ndarray) -> float:
    """Adaptive steps on the weights and factors in place; gives the bias. `noise` is what each term's slope is shrunk by."""
    gw, gv = np.full(len(w), steady), np.full(v.shape, steady)
    for _ in range(EPOCHS):
        order = rng.permutation(len(places))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            sizes = np.array([len(places[i]) for i in batch])
            flat = np.concatenate([places[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            own = v[flat]
            total = np.zeros((len(batch), FACTORS))
            if len(flat):
                total[sizes > 0] = np.add.reduceat(own, (np.cumsum(sizes) - sizes)[sizes > 0], axis=0)
            squares = np.bincount(row, (own * own).sum(axis=1), len(batch))
            raw = bias + np.bincount(row, w[flat], len(batch)) + 0.5 * ((total * total).sum(axis=1) - squares)
            error = (_sigmoid(raw) - labels[batch]) * weights[batch] / len(batch)
            bias -= RATE * float(error.sum())
            if not len(flat):
                continue
            by = np.argsort(flat, kind="stable")
            begins = np.flatnonzero(np.diff(flat[by], prepend=-1))
            terms = flat[by[begins]]
            dw = np.add.reduceat(error[row][by], begins) + DECAY * w[terms]
            dv = np.add.reduceat((error[row][:, None] * (total[row] - own))[by], begins, axis=0) + DECAY * v[terms]
            gw[terms] += dw * dw
            gv[terms] += dv * dv
            w[terms] -= RATE * dw / np.sqrt(gw[terms])
            v[terms] -= RATE * dv / np.sqrt(gv[terms])
            if noise.any():
                w[:] = np.sign(w) * np.maximum(np.abs(w) - RATE / np.sqrt(gw) * DOUBT * noise, 0)
                norm = np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-9)
                v *= np.maximum(1 - RATE / np.sqrt(gv.mean(axis=1)) * FACTOR_DOUBT * noise / norm, 0)[:, None]
    return bias


def fit(documents: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """A factorization machine by weighted logistic loss and adaptive steps; documents are arrays of buckets.

    All terms of at least LEAST_DOCUMENTS documents have a weight and factors. Those whose shares differ between the
    classes are fitted first; then all are, shrunk by multiples of the error that chance gives a term's slope, so
    that one that is rare or tells something only beside another is learned, and one that tells nothing fades.
    """
    every, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *documents]), return_counts=True)
    toxic = np.concatenate([np.zeros(0, dtype=np.int64), *(d for d, label in zip(documents, labels, strict=True) if label)])
    in_toxic = np.bincount(np.searchsorted(every, toxic), minlength=len(every))
    n_toxic, n_clean = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    share = np.clip(counts / (n_toxic + n_clean), 1e-9, 1 - 1e-9)
    apart = in_toxic / n_toxic - (counts - in_toxic) / n_clean
    telling = np.abs(apart) >= LEAST_DIFFERENCE * np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    often = counts >= LEAST_DOCUMENTS
    buckets, first = every[often], np.flatnonzero(telling[often])
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), FACTORS))
    share = float(np.clip((weights * labels).sum() / max(weights.sum(), 1e-9), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    weights = weights / weights.mean() if len(weights) else weights
    first_w, first_v = w[first], v[first]
    bias = _descend(_places(documents, buckets[first]), labels, weights, first_w, first_v, bias, rng, 1e-6, np.zeros(len(first)))
    w[first], v[first] = first_w, first_v
    noise = np.sqrt(counts[often] * share * (1 - share)) / max(1, len(documents))
    bias = _descend(_places(documents, buckets), labels, weights, w, v, bias, rng, STEADY, noise)
    return Model(buckets, w.astype(np.float32), v.astype(np.float32), bias)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on labelled documents that aren't held out (crc32 of the id modulo 5 is not 0).

    Labels other than 0 and 1 and null ids are left out; an id labelled both ways is taken as toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id"), 5) != 0).groupBy(
        F.col("doc_id").alias("_id")
    ).agg(F.max("toxic").alias("_label"))
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30))
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("_label") == label, int(min(1, SAMPLE_PER_CLASS / n) * (1 << 30))).otherwise(share)
    # Bounded: the sample has about SAMPLE_PER_CLASS ids of each class, so the texts needn't be shuffled to find its own.
    ids = F.broadcast(known.where(drawn < share))
    read_from = documents.select("doc_id", "text", F.xxhash64("text").alias("_print"))
    # Of the different texts that an id may have, TEXTS_PER_ID are drawn; a text counts once.
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("_print"))
    prints = read_from.select("doc_id", "_print").join(ids, F.col("doc_id") == F.col("_id")).select("_id", "_print", "_label").distinct()
    drawn_texts = F.broadcast(prints.withColumn("_nth", nth).where(F.col("_nth") <= TEXTS_PER_ID).select(
        "_id", F.col("_print").alias("_drawn"), "_label"
    ))
    rows = read_from.join(
        drawn_texts, (F.col("doc_id") == F.col("_id")) & (F.col("_print") == F.col("_drawn"))
    ).dropDuplicates(["_id", "_print"])
    schema = pa.schema([("label", pa.int32()), ("terms", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermReader()
        for batch in batches:
            lists = [terms(t.as_py()).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(lists, type=schema.field(1).type)], schema=schema)

    sample = rows.select("_label", "text").mapInArrow(read, "label int, terms array<int>").toArrow()
    found = np.array(sample.column("label").to_pylist(), dtype=np.int64)
    lists = [np.array(t.values, dtype=np.int32) for t in sample.column("terms")]
    del sample
    # The order of rows that Spark gives isn't fixed; the fit's order is.
    order = sorted(range(len(lists)), key=lambda i: (int(found[i]), lists[i].tobytes()))
    found, lists = found[order], [lists[i] for i in order]
    weights = np.array([sizes[int(x)] / max(1, int((found == x).sum())) for x in found])
    return fit(lists, found, weights)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text counts. Null and empty texts have the score of a text without known terms. Null ids are held
    out. Rows that repeat a doc_id are scored each; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        terms = TermReader(of.buckets)
        for batch in batches:
            scores = [of.score(terms(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, type=pa.float64())], schema=schema)

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text"
    )
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with a score below 0.5, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def clean():
        of = shared.value
        terms = TermReader(of.buckets)
        return lambda text: of.score(terms(text)) < 0.5

    return keep_rows(documents, clean)
