"""Spelling variants: words of a corpus that differ by one code point from a much more frequent one.

Near words are found by search schemes over a bidirectional index of suffix ranks: of two words that differ by one
inserted, deleted or replaced code point, one half is the same in both. Each query matches one half exactly, up to the
word's delimiter, then turns round and extends across the other half, allowing one error. Words are dealt to shards by
their halves, so every shard holds all that its queries can find, and no shard grows with the vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import written

# Letters that words are runs of.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES, SLIP = 6, 5, 5, 199

#: Words that a task counts before it passes them on.
HELD_WORDS = 300_000
#: Rows of a shard on average, and rows of one half from which on it is split.
SHARD_ROWS, HALF_ROWS = 8192, 65_536
#: Queries that are searched at once.
QUERIES = 16_384
LANES = 32


# --- the vocabulary -----------------------------------------------------------------

def count_words(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                slip: int | None = SLIP) -> DataFrame:
    """word, n: the runs of letters of all texts, with A-Z in lower case, of some length and number of occurrences.

    With `slip`, a run loses one code point where the crc32 of `<doc_id>:<run>` is divisible by it, as a typist would
    slip; the place is the same number modulo the run's length. In a row without doc_id nothing slips. Null texts have
    no words.
    """
    pattern = f"[{LETTERS}]{{{max(1, least_length)},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        held: dict[str, int] = {}
        for batch in batches:
            texts = pc.ascii_lower(batch.column(1))
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = Counter(find(text.as_py() or ""))
                start = crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if slip and doc_id is not None:
                        h = crc32(word.encode(), start)
                        if not h % slip:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield _counts(held)
                    held = {}
        yield _counts(held)

    counted = documents.select("doc_id", "text").mapInArrow(run, "word string, n long")
    whole = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return whole.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
    )


# --- the index ------------------------------------------------------------------------

class Direction:
    """Ranks of the suffixes of delimited words, read in one direction.

    `symbols[i]` stands before the suffix of rank i. Delimiters, symbol 0, are ordered as the words that they begin, and
    the last one comes first, so that putting a symbol before the suffixes of an interval keeps their order.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, n_symbols: int):
        """Words in sorted order, as symbols from 1 on, one after the other."""
        n_words = len(starts) - 1
        text = np.insert(codes, starts[:-1], 0)
        text = np.append(text, 0)
        n = len(text)
        rank = text.astype(np.int64) + n_words
        rank[text == 0] = np.append(np.arange(1, n_words + 1), 0)
        step = 1
        while True:
            order = np.argsort(rank, kind="stable")
            ordered = rank[order]
            place = np.zeros(n, dtype=np.int64)
            place[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            if place[order[-1]] == n - 1:
                break
            rank = place * n + np.roll(place, -step)
            step *= 2
        symbols = text[order - 1]
        self.n_symbols = n_symbols
        blocks = n // LANES + 1
        padded = np.full(blocks * LANES, np.iinfo(np.uint16).max, dtype=np.uint16)
        padded[:n] = symbols
        self.symbols = symbols.astype(np.int64)
        self.lanes = padded.reshape(blocks, LANES)
        each = np.bincount(
            np.repeat(np.arange(blocks), LANES)[:n] * (n_symbols + 1) + self.symbols, minlength=blocks * (n_symbols + 1)
        ).reshape(blocks, n_symbols + 1)
        smaller = np.zeros((blocks, n_symbols + 2), dtype=np.int32)
        smaller[1:, 1:] = np.cumsum(np.cumsum(each[:-1], axis=0), axis=1)
        #: Symbols below each symbol ahead of each block.
        self.smaller = smaller
        #: First rank of the suffixes that begin with each symbol.
        self.first = np.append(0, np.cumsum(np.bincount(self.symbols, minlength=n_symbols + 1)))

    def counts(self, symbol: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the symbols ahead of a rank are below `symbol`, and how many are `symbol` or below."""
        block, lane = rank // LANES, rank % LANES
        rows, symbol16 = self.lanes[block], symbol.astype(np.uint16)[:, None]
        inside = np.arange(LANES) < lane[:, None]
        low = self.smaller[block, symbol] + np.count_nonzero((rows < symbol16) & inside, axis=1)
        high = self.smaller[block, symbol + 1] + np.count_nonzero((rows <= symbol16) & inside, axis=1)
        return low, high


class Intervals:
    """Intervals of equal size in both directions: the same matches, ranked by what follows and by what precedes them."""

    def __init__(self, ranks: tuple[np.ndarray, np.ndarray], size: np.ndarray):
        self.ranks, self.size = ranks, size

    def take(self, which: np.ndarray) -> Intervals:
        return Intervals((self.ranks[0][which], self.ranks[1][which]), self.size[which])

    @staticmethod
    def join(parts: list[Intervals]) -> Intervals:
        ranks = tuple(np.concatenate([p.ranks[d] for p in parts]) for d in (0, 1))
        return Intervals(ranks, np.concatenate([p.size for p in parts]))


class WordIndex:
    """A bidirectional index of distinct words; directions are 0, which puts symbols before a match, and 1, behind it."""

    def __init__(self, words: list[str], queries: list[str]):
        """Words in sorted order. `queries` only adds its letters to the alphabet."""
        self.alphabet = np.unique(np.concatenate([_points(words), _points(queries)]))
        codes, starts = self.encode(words)
        backward = [w[::-1] for w in words]
        backward.sort()
        self.directions = [Direction(c, s, len(self.alphabet)) for c, s in ((codes, starts), self.encode(backward))]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols one after the other, and where each word begins, and the end."""
        starts = np.append(0, np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))))
        return np.searchsorted(self.alphabet, _points(words)) + 1, starts

    def whole(self, n: int) -> Intervals:
        zero = np.zeros(n, dtype=np.int64)
        return Intervals((zero, zero), np.full(n, len(self.directions[0].symbols)))

    def extend(self, d: int, at: Intervals, symbol: np.ndarray) -> tuple[Intervals, np.ndarray]:
        """The matches with one symbol more in a direction, and which of the given ones still have any."""
        index = self.directions[d]
        lo, other = at.ranks[d], at.ranks[1 - d]
        alive = np.flatnonzero((at.size > 1) | (index.symbols[lo] == symbol))
        lo, other, size, symbol = lo[alive], other[alive], at.size[alive], symbol[alive]
        low0, high0 = index.counts(symbol, lo)
        low1, high1 = index.counts(symbol, lo + size)
        size = (high1 - low1) - (high0 - low0)
        some = size > 0
        near, far = index.first[symbol] + high0 - low0, other + low1 - low0
        ranks = (near, far) if d == 0 else (far, near)
        return Intervals(ranks, size).take(some), alive[some]

    def branches(self, d: int, at: Intervals) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an interval and a symbol, no delimiter, that extends it in a direction."""
        index = self.directions[d]
        span = len(index.symbols) + 1
        keys, back = np.unique(at.ranks[d] * span + at.size, return_inverse=True)
        lo, size = keys // span, keys % span
        many = size > index.n_symbols
        few = np.flatnonzero(~many)
        which = np.repeat(few, size[few])
        steps = np.arange(len(which)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        pairs = [which * span + index.symbols[lo[which] + steps]]
        letters = np.arange(1, index.n_symbols + 1)
        for part in np.array_split(np.flatnonzero(many), max(1, many.sum() // 512)):
            one, symbol = np.repeat(part, len(letters)), np.tile(letters, len(part))
            low0, high0 = index.counts(symbol, lo[one])
            low1, high1 = index.counts(symbol, lo[one] + size[one])
            some = high1 - low1 > high0 - low0
            pairs.append(one[some] * span + symbol[some])
        found = np.unique(np.concatenate(pairs))
        found = found[found % span > 0]
        owner, symbol = found // span, found % span
        begins = np.searchsorted(owner, np.arange(len(keys) + 1))
        n = (begins[1:] - begins[:-1])[back]
        state = np.repeat(np.arange(len(back)), n)
        steps = np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n)
        return state, symbol[begins[back[state]] + steps]

    def near(self, queries: list[str], exact_right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a word's place: words with the query's left half (or right) and one error in the other.

        Of several ways to read an error, as with doubled letters, the one furthest out is taken, so a pair comes once.
        """
        codes, starts = self.encode(queries)
        length = starts[1:] - starts[:-1]
        half = length // 2
        # The half that is matched exactly is read from the middle to the end, the other from the middle on as well.
        if exact_right:
            first, n_first, sign, inward, outward = starts[:-1] + half, length - half, 1, 1, 0
            other, n_other = starts[:-1] + half - 1, half
        else:
            first, n_first, sign, inward, outward = starts[:-1] + half - 1, half, -1, 0, 1
            other, n_other = starts[:-1] + half, length - half
        codes = np.append(codes, [0, 0])
        query = np.arange(len(queries))
        at = self.whole(len(queries))
        done: list[tuple[np.ndarray, Intervals]] = []
        step = 0
        while len(query):
            ended = n_first[query] == step
            at, left = self.extend(inward, at, np.where(ended, 0, codes[first[query] + sign * step]))
            query, ended = query[left], ended[left]
            done.append((query[ended], at.take(ended)))
            query, at = query[~ended], at.take(~ended)
            step += 1
        query, at = np.concatenate([q for q, _ in done]), Intervals.join([a for _, a in done])

        def read(query: np.ndarray, place: np.ndarray) -> np.ndarray:
            """The query's symbol at a place of its other half; 0 at its end."""
            return np.where(place < n_other[query], codes[other[query] - sign * place], 0)

        place, found = 0, []
        wrong, wrong_place, wrong_at = query[:0], query[:0], at.take(np.zeros(0, dtype=np.int64))
        while len(query) or len(wrong):
            # Ways with their error behind them go on exactly, to the delimiter.
            symbol = read(wrong, wrong_place)
            moved, left = self.extend(outward, wrong_at, symbol)
            ended = symbol[left] == 0
            found.append((wrong[left][ended], moved.ranks[0][ended] - 1))
            pools = [(wrong[left][~ended], wrong_place[left][~ended] + 1, moved.take(~ended))]
            if len(query):
                here = read(query, np.full(len(query), place))
                state, symbol = self.branches(outward, at)
                moved, left = self.extend(outward, at.take(state), symbol)
                state, symbol = state[left], symbol[left]
                same = symbol == here[state]
                differs, inside = np.flatnonzero(~same), here[state] > 0
                pools.append((query[state[differs]], np.full(len(differs), place), moved.take(differs)))  # inserted
                replaced = np.flatnonzero(~same & inside)
                pools.append((query[state[replaced]], np.full(len(replaced), place + 1), moved.take(replaced)))
                after = read(query, np.full(len(query), place + 1))
                deleted = np.flatnonzero((here > 0) & (after != here))
                pools.append((query[deleted], np.full(len(deleted), place + 1), at.take(deleted)))
                goes_on = np.flatnonzero(same)
                query, at = query[state[goes_on]], moved.take(goes_on)
                place += 1
            wrong, wrong_place = (np.concatenate([p[i] for p in pools]) for i in (0, 1))
            wrong_at = Intervals.join([p[2] for p in pools])
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")


# --- near words -------------------------------------------------------------------------

def _halves(word: Column) -> Column:
    """(side, half, asks): the halves under which a word is found, and those by which it asks.

    A query of m code points has halves of m // 2 and the rest; what it can find is one shorter or longer at most.
    """
    length, parts = F.length(word), []
    for more in (-1, 0, 1):
        left = F.floor((length + more) / 2).cast("int")
        right = length + more - left
        parts.append(F.struct(F.lit(0).alias("side"), F.left(word, left).alias("half"), (left == F.floor(length / 2)).alias("asks")))
        parts.append(F.struct(
            F.lit(1).alias("side"), F.right(word, right).alias("half"), (right == length - F.floor(length / 2)).alias("asks")
        ))
    return F.array_distinct(F.array(*parts))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, near_n, near for each word that has any near one, from (word, n) with distinct words.

    `near` is the near word with the largest n, the smallest in code-point order among equals.
    """
    halves = written(vocabulary.select("word", "n", F.inline(_halves(F.col("word")))), "halves")
    shards = max(1, halves.count() // SHARD_ROWS)
    hot = written(halves.groupBy("side", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > HALF_ROWS).select(
        "side", "half", F.ceil(F.col("rows") / HALF_ROWS).cast("int").alias("parts")
    ), "hot-halves")
    # The rows of a very frequent half are cut in parts, and every part's queries meet every part.
    dealt = halves.join(hot, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    held = F.transform(others, lambda b: F.struct(own.alias("part"), b.alias("block"), F.lit(True).alias("held"), (F.col("asks") & (b == own)).alias("asks")))
    asked = F.transform(F.filter(others, lambda p: F.col("asks") & (p != own)), lambda p: F.struct(
        p.alias("part"), own.alias("block"), F.lit(False).alias("held"), F.lit(True).alias("asks")
    ))
    rows = dealt.select(
        F.when(F.col("parts") > 1, F.concat_ws(":", "side", "half"))
        .otherwise(F.pmod(F.xxhash64("side", "half"), F.lit(shards)).cast("string")).alias("shard"),
        "word", "n", "side", F.inline(F.concat(held, asked)),
    )

    def search(table: pa.Table) -> pa.Table:
        held = table.filter(table["held"])
        counts = dict(zip(held["word"].to_pylist(), held["n"].to_pylist(), strict=True))
        words = sorted(counts)
        n = np.fromiter((counts[w] for w in words), dtype=np.int64, count=len(words))
        asks = table.filter(table["asks"])
        sides, asking = asks["side"].to_numpy(), asks["word"].to_pylist()
        index, out = WordIndex(words, asking), []
        for side in (0, 1):
            mine = [asking[i] for i in np.flatnonzero(sides == side)]
            for start in range(0, len(mine), QUERIES):
                queries = mine[start : start + QUERIES]
                query, place = index.near(queries, bool(side))
                if side:  # those that also share the left half are found there
                    keep = [not words[w].startswith(queries[q][: len(queries[q]) // 2]) for q, w in zip(query, place, strict=True)]
                    query, place = query[keep], place[keep]
                order = np.lexsort((place, -n[place], query))
                query, place = query[order], place[order]
                begins = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else query
                many = np.diff(np.append(begins, len(query)))
                best = place[begins]
                out.append(pa.table({
                    "word": pa.array([queries[q] for q in query[begins]], pa.string()), "n_near": pa.array(many, pa.int64()),
                    "less": pa.array(-n[best], pa.int64()), "near": pa.array([words[w] for w in best], pa.string()),
                }))
        return pa.concat_tables(out) if out else _NEAR.empty_table()

    found = rows.groupBy("shard", "part", "block").applyInArrow(search, "word string, n_near long, less long, near string")
    best = F.min(F.struct("less", "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("near", pa.string())])


# --- forms and roots --------------------------------------------------------------------

def spelling_groups(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n from (word, n) with distinct words.

    A word's form is its most frequent near word if that is `times` as frequent at least, else null; its root is where
    its forms lead to, itself without one. Words without near words have n_near 0. Both are strings of the vocabulary.
    """
    vocabulary = written(vocabulary, "vocabulary")
    near = near_words(vocabulary)
    much = F.col("near_n") >= F.col("n") * times
    words = written(vocabulary.join(near, "word", "left").select(
        "word", F.when(much, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(much, F.col("near_n")).alias("form_n"),
    ), "words")
    # Frequencies grow along the forms, so ways are short; each round doubles the steps that are known.
    steps = written(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = written(steps.join(onward, "root", "left"), "steps")
        steps = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further IS NOT NULL").isEmpty():
            break
    return words.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
