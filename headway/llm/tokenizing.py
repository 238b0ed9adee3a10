"""Token ids of whole texts with the tokenizers library, each common word encoded once per worker."""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words kept per worker and the longest of them: about 60 MB, with no larger table than they need. Others are encoded
#: each time.
MEMO_WORDS, MEMO_CHARS = 340_000, 40
#: Words that the library gets as one text, as a call has its own cost.
TOGETHER = 50
#: Bytes of text that are encoded at once, which takes some ten times as much memory; a longer text is alone.
AT_ONCE = 2 << 20

# White space other than single spaces and line feeds between words; pieces may reach over it.
_IRREGULAR = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z"
    r"|[\t\r\v\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# A space and a line feed as byte-level files write them.
_LEADING = ("\u0120", "\u010a")

# Punctuation that stands in a piece of its own after a letter or digit.
_MARKS = ".,;:!?"


class _Words(dict):
    """Ids, as bytes, of a word after a space, or of a word with the line feed before it.

    `encode` gives the ids of one text, `letters` those of a word of ASCII letters after a space and `together` those
    of each of several texts that begin with a space or a line feed.
    """

    def __init__(self, encode, letters=None, together=None, most=None):
        super().__init__()
        self.encode, self.marks, self.most = encode, {}, MEMO_WORDS if most is None else most
        self.letters = letters or (lambda word: encode(" " + word))
        self.together = together or (lambda texts: map(encode, texts))

    def __missing__(self, word: str) -> bytes:
        return self._keep(word, self.encode(_led(word)))

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self) < self.most and len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Of those that aren't kept yet, long ones and letters are encoded alone."""
        found = list(map(self.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new, others = dict.fromkeys(words[i] for i in missing), []
        for word in new:
            if len(word) > MEMO_CHARS:
                new[word] = self[word]
            elif word.isascii() and word.isalpha():
                new[word] = self._keep(word, self.letters(word))
            else:
                others.append(word)
        for a in range(0, len(others), TOGETHER):
            group = others[a : a + TOGETHER]
            for word, ids in zip(group, self.together([_led(w) for w in group]), strict=True):
                new[word] = self._keep(word, ids)
        for i in missing:
            found[i] = new[words[i]]
        return found

    def of_marks(self, marks: str) -> bytes:
        """The ids of punctuation in a piece of its own."""
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self.encode(marks)
        return self.marks[marks]


def _led(word: str) -> str:
    return word if word[:1] == "\n" else " " + word


class TextEncoder:
    """Ids of texts, equal to what the library gives for each whole text.

    A byte-level BPE file cuts texts before its merges, among others before each single space and around
    each single line feed between words. So the distinct words of a batch of such texts are encoded once each, and the
    texts' ids gathered from theirs. Texts with other white space or with a special token's string, and all
    texts under other kinds of files, go to the library whole.
    """

    def __init__(self, path: str, memo_words: int | None = None, at_once: int | None = None):
        self.at_once = at_once or AT_ONCE
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before = kind.get("pre_tokenizer") or {}
        self.by_word = (
            kind["model"]["type"] == "BPE" and kind.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        special = kind.get("added_tokens", [])
        self.irregular = "|".join([_IRREGULAR, *(re.escape(t["content"]) for t in special)])
        # Tokens that begin with a space or a line feed, by id: in words put together, each has one such token, its first.
        vocabulary = kind["model"]["vocab"] if self.by_word else {}
        self.leading = np.zeros(max([*vocabulary.values(), *(t["id"] for t in special)], default=0) + 1, dtype=bool)
        self.leading[[i for token, i in vocabulary.items() if token[:1] in _LEADING]] = True
        # A special token that has white space may come about by putting words together.
        apart = any(c.isspace() for t in special for c in t["content"])
        self.model = self.tokenizer.model
        self.words = _Words(
            self.whole, self._letters if self.by_word else None, None if apart else self._together, memo_words
        )
        self.words[""] = b""
        # Texts are read with a line feed before them, whose ids are left out again.
        self.lead = len(self.whole("\n")) // 4

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """The ids of a word of ASCII letters after a space: one piece, whose bytes the file writes as they are."""
        ids = [token.id for token in self.model.tokenize(_LEADING[0] + word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words that each begin with a space or a line feed."""
        ids = np.array(self.tokenizer.encode("".join(words), add_special_tokens=False).ids, dtype="<u4")
        firsts = np.flatnonzero(self.leading[ids])
        if len(firsts) != len(words) or firsts[0]:
            return [self.whole(w) for w in words]
        content, bounds = ids.tobytes(), [*(4 * firsts).tolist(), 4 * len(ids)]
        return [content[a:b] for a, b in pairwise(bounds)]

    def _known(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words. Marks after a letter or digit are taken off, so that a word is encoded once."""
        stems = pc.ascii_rtrim(words, characters=_MARKS)
        cut = pc.and_(pc.not_equal(stems, words), pc.utf8_is_alnum(pc.utf8_slice_codeunits(stems, -1)))
        heads = pc.if_else(cut, stems, words).to_numpy(zero_copy_only=False).tolist()
        known = self.words.of(heads)
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist()
        for i, word in zip(at, words.filter(cut).to_numpy(zero_copy_only=False), strict=True):
            known[i] += self.words.of_marks(word[len(heads[i]) :])
        return known

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text's begin (and the last's end).

        A null text counts as empty.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ids, bounds, a = [], [np.zeros(1, dtype=np.int64)], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + self.at_once, side="right")))
            own, own_bounds = self._encode(texts.slice(a, b - a), end)
            ids.append(own)
            bounds.append(own_bounds[1:] + bounds[-1][-1])
            a = b
        return np.concatenate(ids) if ids else np.zeros(0, dtype="<u4"), np.concatenate(bounds)

    def _encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        by_word = pc.invert(pc.match_substring_regex(texts, self.irregular)) if self.by_word else pa.array([False] * n)
        by_word = pc.and_(by_word, pc.not_equal(texts, "")).to_numpy(zero_copy_only=False).astype(bool)
        split = pc.split_pattern(
            pc.replace_substring(pc.binary_join_element_wise("", texts.filter(pa.array(by_word)), "\n"), "\n", " \n"), " "
        ) if by_word.any() else pa.array([], type=pa.list_(pa.string()))
        # Every text's first part is empty, as it begins with a space: it stands for the text's end.
        coded = pc.list_flatten(split).dictionary_encode()
        known = self._known(coded.dictionary)
        whole = [
            self.whole(t) if t else b"" for t in texts.filter(pa.array(~by_word)).to_pylist()
        ]
        entries = [*known, *whole, np.array([end], dtype="<u4").tobytes()]
        flat = np.frombuffer(b"".join(entries), dtype="<u4")
        sizes = np.fromiter(map(len, entries), dtype=np.int32, count=len(entries)) // 4
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32)
        return _gather(flat, starts, sizes, self._order(split, coded, by_word, len(known), len(whole)), self.lead, n)

    @staticmethod
    def _order(split: pa.Array, coded: pa.Array, by_word: np.ndarray, known: int, whole: int) -> tuple:
        """Entries in the order of the texts, the texts' numbers of entries, and which entries lead a text."""
        offsets = split.offsets.to_numpy().astype(np.int64) if len(split) else np.zeros(1, dtype=np.int64)
        counts = np.ones(len(by_word), dtype=np.int64)
        counts[by_word] = np.diff(offsets) - 1
        ends = np.cumsum(counts + 1)
        order = np.full(int(ends[-1]) if len(ends) else 0, known + whole, dtype=np.int32)  # the end id, unless set below
        firsts = ends - counts - 1
        order[firsts[~by_word]] = known + np.arange(whole)
        if len(split):
            codes = coded.indices.to_numpy(zero_copy_only=False)
            keep = np.ones(len(codes), dtype=bool)
            keep[offsets[:-1]] = False
            at = np.arange(int(counts[by_word].sum())) + np.repeat(
                firsts[by_word] - np.cumsum(counts[by_word]) + counts[by_word], counts[by_word]
            )
            order[at] = codes[keep]
        return order, firsts, by_word


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: tuple, lead: int, n: int) -> tuple:
    """The ids of the entries in order, without those that lead texts, and the texts' bounds."""
    entries, firsts, by_word = order
    begin, length = starts[entries], sizes[entries]
    begin[firsts[by_word]] += lead
    length[firsts[by_word]] -= lead
    ends = np.cumsum(length, dtype=np.int64)
    at = np.arange(int(ends[-1]) if n else 0)
    at += np.repeat(begin - ends + length, length)
    return flat[at], np.concatenate([(ends - length)[firsts], ends[-1:] if n else [0]]).astype(np.int64)


@lru_cache(maxsize=1)
def encoder(path: str, memo_words: int | None = None, at_once: int | None = None) -> TextEncoder:
    """The worker process's encoder, kept until one of another file or size is asked for."""
    return TextEncoder(path, memo_words, at_once)
