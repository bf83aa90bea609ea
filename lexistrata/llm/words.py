"""Ids of texts through a cache of the words that a tokenizer's pattern makes of them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex

from lexistrata.llm.common import ragged

#: Distinct words whose ids a worker keeps, the first that it meets; words beyond are forgotten after their batch.
CACHE = 300_000
#: A text longer than this is matched block by block, with so many words held at a time.
LONG_TEXT, BLOCK = 2_000_000, 500_000
#: The split of byte-level tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of characters below this one are matched by the standard library's engine, with the classes spelled out.
LATIN_END = 0x250

Encoded = tuple[np.ndarray, np.ndarray]  # ids one after the other, number of ids of each word


@lru_cache(1)
def _latin() -> tuple[re.Pattern, re.Pattern]:
    """BYTE_LEVEL for Latin texts, and a search for any other character. Letters and numbers come first as no other
    alternative can match where they do."""

    def spelled(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(LATIN_END) if regex.match(kind, chr(c)))

    letter, number, space = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    words = f" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(words), re.compile(f"[^\\u0000-\\u{LATIN_END - 1:04x}]")


@lru_cache(1)
def _unsettled() -> re.Pattern:
    """A search for characters that Unicode tables of different years may class differently: all but those of the basic plane that
    have the same category in Unicode 3.2 as now."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    settled = [c for c in range(0x10000) if old(chr(c)) == now(chr(c)) != "Cn"]
    cuts = [i for i in range(1, len(settled)) if settled[i] != settled[i - 1] + 1]
    runs = zip([0, *cuts], [*cuts, len(settled)], strict=True)
    return re.compile("[^" + "".join(f"\\u{settled[a]:04x}-\\u{settled[b - 1]:04x}" for a, b in runs) + "]")


class _Index(dict):
    """Numbers words as they come, and notes the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class IdCache:
    """Ids of texts, where encode_words gives the ids of distinct matches of the pattern; each goes through it once.

    Where encode_whole is given, texts with a character that engines of another Unicode version may class differently, and
    texts that hold one of the strings `kept_whole`, are not split here but given to it."""

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], Encoded], size: int | None = None, encode_whole: Callable[[str], np.ndarray] | None = None, kept_whole: tuple[str, ...] = ()):
        self.pattern, self.encode_words, self.size = regex.compile(pattern), encode_words, size or CACHE
        self.latin = _latin() if pattern == BYTE_LEVEL else None
        self.encode_whole, self.kept_whole = encode_whole, kept_whole
        self.index, self.over = _Index(), []
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _remember(self, new: list[str]) -> None:
        flat, counts = self.encode_words(new)
        a, b = len(self.index) - len(new), len(self.index)
        while b > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[a:b], self.lengths[a:b] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(flat)
        self.over.extend(new[max(0, self.size - a) :] if b > self.size else [])

    def _trim(self) -> None:
        """Forget the words beyond the size: they have the last numbers and the last ids."""
        for w in self.over:
            del self.index[w]
        if self.over:
            self.used = int(self.starts[self.size])
        self.over = []

    def _ids(self, words: Iterable[str], n: int) -> Encoded:
        self._trim()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, n)
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._remember(new)
        counts = self.lengths[at]
        return self.flat[ragged(self.starts[at], counts)], counts

    def _finder(self, text: str):
        return self.latin[0] if self.latin and not self.latin[1].search(text) else self.pattern

    def _is_whole(self, text: str) -> bool:
        if self.encode_whole is None:
            return False
        plain = self.latin is not None and not self.latin[1].search(text)
        return any(k in text for k in self.kept_whole) or (not plain and _unsettled().search(text) is not None)

    def _long(self, text: str) -> np.ndarray:
        matches = (m.group() for m in self._finder(text).finditer(text))
        ids = [np.empty(0, np.int32)]
        while words := list(islice(matches, BLOCK)):
            ids.append(self._ids(words, len(words))[0])
        return np.concatenate(ids)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        long = {i: self.encode_whole(t) for i, t in enumerate(texts) if self._is_whole(t)}
        long |= {i: self._long(t) for i, t in enumerate(texts) if len(t) > LONG_TEXT and i not in long}
        found = [[] if i in long else self._finder(t).findall(t) for i, t in enumerate(texts)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat, counts = self._ids(chain.from_iterable(found), int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [long[i] if i in long else flat[a:b] for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
