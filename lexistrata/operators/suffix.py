"""Suffix arrays: construction, longest common prefixes, substring and longest matches, Burrows-Wheeler order.

The array of a text is made in the task that holds the text, in O(n log n) steps of numpy and O(n) memory; nothing is shuffled."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that leave a task at a time.
ROWS = 1 << 16


def symbols(data: str | bytes) -> np.ndarray:
    """Code points of a text, bytes of a binary."""
    return np.frombuffer(data, np.uint8) if isinstance(data, bytes) else np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)


def sort_suffixes(data: str | bytes) -> np.ndarray:
    """Starts of all suffixes in order, the empty one first.

    Ranks of doubled prefixes, from as many symbols as fit one number on."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    kinds, codes = np.unique(symbols(data), return_inverse=True)
    bits = int(len(kinds)).bit_length()
    step = max(1, 62 // bits)
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(step, np.int64)])
    key = np.zeros(n + 1, np.int64)
    for i in range(step):
        key = (key << bits) | padded[i : i + n + 1] if i < len(padded) - n else key << bits
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if rank[order[-1]] == n or step > n:
            return order
        second = np.zeros(n + 1, np.int64)
        second[: n + 1 - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        step *= 2


def common_lengths(data: str | bytes, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it (0 for the first), in linear time: what a suffix has in
    common is at most one less than what the suffix a place to its left has."""
    codes, places = symbols(data).tolist(), order.tolist()
    n = len(codes)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n + 1)
    out, same = [0] * (n + 1), 0
    for i, r in enumerate(rank.tolist()):
        if r == 0:
            same = 0
            continue
        j = places[r - 1]
        while i + same < n and j + same < n and codes[i + same] == codes[j + same]:
            same += 1
        out[r] = same
        same -= same > 0
    return np.array(out, np.int64)


def _common(a: str | bytes, i: int, b: str | bytes, j: int) -> int:
    """Symbols that a from i on and b from j on begin with alike, in steps that grow."""
    n, step, most = 0, 32, min(len(a) - i, len(b) - j)
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            most = min(most, n + 2 * step + 1)
    return n


class SuffixArray:
    """A source with its sorted suffixes: matches by binary search, O(log n) comparisons for each."""

    #: Symbols that the first search compares; a match of them all is searched on among the suffixes that share it.
    FIRST = 32

    def __init__(self, data: str | bytes, raw: np.ndarray | None = None):
        self.data = data
        self.order = sort_suffixes(data) if raw is None else raw
        self._places = array("q", np.ascontiguousarray(self.order, np.int64).tobytes())

    @property
    def start(self) -> int:
        """The rank of the whole source: where its Burrows-Wheeler transform begins."""
        return int(np.flatnonzero(self.order == 0)[0])

    def bwt(self) -> str | bytes:
        """The symbol before each suffix but the whole one, in their order."""
        codes = symbols(self.data)[self.order[self.order > 0] - 1]
        return codes.tobytes() if isinstance(self.data, bytes) else codes.tobytes().decode("utf-32-le", "surrogatepass")

    def _range(self, pattern: str | bytes, low: int = 0, high: int | None = None) -> tuple[int, int]:
        """Ranks of the suffixes that begin with the pattern."""
        n, data = len(pattern), self.data
        high = len(self._places) if high is None else high
        low = bisect_left(self._places, pattern, low, high, key=lambda i: data[i : i + n])
        return low, bisect_right(self._places, pattern, low, high, key=lambda i: data[i : i + n])

    def positions(self, pattern: str | bytes) -> list[int]:
        """Every place of the pattern, in order of places; none for an empty one."""
        low, high = self._range(pattern) if pattern else (0, 0)
        return sorted(self._places[low:high])

    def longest(self, target: str | bytes, at: int) -> tuple[int, int]:
        """(a place, length) of the longest prefix of target[at:] in the source."""
        low, high, n = 0, len(self._places), self.FIRST
        while True:
            pattern = target[at : at + n]
            k = len(pattern)
            rank = bisect_left(self._places, pattern, low, high, key=lambda i: self.data[i : i + k])
            best = max(((_common(self.data, i, target, at), -i) for i in self._places[max(rank - 1, low) : min(rank + 1, high)]), default=(0, 0))
            if best[0] < n or k < n:
                return (-best[1], best[0]) if best[0] else (0, 0)
            low, high = self._range(pattern, low, high)
            n *= 4

    def longest_match(self, target: str | bytes, at: int) -> tuple[int, int] | None:
        """(start, length) of the longest prefix of target[at:] that is in the source, at its first place; None past the target's
        end."""
        if at > len(target):
            return None
        _, n = self.longest(target, at)
        if not n:
            return 0, 0
        low, high = self._range(target[at : at + n])
        return int(self.order[low:high].min()), n

    def seeds(self, target: str | bytes, least: int) -> np.ndarray:
        """Places of the target where a match longer than `least` can begin: the symbols from there on, as many as such a match has
        and fit one number, are in the source. All places are looked up at once."""
        source, codes = symbols(self.data), symbols(target)
        bits = 8 if isinstance(target, bytes) else 21
        n = min(least + 1, 62 // bits)

        def grams(x: np.ndarray) -> np.ndarray:
            out = np.zeros(max(0, len(x) - n + 1), np.int64)
            for i in range(n):
                out = (out << bits) | x[i : i + len(out)]
            return out

        found = np.isin(grams(codes), grams(source))
        return np.flatnonzero(found & (np.arange(len(found)) + least < len(codes)))

    def longest_nonmatch(self, target: str | bytes, at: int, least: int, seeds: np.ndarray | None = None) -> tuple[int, int, int]:
        """(length without a match longer than `least`, place and length of the match after it, 0 where there is none)."""
        seeds = self.seeds(target, least) if seeds is None else seeds
        for k in range(int(np.searchsorted(seeds, at)), len(seeds)):
            i = int(seeds[k])
            _, n = self.longest(target, i)
            if n > least:
                low, high = self._range(target[i : i + n])
                return i - at, int(self.order[low:high].min()), n
        return len(target) - at, 0, 0


def _slices(b: pa.RecordBatch, made: Iterator[tuple[np.ndarray, ...]], names: list[str], out: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Row i's columns, its id before them, ROWS at a time."""
    for i, columns in enumerate(made):
        for at in range(0, len(columns[0]), ROWS):
            part = [c[at : at + ROWS] for c in columns]
            ids = b.column(0).take(pa.array(np.full(len(part[0]), i)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(part, out, strict=True))], ["id", *names])


def _per_text(df: DataFrame, id_col: str, text_col: str, columns, schema: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.char_length("text") > 0)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _slices(b, map(columns, b.column(1).to_pylist()), names, [pa.int32()] * len(names))

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}")


def suffix_ranks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, rank (from 0), pos for every suffix, the empty one included; rows with empty or null texts give none."""

    def columns(text: str) -> tuple[np.ndarray, ...]:
        order = sort_suffixes(text)
        return np.arange(len(order)), order

    return _per_text(df, id_col, text_col, columns, "rank int, pos int")


def lcp(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, rank, pos, lcp with the suffix before it (0 at rank 0)."""

    def columns(text: str) -> tuple[np.ndarray, ...]:
        order = sort_suffixes(text)
        return np.arange(len(order)), order, common_lengths(text, order)

    return _per_text(df, id_col, text_col, columns, "rank int, pos int, lcp int")


def bwt(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start, bwt: the rank of the whole text, and the symbols before all other suffixes in their order."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.char_length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [SuffixArray(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.start for a in made], pa.int32()), pa.array([a.bwt() for a in made], pa.string())], ["id", "start", "bwt"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start int, bwt string")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _positions(text: pd.Series, pattern: pd.Series) -> pd.Series:
    def of(t: str | None, p: str | None) -> list[int] | None:
        if t is None or p is None:
            return None
        found, at = [], t.find(p) if p else -1
        while at >= 0:
            found.append(at)
            at = t.find(p, at + 1)
        return found

    return pd.Series([of(t, p) for t, p in zip(text, pattern, strict=True)])


def all_positions(text: Column, pattern: Column) -> Column:
    """Every position (from 0) where the whole pattern occurs, overlaps included; none for an empty pattern.

    A scan in Arrow batches: expressions reach a place in UTF-8 text only from its begin, which makes them quadratic."""
    return _positions(text, pattern)


def matches(pairs: DataFrame, source: str, target: str, start: int, least: int | None = None) -> DataFrame:
    """pairs with nonmatch, start and length: the longest prefix of target[start:] that the source has, at its first place there.

    With `least`, what has no match longer than it is skipped first; nonmatch says how much. Without, nonmatch is 0, and all three
    are null past the target's end. A null text gives nulls."""

    def of(s: str | None, t: str | None) -> tuple[int, int, int] | tuple[None, None, None]:
        if s is None or t is None or start > len(t):
            return None, None, None
        own = SuffixArray(s)
        return own.longest_nonmatch(t, start, least) if least is not None else (0, *own.longest_match(t, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [of(s, t) for s, t in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            cols = [pa.array(c, pa.int32()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], [*b.schema.names[:-2], "nonmatch", "start", "length"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.select("*", F.col(source).cast("string").alias("_s"), F.col(target).cast("string").alias("_t")).mapInArrow(run, f"{kinds}, nonmatch int, start int, length int")
