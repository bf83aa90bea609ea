"""Byte-level BPE encoding and decoding by rank files, in numpy."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import KEPT, mapped, ragged, small_batches, texts_of
from lexistrata.llm.words import IdCache

NONE = np.int32(np.iinfo(np.int32).max)
#: Widths of the padded matrices; a longer piece is merged with a heap, whose time follows length x log length.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 256, 384, 512, 768, 1024)
#: Numbers of a matrix at most.
CELLS = 1 << 22


class PairTable:
    """Rank of a pair of tokens, by an open-addressing hash table in two arrays; look-ups are vectorised."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 2  # the last number stands for padding and has no pairs
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = rank
        self.bits = max(4, (2 * len(pairs) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], slots[~put]
            taken = self.keys[slots] != keys
            slots = np.where(taken, (slots + 1) & ((1 << self.bits) - 1), slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) * self.n + right).ravel()
        slots = self._slot(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.ranks[slots], NONE)
        todo = np.flatnonzero((at != keys) & (at != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (at != -1)]
        return out.reshape(left.shape)


class Bpe:
    """A vocabulary with its encoder and decoder. Ids are ranks; a piece that is a token is that token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache = IdCache(pattern, self._encode_pieces)
        self._pairs: PairTable | None = None
        self.bytes_to_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths

    @property
    def pairs(self) -> PairTable:
        if self._pairs is None:
            self._pairs = PairTable(self.ranks)
        return self._pairs

    def merge_rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a padded matrix to the end: the rows' ids one after the other, and their lengths.

        A round merges each row's leftmost pair of least rank; the gap is closed at once, so the matrix loses a column a round,
        and rows without a pair leave it."""
        pairs, pad = self.pairs, self.pairs.n - 1
        out: list[np.ndarray | None] = [None] * len(tokens)
        rows = np.arange(len(tokens))
        ranks = pairs(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            width = tokens.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for row, ids in zip(rows[done].tolist(), tokens[done], strict=True):
                    out[row] = ids[ids != pad]
                go = ~done
                rows, tokens, ranks, at, best = rows[go], tokens[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            tokens[n, at] = best
            stay = np.ones(tokens.shape, bool)
            stay[n, at + 1] = False
            tokens = tokens[stay].reshape(len(rows), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[n, at] = False
            ranks = ranks[stay].reshape(len(rows), width - 2)
            left = at > 0
            if left.any():
                ranks[n[left], at[left] - 1] = pairs(tokens[n[left], at[left] - 1], best[left])
            right = at < width - 2
            if right.any():
                ranks[n[right], at[right]] = pairs(best[right], tokens[n[right], at[right] + 1])
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate(out) if out else np.empty(0, np.int32), lengths

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same ids for one long piece: pairs wait in a heap by (rank, place); stale entries are passed over."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)].tolist()
        size, ranks = len(ids), self.ranks
        begin, end = list(range(size)), list(range(1, size + 1))  # the bytes a token spans; a token lives at its first byte
        before = list(range(-1, size - 1))

        def pair(i: int) -> int | None:
            j = end[i]
            return ranks.get(piece[i : end[j]]) if j < size else None

        heap = [(r, i, end[i], end[end[i]]) for i in range(size - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, mid, stop = heapq.heappop(heap)
            if begin[i] != i or end[i] != mid or begin[mid] != mid or end[mid] != stop:
                continue
            ids[i], end[i], begin[mid] = r, stop, -1
            if stop < size:
                before[stop] = i
                if (r := pair(i)) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (b := before[i]) >= 0 and (r := pair(b)) is not None:
                heapq.heappush(heap, (r, b, i, stop))
        kept, i = [], 0
        while i < size:
            kept.append(ids[i])
            i = end[i]
        return np.array(kept, np.int32)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after the other, and each piece's number of ids."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, ids, lengths
        whole = np.fromiter((self.ranks.get(b, -1) for b in raw), np.int32, len(raw))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        known = np.flatnonzero(whole >= 0)
        done.append((known, whole[known], np.ones(len(known), np.int64)))
        least = 0
        for width in WIDTHS:
            places = np.flatnonzero((whole < 0) & (sizes > least) & (sizes <= width))
            least = width
            step = min(65_536, CELLS // width)
            for at in range(0, len(places), step):
                some = places[at : at + step]
                n = sizes[some]
                matrix = np.full((len(some), width), self.pairs.n - 1, np.int32)
                matrix[np.arange(width) < n[:, None]] = self.bytes_to_id[np.frombuffer(b"".join([raw[i] for i in some.tolist()]), np.uint8)]
                done.append((some, *self.merge_rows(matrix)))
        for i in np.flatnonzero((whole < 0) & (sizes > least)).tolist():
            ids = self.merge_long(raw[i])
            done.append((np.array([i]), ids, np.array([len(ids)])))
        places, flat, counts = (np.concatenate(x) for x in zip(*done, strict=True))
        starts = np.cumsum(counts) - counts
        order = np.argsort(places, kind="stable")
        return flat[ragged(starts[order], counts[order])], counts[order]

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's number of ids."""
        found = self.cache(list(texts))
        return np.concatenate([np.empty(0, np.int32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The texts' bytes, of ids one after the other and each text's number of ids."""
        counts = self.token_lengths[ids]
        flat = self.token_bytes[ragged(self.token_starts[ids], counts)].tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Bpe:
    """One for each file and worker process; the file is read where the worker runs."""
    return Bpe(path, pattern)


KEPT["bpe"] = vocabulary.cache_clear


def _list_batch(ids: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["_id", "_out"])


def bpe_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """One row per input row: id_col and the text's ids (array<int>), as a byte-level BPE with the rank file `path` gives them.

    The text is split by `pattern`; each match is merged on its own: always the leftmost pair of least rank. Special tokens are
    ordinary text. The distinct matches of a batch that the worker has not met before are merged together in padded matrices,
    one per length bucket, with hashed pair look-ups. Nothing is shuffled; memory is bounded by the batch, the caches of words
    (words.CACHE) and the longest text.

    Defined results: null and empty texts give an empty list; null and repeated ids are kept; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for b in small_batches(batches, 256):
            yield _list_batch(b.column(0), *bpe.encode(texts_of(b.column(1))))

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = mapped(picked, run, f"_id {id_type}, _out array<int>", "bpe")
    return out.select(F.col("_id").alias(id_col), F.col("_out").alias(out_col))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The input rows with the ids' bytes as one more column (binary): look-ups in the vocabulary's bytes, a batch at a time.

    Defined results: a null or empty list gives empty bytes; an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, "")
        for b in small_batches(batches, 128):
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = bpe.decode(flat, lengths)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "_out"])

    others = [F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)]
    kinds = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    picked = df.select(*others, F.col(ids_col).alias("_ids"))
    out = mapped(picked, run, f"{kinds}, _ids array<int>, _out binary", "bpe")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)], F.col("_out").alias(out_col))
