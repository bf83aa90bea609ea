"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import KEPT, durable, mapped, small_batches, texts_of
from lexistrata.llm.words import BYTE_LEVEL, IdCache

#: Distinct words whose ids a worker keeps.
CACHE = 400_000
#: New words that go to the library as one text.
JOINED = 256
#: Pieces that are packed together: enough for tight bins, few enough for one task.
SHARD = 131_072
#: Most pieces that a task holds, should a shard be larger than planned.
HELD = 262_144


class WordIds:
    """Ids of texts as the tokenizer file gives them through the library with add_special_tokens=False; each distinct word goes
    through it once. A text that holds an added token's string, which the library makes that token's id, is encoded whole, unless
    such strings are to be plain text."""

    def __init__(self, path: str, added_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        added = () if added_as_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # each character of a token stands for a byte
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.cache = IdCache(BYTE_LEVEL, self._encode, CACHE, lambda text: self._ids([text])[0], added)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and their numbers. A blank and letters are always a word of their own, so such
        words go to the library many at a time; the bytes that tokens stand for show where each one's ids end."""
        plain = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool, len(words))
        joined = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        flat, counts = self._ids(["".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)])
        ends = np.concatenate([[0], np.cumsum(self.token_bytes[flat])])
        stops = np.searchsorted(ends, np.cumsum(np.fromiter((len(w.encode()) for w in joined), np.int64, len(joined))))
        others, other_counts = self._ids([w for w, p in zip(words, plain.tolist(), strict=True) if not p])
        sizes = np.empty(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(stops, prepend=0), other_counts
        out = np.empty(len(flat) + len(others), np.int32)
        of_plain = np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = flat, others
        return out, sizes

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache(texts)


@lru_cache(2)
def word_ids(path: str, added_as_text: bool) -> WordIds:
    return WordIds(path, added_as_text)


KEPT["packing"] = word_ids.cache_clear


def tokenized_pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added_as_text: bool = False) -> DataFrame:
    """Each text's ids by the tokenizer file `path`, then end_id, cut into pieces of `capacity` ids at most.

    Columns: id_col, row_key long (one number for each input row, also where ids repeat or are null), piece int (from 0), start
    long, length long, ids binary (little-endian unsigned 32-bit). Only what is longer than the capacity is cut; the first piece
    may be shorter, all others are full. Nothing is shuffled; row_key is the row's partition and place in it, so write this
    table before it is read twice.

    Defined results: a null or empty text has one piece that holds end_id alone; strings of the file's added tokens become
    these tokens' ids, as the library has it, or plain text with added_as_text; null and repeated ids are kept; an empty table
    gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, added_as_text)
        done = TaskContext.get().partitionId() << 40
        for b in small_batches(batches, 256):
            rows, pieces, starts, lengths, data = [], [], [], [], []
            for row, ids in enumerate(encode(texts_of(b.column(1)))):
                ids = np.append(ids, end_id).astype("<u4")
                at, n, piece = 0, len(ids) % capacity or capacity, 0
                while at < len(ids):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(n)
                    data.append(ids[at : at + n].tobytes())
                    at, n, piece = at + n, capacity, piece + 1
            keys = np.array(rows, np.int64) + done
            done += b.num_rows
            cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["_id", "row_key", "piece", "start", "length", "ids"])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return mapped(picked, run, f"_id {id_type}, row_key long, piece int, start long, length long, ids binary", "packing").withColumnRenamed("_id", id_col)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece.

    A bin takes the longest piece left, then always the longest that fits its gap. Then, as long as it helps, its smallest piece
    gives way to two unpacked ones that fill the widened gap more tightly. Pieces of a length are taken in their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    first = np.cumsum(counts) - counts
    stock = [order[a : a + n][::-1].tolist() for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
    fit = np.maximum.accumulate(np.where(counts > 0, np.arange(capacity + 1), 0))  # the longest length in stock up to each size

    def take(n: int) -> int:
        counts[n] -= 1
        if not counts[n]:
            fit[n : np.searchsorted(fit, n, "right")] = fit[n - 1]
        return stock[n].pop()

    def give_back(n: int, item: int) -> None:
        stock[n].append(item)
        counts[n] += 1
        if counts[n] == 1:
            fit[n : np.searchsorted(fit, n, "right")] = n

    number = 0
    while fit[capacity]:
        gap, held = capacity, []
        while gap and (n := int(fit[gap])):
            held.append((n, take(n)))
            gap -= n
        while gap and fit[capacity]:
            small, item = held[-1]  # each was the longest that fitted, so the last is the smallest
            space = gap + small
            longer = np.flatnonzero(counts[1:space]) + 1
            other = fit[space - longer]
            alone = (other == longer) & (counts[longer] == 1)
            other[alone] = fit[longer[alone] - 1]
            total = np.where(other > 0, longer + other, 0)
            if not len(total) or total.max() <= small:
                break
            best = len(total) - 1 - int(total[::-1].argmax())
            held.pop()
            for n in sorted((int(longer[best]), int(other[best])), reverse=True):
                held.append((n, take(n)))
            give_back(small, item)
            gap = space - int(total[best])
            held.sort(key=lambda x: -x[0])
        at = 0
        for n, item in held:
            bins[item], offsets[item] = number, at
            at += n
        number += 1
    return bins, offsets


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, used = TaskContext.get().partitionId() << 40, 0
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            bins, offsets = best_two_fit(t.column("length").to_numpy(), capacity)
            out = t.append_column("sequence_id", pa.array(bins + (shard + used))).append_column("offset", pa.array(offsets))
            used += int(bins.max()) + 1
            yield from out.to_batches(max_chunksize=10_000)

        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= HELD:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    return run


def pack(pieces: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("row_key", "piece")) -> DataFrame:
    """pieces (the key columns, length, more columns) with sequence_id long and offset long: its sequence and its place there.

    Pieces are dealt by a hash of the keys, which tell all pieces apart, into shards of about SHARD pieces, so one source, one
    long document or many rows without an id spread over all of them; each shard is packed by best_two_fit on its own and leaves
    few bins partly filled. A piece is a few numbers here: give pieces without their ids, and join them back where sequences are
    to be written (packed_sequences).

    The number of pieces is counted first, so pass a table that is cheap to read twice. Lengths must be 1 to capacity. An empty
    table gives no rows."""
    n = pieces.count()
    dealt = pieces.repartition(max(1, -(-n // SHARD)), *keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return mapped(dealt, _pack(capacity), f"{kinds}, sequence_id long, offset long")


def packed_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added_as_text: bool = False) -> DataFrame:
    """All documents packed: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces' descriptions are written to the shared folder; their ids are checksummed while they are made and not moved.
    Defined results are those of tokenized_pieces; rows that repeat an id are documents of their own."""
    made = tokenized_pieces(df, path, capacity, end_id, id_col, text_col, added_as_text)
    light = durable(made.select(id_col, "row_key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "packing-pieces")
    return pack(light, capacity).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<binary>): each sequence's pieces in order, from tokenized_pieces' table as it was written and
    pack's of it. Pieces meet by (row_key, piece), so rows without an id or with a repeated one are neither lost nor multiplied. A
    sequence holds `capacity` ids at most, so a group is bounded. No pieces give no rows."""
    at = placed.select("row_key", "piece", "sequence_id", "offset")
    both = pieces.select("row_key", "piece", "ids").join(at, ["row_key", "piece"])
    return both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).getField("ids").alias("ids"))
