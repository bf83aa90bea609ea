"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexistrata.sources.storage import spread
from lexistrata.sources.storage import materialized as durable  # the one helper, under the name that operators here use

#: The white space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data directory, by any path that Spark can read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


#: Bytes of an Arrow batch at most, where the session leaves Spark's own bound of 64 MB.
BATCH_BYTES, _SPARKS = 8 << 20, "67108864b"


#: What a worker keeps from task to task, by the operator that it is for: how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str = "") -> DataFrame:
    """df.mapInArrow, with batches small enough for several tasks beside each other: long texts would make those of 10,000 rows as
    large as Spark's bound, in the JVM and in the worker. Sets the session's bound, unless it is another than Spark's own. A worker
    lives on for other tasks, so it lets go of what it kept for another operator than `keeps`, and at a task's end gives back
    what it no longer needs."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(keeps)
        yield from run(batches)
        _give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == _SPARKS:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(lean, schema)


def _let_go(keeps: str) -> None:
    for name, drop in KEPT.items():
        if name != keeps:
            drop()


def _give_back() -> None:
    """Freed memory that the worker's allocators keep goes to the system, where they can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def stripped(text: Column) -> Column:
    """text without any character of SPACES (JVM-side)."""
    for ch in SPACES:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def texts_of(column: pa.Array) -> list[str]:
    """A batch's texts; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that working memory does not follow Arrow's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
