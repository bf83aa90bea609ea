"""Deltas between texts or binaries: INSERT and MATCH operations, made on a suffix array, applied by expressions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexistrata.operators.suffix import SuffixArray

#: Matches up to this length are not worth an operation; they are taken into the INSERT before them.
SHORT_MATCH = 30
INSERT, MATCH = 0, 1
OPS = "array<struct<op:tinyint,start:int,length:int,data:binary>>"
_OP = T.StructType([T.StructField("op", T.ByteType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("data", T.BinaryType())])
_EVENT = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("op", T.StringType()), *_OP.fields[1:]])


def make(source: bytes, target: bytes, least: int = SHORT_MATCH) -> list[tuple[int, int, int, bytes | None]]:
    """(op, start, length, data) that turn the source into the target: from place to place what no match longer than `least`
    covers, then the match."""
    own = SuffixArray(source)
    seeds, at, ops = own.seeds(target, least), 0, []
    while at < len(target):
        non, start, n = own.longest_nonmatch(target, at, least, seeds)
        if non:
            ops.append((INSERT, 0, non, target[at : at + non]))
        if n:
            ops.append((MATCH, start, n, None))
        at += non + n
    return ops


def apply_ops(source: bytes, ops) -> bytes:
    return b"".join(o[3] if o[0] == INSERT else source[o[1] : o[1] + o[2]] for o in ops)


def encode(ops) -> bytes:
    """Little-endian records: tag, length and data of an INSERT; tag, start and length of a MATCH."""
    return b"".join(struct.pack("<BI", INSERT, o[2]) + o[3] if o[0] == INSERT else struct.pack("<BII", MATCH, o[1], o[2]) for o in ops)


def decode(data: bytes) -> list[tuple[int, int, int, bytes | None]]:
    at, ops = 0, []
    while at < len(data):
        if data[at] == INSERT:
            (n,) = struct.unpack_from("<I", data, at + 1)
            ops.append((INSERT, 0, n, data[at + 5 : at + 5 + n]))
            at += 5 + n
        elif data[at] == MATCH:
            ops.append((MATCH, *struct.unpack_from("<II", data, at + 1), None))
            at += 9
        else:
            raise ValueError("Invalid delta")
    return ops


_ARROW_OPS = pa.list_(pa.struct([("op", pa.int8()), ("start", pa.int32()), ("length", pa.int32()), ("data", pa.binary())]))


def make_deltas(pairs: DataFrame, source: str = "source", target: str = "target", least: int = SHORT_MATCH) -> DataFrame:
    """pairs (more columns, source, target as text or binary) with ops. One pair at a time in Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, t in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                out.append([{"op": o, "start": i, "length": n, "data": d} for o, i, n, d in make(s or b"", t or b"", least)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, _ARROW_OPS)], [*b.schema.names[:-2], "ops"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    binary = pairs.select("*", F.col(source).cast("binary").alias("_s"), F.col(target).cast("binary").alias("_t"))
    return binary.mapInArrow(run, f"{kinds}, ops {OPS}")


@F.pandas_udf(T.BinaryType())
def encode_ops(ops: pd.Series) -> pd.Series:
    """Operations as one binary."""
    return pd.Series([None if x is None else encode([(o["op"], o["start"], o["length"], o["data"]) for o in x]) for x in ops])


@F.pandas_udf(T.ArrayType(_OP))
def decode_ops(data: pd.Series) -> pd.Series:
    """Operations of a binary."""
    return pd.Series([None if x is None else [{"op": o, "start": i, "length": n, "data": d} for o, i, n, d in decode(x)] for x in data])


@F.udtf(returnType=_EVENT)
class Events:
    """The events of a binary delta, one row each, for SQL and lateral joins: register it and select from it."""

    def eval(self, data: bytes):
        for n, (op, start, length, inserted) in enumerate(decode(bytes(data)) if data is not None else []):
            yield n, "MATCH" if op == MATCH else "INSERT", start, length, inserted


def apply_deltas(source: Column, ops: Column) -> Column:
    """The target's bytes, by expressions only."""
    empty = F.lit("").cast("binary")
    return F.aggregate(ops, empty, lambda acc, o: F.concat(acc, F.when(o["op"] == MATCH, F.substr(source.cast("binary"), o["start"] + 1, o["length"])).otherwise(F.coalesce(o["data"], empty))))


def delta_stats(ops: Column) -> Column:
    """struct(match_count, match_total, insert_count, insert_total)."""

    def of(kind: int, total: bool) -> Column:
        some = F.filter(ops, lambda o: o["op"] == kind)
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, o: a + o["length"]) if total else F.size(some).cast("long")

    return F.struct(of(MATCH, False).alias("match_count"), of(MATCH, True).alias("match_total"), of(INSERT, False).alias("insert_count"), of(INSERT, True).alias("insert_total"))


def no_change(source: Column, target: Column, ops: Column) -> Column:
    """Same length, one MATCH of everything, no INSERT."""
    first = F.get(ops, 0)
    whole = (first["op"] == MATCH) & (first["start"] == 0) & (first["length"] == F.octet_length(source))
    return (F.octet_length(source) == F.octet_length(target)) & (F.size(ops) == 1) & whole
