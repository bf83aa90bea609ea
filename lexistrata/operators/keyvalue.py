"""Hash and ordered key-value semantics over (key, value) DataFrames.

Writes are batches in which `seq` orders the records of a key; stores are immutable, so a put gives the new store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistrata.operators.ranking import ranged


def _last(df: DataFrame, first: bool) -> DataFrame:
    pick = F.min_by if first else F.max_by
    return df.groupBy("key").agg(pick("value", "seq").alias("value"))


def put_over(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's last value of a key replaces the stored one. Map-side aggregation leaves one row for each key and task."""
    new = _last(batch, False)
    return store.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new)


def put_keep(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored values stay; a new key gets the batch's first value."""
    new = _last(batch, True).join(store.select("key"), "key", "left_anti")
    return store.select("key", "value").unionByName(new)


def put_cat(store: DataFrame, batch: DataFrame, sep: str = "") -> DataFrame:
    """Values are appended to the stored one in the order of seq. A value is as long as what was written to its key."""
    rows = store.select("key", F.lit(None).cast("long").alias("seq"), "value").unionByName(batch.select("key", F.col("seq").cast("long").alias("seq"), "value"))
    return concatenated(rows, sep)


#: Records of a key that are sorted as one part.
PART = 4096


def _parts(rows: DataFrame, join) -> DataFrame:
    """key, and what `join` makes of the key's values in the order of seq (nulls first): parts of PART numbers of seq by
    themselves, then the parts, so that no task sorts all records of a hot key."""
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62)))
    part = F.floor(seq / PART)
    by_part = rows.groupBy("key", part.alias("_p")).agg(F.sort_array(F.collect_list(F.struct(seq.alias("seq"), "value"))).getField("value").alias("_v"))
    return by_part.groupBy("key").agg(join(F.flatten(F.sort_array(F.collect_list(F.struct("_p", "_v"))).getField("_v"))))


def concatenated(rows: DataFrame, sep: str = "") -> DataFrame:
    """Each key's values joined in the order of seq, nulls of seq first."""
    return _parts(rows, lambda v: F.array_join(v, sep).alias("value"))


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti").select(store.columns)


def put_dup(multi: DataFrame, batch: DataFrame) -> DataFrame:
    """Multimap (key, seq, value): the batch's records follow the stored ones of their key."""
    top = multi.groupBy("key").agg(F.max("seq").alias("_top"))
    new = batch.join(top, "key", "left").select("key", (F.coalesce("_top", F.lit(0)) + F.col("seq")).cast("long").alias("seq"), "value")
    return multi.select("key", F.col("seq").cast("long").alias("seq"), "value").unionByName(new)


def remove_first(multi: DataFrame) -> DataFrame:
    """The first record of every key goes."""
    first = multi.groupBy("key").agg(F.min("seq").alias("seq"))
    return multi.join(first, ["key", "seq"], "left_anti").select(multi.columns)


def value_lists(multi: DataFrame) -> DataFrame:
    """key, values: each key's values in order."""
    return _parts(multi, lambda v: v.alias("values"))


def key_range(store: DataFrame, low: Column, high: Column) -> DataFrame:
    """Records with low <= key < high; a filter that sorted files' statistics prune."""
    return store.where((F.col("key") >= low) & (F.col("key") < high))


def jump(store: DataFrame, key: Column, forward: bool = True) -> DataFrame:
    """The record of the first key at or after `key`, or of the last at or before it; one row, by a top-1 of each task."""
    at = F.col("key")
    return store.where(at >= key).orderBy("key").limit(1) if forward else store.where(at <= key).orderBy(F.desc("key")).limit(1)


def neighbors(store: DataFrame, buckets: int = 64) -> DataFrame:
    """key, prev_key, next_key in the order of keys.

    Keys are ranged into buckets first and lag and lead run inside each; a bucket's edges look to the least and greatest keys
    of all buckets (one row for each), so no task sorts the whole store."""
    keys = store.select("key").distinct()
    split = ranged(keys, [F.col("key")], buckets)
    w = Window.partitionBy("_range").orderBy("key")
    rows = split.withColumn("_p", F.lag("key").over(w)).withColumn("_n", F.lead("key").over(w))
    edges = split.groupBy("_range").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"))
    e = Window.orderBy("_range")
    edges = edges.select("_range", F.lag("_hi").over(e).alias("_before"), F.lead("_lo").over(e).alias("_after"))
    return rows.join(F.broadcast(edges), "_range").select("key", F.coalesce("_p", "_before").alias("prev_key"), F.coalesce("_n", "_after").alias("next_key"))


#: Orders of keys by name: the sort columns of a string key. Decimal keys compare by their whole difference only.
ORDERS = {
    "lex": lambda k: [k],
    "int": lambda k: [k.try_cast("long"), k],
    "num": lambda k: [F.octet_length(k), k],
    "dec": lambda k: [k.try_cast("double"), k],
}


def described(store: DataFrame) -> DataFrame:
    """key, size and md5 of every value, large binaries included."""
    return store.select("key", F.octet_length("value").alias("size"), F.md5("value").alias("digest"))


_MASK32, _MASK31 = (1 << 32) - 1, (1 << 31) - 1


def _key_bytes(key: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(F.encode(key, "utf-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))


def _polynomial(codes: Column, start: Column, factor: int, scale: int) -> Column:
    summed = F.aggregate(codes, start.cast("long"), lambda h, c: (h * factor + c).bitwiseAND(F.lit(_MASK32)))
    return (summed * scale).bitwiseAND(F.lit(_MASK31))


# Starts, factors and scales of the three hash functions of a hash store.
def inner_hash(key: Column) -> Column:
    """31 bits: the record's bucket. Keys of four bytes start from these as a little-endian number."""
    codes = _key_bytes(key)
    word = F.get(codes, 0) + F.get(codes, 1) * 256 + F.get(codes, 2) * 65536 + F.get(codes, 3) * 16777216
    return _polynomial(codes, F.when(F.size(codes) == 4, word).otherwise(751), 31, 87767623)


def second_hash(key: Column) -> Column:
    """31 bits: the order of records in a bucket. Bytes are taken from the last on."""
    return _polynomial(F.reverse(_key_bytes(key)), F.lit(19780211), 37, 43321879)


def outer_hash(key: Column) -> Column:
    """31 bits: the partition of a store of several files. Bytes are taken from the last on."""
    return _polynomial(F.reverse(_key_bytes(key)), F.lit(774831917), 29, 5157883)


def prime_at_least(n: Column) -> Column:
    """The smallest prime number not less than n (2 at least): what a hash table of n buckets is sized by. n may be some ten million;
    gaps between primes are below 300 there."""
    is_prime = lambda x: ~F.exists(F.when(x < 4, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(2).cast("long"), F.floor(F.sqrt(x)))), lambda d: x % d == 0)
    low = F.greatest(n.cast("long"), F.lit(2).cast("long"))
    return F.aggregate(F.sequence(low, low + 300), F.lit(None).cast("long"), lambda found, x: F.when(found.isNotNull(), found).when(is_prime(x), x))
