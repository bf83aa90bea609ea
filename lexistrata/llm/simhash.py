"""SimHash near-duplicates: deletion-variant signatures, equality of variants, verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import durable, mapped, small_batches, texts_of
from lexistrata.llm.components import connected_components

BITS = 64
#: Two segments of 32 bits: of three differing bits, one segment holds one at most.
SEGMENT = 32
MAX_DISTANCE = 3
#: A bucket up to this size is compared member by member; a larger one is cut again by the other segment's halves.
DIRECT = 2048
#: Fingerprints whose variants one task makes.
VARIED = 1 << 15


def lowered_words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, in UTF-8: what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included; fewer words than a shingle are one, no words are none."""
    words = lowered_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate([[0], ends[:-1]])[: max(1, len(words) - shingle + 1)].tolist()
    finish = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[x:y], seed) for x, y in zip(begin, finish, strict=True)), np.uint64, len(begin))


def fingerprint_of(hashes: np.ndarray, block: int = 65_536) -> int:
    """The bits that over half of the hashes set, counted in blocks; zero of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The text's SimHash."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["_id", "fp"])

    return run


def _star_edges(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct fingerprints: (member, least member of its linked class) for every member that is not the least.

    A search outward from each least member; every member is a pivot once and is compared with those not yet reached."""
    rest = np.sort(members)
    a, b = [], []
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= MAX_DISTANCE
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                a.append(found)
                b.append(np.full(len(found), root))
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_MASKS = np.array([m for m in range(1, 1 << 18) if m.bit_count() <= MAX_DISTANCE], np.int64)


def _star_edges_of_cube(members: np.ndarray, varying: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _star_edges for members that differ in the given 18 bits only (262,144 values at most): linear in the members.

    Each value's neighbours are looked up in a table of all values, and the least label spreads until nothing changes."""
    place = np.zeros(len(members), np.int64)
    for i, bit in enumerate(varying):
        place |= ((members.view(np.uint64) >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    big = np.iinfo(np.int64).max
    label = np.full(1 << len(varying), big)
    label[place] = members
    while True:
        old = label[place]
        new = old.copy()
        for m in _MASKS[_MASKS < (1 << len(varying))]:
            np.minimum(new, label[place ^ m], out=new)
        if (new == old).all():
            break
        label[place] = new
    label = label[place]
    keep = label != members
    return members[keep], label[keep]


def _solve(keys: np.ndarray, fps: np.ndarray, large) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of the buckets in arrays sorted by key. large(key, members) handles those beyond DIRECT."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(keys)]]))
    a, b = [], []
    two = starts[sizes == 2]
    x, y = fps[two], fps[two + 1]
    near = np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_DISTANCE
    a.append(np.maximum(x, y)[near])
    b.append(np.minimum(x, y)[near])
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        p, q = _star_edges(fps[s : s + n]) if n <= DIRECT else large(keys[s], fps[s : s + n])
        a.append(p)
        b.append(q)
    return a, b


def _edge_batch(a: np.ndarray, b: np.ndarray, big: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), big))], ["a", "b", "big"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key, to edges (member, class's least, false); a bucket beyond DIRECT is passed on as
    (key, member, true), so that this task holds one batch and DIRECT members at most."""
    key, held = None, np.empty(0, np.int64)
    passing = False
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if passing and keys[0] == key:  # the rest of a bucket that is being passed on
            n = int(np.searchsorted(keys, key, "right"))
            yield _edge_batch(keys[:n], fps[:n], True)
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
        elif not passing and len(held):
            keys, fps = np.concatenate([np.full(len(held), key), keys]), np.concatenate([held, fps])
        passing, held = False, np.empty(0, np.int64)
        last = int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on in the next batch
        over: list[tuple[np.ndarray, np.ndarray]] = []

        def large(k, members, over=over):
            over.append((np.full(len(members), k), members))
            return np.empty(0, np.int64), np.empty(0, np.int64)

        if last:
            a, b = _solve(keys[:last], fps[:last], large)
            yield _edge_batch(np.concatenate(a), np.concatenate(b), False)
        key, held = keys[-1], fps[last:]
        if len(held) > DIRECT:
            over.append((np.full(len(held), key), held))
            passing, held = True, np.empty(0, np.int64)
        for p, q in over:
            yield _edge_batch(p, q, True)
    if len(held) > 1:
        a, b = _star_edges(held)
        yield _edge_batch(a, b, False)


def _sub_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _buckets for keys (wildcard of one segment, wildcard of half the other): 262,144 members at most, so all fit."""
    key, held = None, np.empty(0, np.int64)
    keys1, subs = np.empty(0, np.int64), np.empty(0, np.int64)

    def solve(k1, sub, members):
        if len(members) <= DIRECT:
            return _star_edges(members)
        seg, j = divmod(int(k1) >> 32, SEGMENT)
        half, l = divmod(int(sub) >> 16, 16)
        other = (1 - seg) * SEGMENT
        free = other + (1 - half) * 16
        return _star_edges_of_cube(members, np.array([*range(free, free + 16), seg * SEGMENT + j, other + half * 16 + l]))

    for batch in batches:
        k, s, f = (batch.column(i).to_numpy() for i in range(3))
        k, s, f = np.concatenate([keys1, k]), np.concatenate([subs, s]), np.concatenate([held, f])
        if not len(k):
            continue
        cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(s) != 0)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        for x, y in zip([0, *cuts.tolist()][:-1], cuts.tolist(), strict=True):
            if y - x > 1:
                yield _edge_batch(*solve(k[x], s[x], f[x:y]), False)
        keys1, subs, held = k[last:], s[last:], f[last:]
    if len(held) > 1:
        yield _edge_batch(*solve(keys1[0], subs[0], held), False)


def fingerprint_edges(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that connect exactly those linked, directly or in steps. They are counted first, so
    pass a table that is cheap to read twice."""
    dealt = fps.repartition(max(1, -(-fps.count() // VARIED)))  # a task writes VARIED x 64 rows
    wild = dealt.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1))).alias("w"))
    part = F.expr(f"shiftrightunsigned(fp, cast(w div {SEGMENT} as int) * {SEGMENT}) & 4294967295L")
    key = F.expr(f"shiftleft(cast(w as bigint), {SEGMENT})").bitwiseOR(part.bitwiseAND(F.expr(f"~shiftleft(1L, w % {SEGMENT})")))
    sorted_keys = wild.select(key.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = durable(mapped(sorted_keys, _buckets, "a long, b long, big boolean").distinct(), "simhash-buckets")
    edges = found.where("not big").select("a", "b")
    over = found.where("big")
    if not over.isEmpty():
        wild = over.select(F.col("a").alias("key"), F.col("b").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("w"))
        other = F.expr(f"(1 - cast(shiftright(key, {SEGMENT}) div {SEGMENT} as int)) * {SEGMENT}")
        shift = (other + F.expr("cast(w div 16 as int) * 16")).alias("shift")
        part = F.expr("shiftrightunsigned(fp, shift) & 65535L & ~shiftleft(1L, w % 16)")
        sub = F.expr("shiftleft(cast(w as bigint), 16)").bitwiseOR(part)
        deeper = wild.select("key", "fp", "w", shift).select("key", sub.alias("sub"), "fp").repartition("key", "sub").sortWithinPartitions("key", "sub")
        edges = edges.unionByName(mapped(deeper, _sub_buckets, "a long, b long, big boolean").select("a", "b"))
    return edges


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (least id reachable over links).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; each shingle of `shingle` words is hashed by XXH64, and a bit of the
    fingerprint is set when over half the hashes set it. Fingerprints link at MAX_DISTANCE differing bits or fewer.

    Plan: texts are read once and never shuffled. Of the distinct fingerprints (copies collapse before the shuffle) each gives
    64 variants: a segment of 32 bits with one bit deleted. Rows of equal variants meet in sorted partitions, are verified by
    bit count, and give edges to the least member, never all pairs. A bucket beyond DIRECT members is passed on, cut by the
    halves of its other segment to 262,144 values at most, and solved exactly by table look-up. Components come from the
    edges in rounds; nothing but counts reaches the driver.

    Defined results: null and word-free texts have fingerprint zero and link like any other; fewer words than a shingle hash
    as a whole; ids must be whole numbers, and text that is none counts as a null id; null ids are kept and never name a
    component unless no other id is there; repeated rows give repeated rows; an empty table gives no rows; other columns are
    ignored.
    """
    picked = df.select(F.col(id_col).try_cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    docs = durable(mapped(picked, _fingerprints(shingle, seed), "_id long, fp long"), "simhash-fp")
    fps = durable(docs.groupBy("fp").agg(F.min("_id").alias("first")), "simhash-distinct")
    roots = connected_components(fingerprint_edges(fps.select("fp")))
    rooted = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least.repartition(F.xxhash64("root")), "root").select("fp", "component_id")
    out = docs.join(by_fp, "fp")
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
