"""Near-duplicates by similarity: SimHash variants and minhash bands give candidates, exact Jaccard similarity verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import durable, mapped, small_batches, texts_of
from lexistrata.llm.components import connected_components
from lexistrata.llm.simhash import fingerprint_edges, fingerprint_of, shingle_hashes
from lexistrata.sources.storage import Rounds

#: Words of a shingle, and the least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8, more above.
BANDS, ROWS = 40, 7
#: Shingles that are hashed at a time; members that are compared with a pivot in one task; bytes of sets that a task solves at once.
BLOCK, PART, SMALL = 1024, 256, 1 << 24
_rnd = np.random.default_rng(42)
_FACTORS = _rnd.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rnd.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than a shingle are one, no words are none."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; sets that share one agree in the minima of ROWS permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ least[:, i]) * _MULT
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            hashes = [shingle_hashes(t, shingle) for t in texts_of(b.column(2))]
            sets = [np.unique(h) for h in hashes]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            prints = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            cols = [*b.columns[:3], pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(prints), bands]
            yield pa.RecordBatch.from_arrays(cols, ["_id", "row", "_text", "h1", "h2", "fp", "bands"])

    return run


def _hashed(shingle: int):
    """Rows (node, text) to (node, hashes): the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            data = [shingles(t, shingle).tobytes() for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["node", "hashes"])

    return run


def link_classes(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Each set's class, by its first member's place: sets are linked at the similarity, directly or in steps.

    A search outward from each first member; every member is a pivot once and is compared with those not yet reached."""
    label = np.arange(len(sets))
    rest = np.arange(len(sets))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        queue = [first]
        part = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in rest.tolist()])
        while queue and len(rest):
            p = queue.pop()
            own = flat[starts[p] : starts[p] + sizes[p]]
            mark[own] = True
            common = np.add.reduceat(mark[part], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
            mark[own] = False
            near = common >= similarity * (sizes[p] + sizes[rest] - common) - 1e-9
            if near.any():
                label[rest[near]] = first
                queue.extend(rest[near].tolist())
                part = part[np.repeat(~near, sizes[rest])]
                rest = rest[~near]
    return label


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, part, is_member, node, hashes), a pivot's own set before its members', to (a, b, s): each member's similarity
    to its pivot. One set is held beside the batch."""
    now, own = None, np.empty(0, np.uint64)
    for b in small_batches(batches):
        a, p, s = [], [], []
        for pivot, member, node, data in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            hashes = np.frombuffer(data, np.uint64)
            if not member:
                now, own = pivot, hashes
                continue
            assert now == pivot
            common = int(np.isin(hashes, own, assume_unique=True).sum())
            a.append(node)
            p.append(pivot)
            s.append(common / max(1, len(hashes) + len(own) - common))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "s"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a member, b pivot) to (a, b, s). A pivot's members are dealt into parts of about PART, each with a copy of
    the pivot's set, so a pivot of a third of all texts spreads over the cluster."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    lead = parts.join(sets.withColumnRenamed("node", "b"), "b").select(F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("b").alias("node"), "hashes")
    rest = pairs.join(parts, "b").select(F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), "parts").alias("part"), F.lit(True).alias("member"), F.col("a").alias("node")).join(sets, "node")
    both = lead.unionByName(rest).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    return mapped(both, _similarities, "a long, b long, s double")


def _solved(similarity: float):
    """Rows (group, node, hashes) sorted by group to (a, b): each node and the first of its class in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def made() -> pa.RecordBatch:
            label = np.array(nodes, np.int64)[link_classes(sets, similarity)]
            linked = label != np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)[linked]), pa.array(label[linked])], ["a", "b"])

        for b in small_batches(batches):
            for group, node, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if nodes and group != now:
                    yield made()
                    nodes, sets = [], []
                now = group
                nodes.append(node)
                sets.append(np.frombuffer(data, np.uint64))
        if nodes:
            yield made()

    return run


def _links(groups: DataFrame, more: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links (a, b) that connect what is similar within groups (key, node) and among the pairs (a, b) of `more`.

    A round picks a pivot in each group, the same wherever nodes meet again, and takes the similarity of the others to it: one
    comparison for a member, never all pairs. What is similar to the pivot is done, unless the group holds others so near that
    the triangle inequality leaves them a chance to be similar to it. Small groups that are left are solved as they are, in one
    task each; large ones go on to the next round without their pivot."""
    spark = groups.sparkSession
    nodes = groups.select("node").unionByName(more.select(F.col("a").alias("node"))).unionByName(more.select(F.col("b").alias("node"))).distinct()
    sets = durable(mapped(texts.join(nodes, "node").select("node", "_text"), _hashed(shingle), "node long, hashes binary"), "near-hashes")
    found = spark.createDataFrame([], "a long, b long")
    rounds = Rounds("near-groups")
    while True:
        pivots = groups.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).getField("node").alias("b"))
        stars = groups.join(pivots, "key").where("node <> b").select("key", F.col("node").alias("a"), "b")
        pairs = stars.select("a", "b").unionByName(more.select("a", "b")).distinct()
        scored = durable(_similar(pairs, sets), "near-similarities")
        near = F.col("s") >= similarity - 1e-9
        found = durable(found.unionByName(scored.where(near).select("a", "b")).distinct(), "near-links")
        labels = connected_components(found, "near-components")
        # of each group: who is apart from the pivot, and who is linked to it but within reach of one that is apart
        judged = stars.join(scored, ["a", "b"]).join(labels.withColumnsRenamed({"node": "a", "root": "la"}), "a", "left").join(labels.withColumnsRenamed({"node": "b", "root": "lb"}), "b", "left")
        judged = judged.withColumn("apart", F.coalesce("la", "a") != F.coalesce("lb", "b"))
        reach = judged.where("apart").groupBy("key").agg(F.max("s").alias("top"), F.count("*").alias("n"))
        left = judged.join(reach, "key").where(F.col("apart") | (F.col("s") <= F.col("top") + (1 - similarity) + 1e-9)).select("key", F.col("a").alias("node"), F.coalesce("la", "a").alias("label"))
        several = left.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
        several = several.where("low <> high").groupBy("n", "same").agg(F.min("key").alias("key"))  # groups of the same members once
        sizes = sets.select("node", F.octet_length("hashes").alias("bytes"))
        left = left.join(several.select("key"), "key", "left_semi").join(sizes, "node")
        left = rounds.next(left.join(left.groupBy("key").agg(F.sum("bytes").alias("total")), "key").select("key", "node", (F.col("total") <= SMALL).alias("small")))
        direct = left.where("small").join(sets, "node").select("key", "node", "hashes").repartition("key").sortWithinPartitions("key", "node")
        found = durable(found.unionByName(mapped(direct, _solved(similarity), "a long, b long")).distinct(), "near-links")
        if left.where("not small").isEmpty():
            return found
        groups, more = left.where("not small").select("key", "node"), spark.createDataFrame([], "a long, b long")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id_col, component_id (least id reachable over links).

    Words are those of simhash_components. Texts link when the Jaccard similarity of their sets of shingles is `similarity` or
    more. Candidates are the links of the SimHash operator over these shingles (deletion variants, MAX_DISTANCE bits) and, as
    most pairs at this similarity differ in more bits than an index of variants can bridge, what shares one of BANDS minhash
    bands; every candidate is verified by its sets, so no link is wrong, and a linked pair that shares neither is lost with the
    probability given at BANDS.

    Plan: equal sets (128-bit digests) collapse first. Each distinct set gives BANDS rows; a band's members are compared with its
    pivot (_links), never pair by pair, and only the texts of candidates are shuffled. A task holds one set and a batch, or a
    small group of SMALL bytes.

    Defined results: null and word-free texts are one set and link among themselves; fewer words than a shingle are one shingle;
    ids and repeated rows as in simhash_components; an empty table gives no rows; other columns are ignored."""
    picked = df.select(F.col(id_col).try_cast("long").alias("_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("_text"))
    docs = durable(mapped(picked, _sets(shingle), "_id long, row long, _text string, h1 long, h2 long, fp long, bands array<long>"), "near-sets")
    sets = durable(docs.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.min("row").alias("node"), F.min("fp").alias("fp")), "near-distinct")
    kept = docs.select(F.col("row").alias("node"), "bands").join(sets.select("node"), "node")
    wild = kept.select("node", F.explode("bands").alias("key"))
    several = wild.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    groups = durable(wild.join(several, "key").select("key", "node"), "near-bands")
    prints = durable(sets.groupBy("fp").agg(F.min("node").alias("node")), "near-prints")
    alike = sets.select(F.col("node").alias("a"), "fp").join(prints.withColumnRenamed("node", "b"), "fp").where("a <> b").select("a", "b")
    close = fingerprint_edges(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    more = durable(alike.unionByName(close.select(F.col("x").alias("a"), F.col("y").alias("b"))), "near-prints-pairs")
    texts = docs.select(F.col("row").alias("node"), "_text")
    roots = connected_components(_links(groups, more, texts, shingle, similarity), "near-components")
    rooted = sets.select("node", "first", "h1", "h2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = rooted.join(least.repartition(F.xxhash64("root")), "root").select("h1", "h2", "component_id")
    return docs.select("_id", "h1", "h2").join(by_set, ["h1", "h2"]).select(F.col("_id").alias(id_col), "component_id")
