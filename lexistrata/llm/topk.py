"""Exact top-k by inner product: a ball tree per shard, branch and bound over blocks of queries."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistrata.llm.common import durable, mapped

#: Vectors of a shard, of a leaf of its tree, and queries of a block.
SHARD, LEAF, BLOCK = 8192, 256, 512
#: Vectors are dealt by a tree of at most ROUTES leaves, fitted on about ROUTED vectors drawn by a hash of the id; every vector is
#: dealt, and shards' balls are those of all their vectors.
ROUTES, ROUTED = 1024, 16_384
#: Shards whose balls are held against a block at a time, queries that go to a shard as one task's part, floors that a task keeps.
CHUNK, PART, KEPT = 1024, 16_384, 1 << 18
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class BallTree:
    """Nodes by number; children are 0 at a leaf, which holds rows first:last. ids and rows are in the leaves' order; by_id has
    each row's place in the order of ids."""

    ids: np.ndarray
    rows: np.ndarray
    by_id: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray


def build_tree(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> BallTree:
    """Halves along the line between two far-apart rows, by rank, so equal rows split too and the depth is logarithmic."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    place = np.arange(len(ids))
    nodes: list[list] = []  # center, radius, first, last, left, right

    def add(a: int, b: int) -> int:
        points = rows[place[a:b]].astype(np.float64)
        center = points.mean(axis=0)
        away = ((points - center) ** 2).sum(axis=1)
        nodes.append([center, np.sqrt(away.max()), a, b, 0, 0])
        n = len(nodes) - 1
        if b - a > leaf:
            p = points[away.argmax()]
            q = points[((points - p) ** 2).sum(axis=1).argmax()]
            place[a:b] = place[a:b][np.argsort(points @ (q - p), kind="stable")]
            mid = (a + b) // 2
            nodes[n][4], nodes[n][5] = add(a, mid), add(mid, b)
        return n

    add(0, len(ids))
    center, radius, first, last, left, right = zip(*nodes, strict=True)
    return BallTree(ids[place], rows[place], place, np.array(center), np.array(radius), *(np.array(x) for x in (first, last, left, right)))


def search(tree: BallTree, queries: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query's place in the block, id, score) of each query's k best in the tree that come before its floor: a larger score
    than `floor`, or the same and a smaller id than `floor_id`. A floor of -inf is none. queries are rows of whole numbers. A
    score beyond a long counts as the long's end.

    A query's score to beat is the larger of its floor and its kth best so far. Nodes wait by how far their upper bound (inner
    product with the center plus norm times radius) exceeds that score for any query; a node is opened for those queries alone
    that it can still serve."""
    width = max(tree.rows.shape[1], queries.shape[1])
    rows, centers, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (tree.rows, tree.centers, queries))
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    reach = np.sqrt((centers**2).sum(axis=1)) + tree.radii
    most = float(norms.max(initial=0) * np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    exact = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else object  # holds every partial sum exactly
    fast_rows, fast_queries = (_whole(x) if exact is object else x.astype(exact) for x in (rows, queries))
    bound = upper_bounds(queries, norms, centers, tree.radii, reach)
    bound[~np.isfinite(bound)] = np.inf  # numbers whose squares no double holds are compared one by one
    bits = max(1, int(len(tree.ids) - 1).bit_length())
    mask = (1 << bits) - 1
    wide = most * (1 << bits) >= 1 << 62  # score and order don't fit one long: compare them as Python numbers
    low = LOWEST if not wide else -(1 << 100)
    kind = object if wide else np.int64
    best = np.full((len(queries), k), low, kind)  # score << bits | (mask - place by id)
    beat = floor.astype(np.float64)
    heap = [(-np.inf, 0)]
    while heap:
        _, n = heapq.heappop(heap)
        some = np.flatnonzero(bound[:, n] >= beat)
        if not len(some):
            continue
        if tree.left[n]:
            for child in (tree.left[n], tree.right[n]):
                over = bound[some, child] - np.where(np.isfinite(beat[some]), beat[some], -1e300)
                heapq.heappush(heap, (-over.max(), int(child)))
            continue
        a, b = tree.first[n], tree.last[n]
        scores = fast_queries[some] @ fast_rows[a:b].T
        scores = np.minimum(np.maximum(scores, LOWEST), HIGHEST) if exact is object else scores.astype(np.int64)
        least, least_id = floor[some][:, None], floor_id[some][:, None]
        usable = ((scores > least) | ((scores == least) & (tree.ids[a:b] < least_id))).astype(bool)
        hit = usable.any(axis=1)
        some, scores, usable = some[hit], scores[hit], usable[hit]
        if not len(some):
            continue
        keys = scores.astype(kind) * (1 << bits) + (mask - tree.by_id[a:b])
        both = np.concatenate([best[some], np.where(usable, keys, low)], axis=1)
        both = np.sort(both, axis=1) if wide else np.partition(both, both.shape[1] - k, axis=1)
        best[some] = both[:, -k:]
        least = best[some].min(axis=1)
        full = least > low
        beat[some[full]] = np.maximum(beat[some[full]], _below((least[full] >> bits).astype(np.float64)))
    at, col = np.nonzero(best > low)
    keys = best[at, col]
    id_at = np.empty(len(tree.ids), np.int64)
    id_at[tree.by_id] = tree.ids
    return at, id_at[(mask - (keys & mask)).astype(np.int64)], (keys >> bits).astype(np.int64)


def _below(x: np.ndarray) -> np.ndarray:
    """x, or what is just below it where a double rounds whole numbers."""
    return np.where(np.abs(x) < 1 << 53, x, np.nextafter(np.nextafter(x, -np.inf), -np.inf))


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python numbers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def upper_bounds(queries: np.ndarray, norms: np.ndarray, centers: np.ndarray, radii: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """At least the largest inner product of each query with any row of each ball; the last term covers rounding."""
    return queries.astype(np.float64) @ centers.T + norms[:, None] * radii + 1e-9 * norms[:, None] * reach + 1e-3


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole doubles as rows; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Router:
    """A binary tree of half spaces: a row goes to the left child where its product with the direction is below the cut."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        width = min(rows.shape[1], self.directions.shape[1])
        for _ in range(self.depth):
            side = (rows[:, :width] * self.directions[node, :width]).sum(axis=1) >= self.cuts[node]
            node = 2 * node + 1 + side
        return node - len(self.cuts)


def fit_router(sample: np.ndarray, leaves: int) -> Router:
    """Splits as build_tree does, at the median along the line between two far-apart rows, over a sample."""
    depth = max(0, int(leaves - 1).bit_length())
    inner = (1 << depth) - 1
    directions, cuts = np.zeros((inner, sample.shape[1])), np.zeros(inner)
    parts = {0: sample}
    for n in range(inner):
        points = parts.pop(n)
        if len(points) > 1:
            p = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            q = points[((points - p) ** 2).sum(axis=1).argmax()]
            along = (points * (q - p)).sum(axis=1)
            directions[n], cuts[n] = q - p, np.median(along)
        side = (points * directions[n]).sum(axis=1) >= cuts[n]
        parts[2 * n + 1], parts[2 * n + 2] = points[~side], points[side]
    return Router(directions, cuts, depth)


def _routed(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(router(_matrix(b.column(1))))], [*b.schema.names, "leaf"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition in batches that hold one value of the leading key columns, `most` rows at most."""
    held: list[pa.RecordBatch] = []
    now, n = None, 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            key = tuple(b.column(i)[at].as_py() for i in range(keys))
            if held and (key != now or n == most):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            now = key
            same = np.ones(b.num_rows - at, bool)
            for i in range(keys):
                same &= b.column(i).slice(at).to_numpy(zero_copy_only=False) == key[i]
            run = len(same) if same.all() else int(same.argmin())
            take = min(run, most - n)
            held.append(b.slice(at, take))
            n, at = n + take, at + take
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _made_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, salt, id, x), a shard's together, to its number, tree and ball."""
    for t in _groups(batches, 2, 4 * SHARD):
        tree = build_tree(t.column(2).to_numpy(), _matrix(t.column(3)))
        number = t.column(0)[0].as_py() << 32 | t.column(1)[0].as_py()
        ball = pickle.dumps((tree.centers[0], tree.radii[0]), 5)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(tree, 5)], pa.binary()), pa.array([ball], pa.binary())], ["number", "data", "ball"])


_SENT = "number long, qkey long, x array<double>, floor double, floor_id long"


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, numbers, balls, block of queries) to the queries that a shard can still serve, one row for each."""
    for b in batches:
        for i in range(b.num_rows):
            numbers = np.array(b.column(1)[i].as_py(), np.int64)
            centers, radii = zip(*map(pickle.loads, b.column(2)[i].as_py()), strict=True)
            width = max(map(len, centers))
            centers, radii = np.array([np.pad(c, (0, width - len(c))) for c in centers]), np.array(radii)
            asked = pa.ipc.open_stream(b.column(3)[i].as_buffer()).read_all().combine_chunks().to_batches()[0]
            queries = _matrix(asked.column("x"))
            norms = np.sqrt((queries**2).sum(axis=1))
            common = min(width, queries.shape[1])
            bound = upper_bounds(queries[:, :common], norms, centers[:, :common], radii, np.sqrt((centers**2).sum(axis=1)) + radii)
            floor = asked.column("floor").to_numpy(zero_copy_only=False)
            at, shard = np.nonzero((bound >= floor[:, None]) & (numbers != asked.column("home").to_numpy()[:, None]))
            some = asked.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[shard]), *(some.column(c) for c in ("qkey", "x", "floor", "floor_id"))], ["number", "qkey", "x", "floor", "floor_id"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of queries as blocks, BLOCK in one value."""
    for t in _groups(batches, 0, BLOCK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_batch(t)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["queries"])


def _searched(k: int):
    """Rows (number, part, data, qkey, x, floor, floor_id) sorted so that a shard's tree comes before its queries, to results. A
    query's kth result in a shard is its floor in the shards that the task meets later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = None, None
        kept: dict[int, tuple[float, int]] = {}
        for t in _groups(batches, 2, 4 * BLOCK):
            data = t.column(2).is_valid().to_numpy(zero_copy_only=False)
            if data.any():
                number, tree = t.column(0)[0].as_py(), pickle.loads(t.column(2)[int(data.argmax())].as_buffer())
                t = t.filter(pa.array(~data))
            if not t.num_rows:
                continue
            assert tree is not None and t.column(0)[0].as_py() == number
            keys = t.column(3).to_numpy()
            floor, floor_id = t.column(5).to_numpy(zero_copy_only=False).copy(), t.column(6).to_numpy(zero_copy_only=False).copy()
            for i, q in enumerate(keys.tolist()):
                if q in kept and (kept[q][0], -kept[q][1]) > (floor[i], -floor_id[i]):
                    floor[i], floor_id[i] = kept[q]
            at, found, scores = search(tree, _matrix(t.column(4)), k, floor, floor_id)
            order = np.lexsort((-found, scores, at))
            at, found, scores = at[order], found[order], scores[order]
            full = np.bincount(at, minlength=len(keys)) == k
            first = np.searchsorted(at, np.flatnonzero(full))
            if len(kept) > KEPT:
                kept.clear()
            for q, s, i in zip(keys[full].tolist(), scores[first].tolist(), found[first].tolist(), strict=True):
                if abs(s) < 1 << 53:  # a floor that a double holds
                    kept[q] = (float(s), i)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(found), pa.array(scores)], ["qkey", "vec_id", "score"])

    return run


_FOUND = "qkey long, vec_id long, score long"


def exact_top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k highest inner products among all other rows, exactly.

    Components become floor(scale * x); scores are whole. Ties go to the smaller id; a query with fewer candidates gets them all.

    Plan. Of rows with equal vectors only the k + 1 smallest ids can be in any result, and queries with equal vectors have the
    same candidates: both collapse before anything is searched, so a large group of copies is searched once. Vectors are dealt
    by a tree of half spaces to leaves and, where a leaf holds more than SHARD, by a hash of the id to its shards, each with its
    ball tree, written to the shared folder. Every query first searches one shard of its own leaf: its kth (score, id) there is
    its floor. Then blocks of queries meet chunks of the shards' balls, a few numbers each (the query set is a stated part of
    the rows), and only the pairs whose upper bound reaches the floor are sent: a shard's tree goes once to each task's part of
    its queries. Within a task floors rise from shard to shard. Results before the floors, few for each query, are ranked.

    Defined results: rows with a null id or vector, or with a component that is null or not finite (as it is or once scaled),
    take no part; a score beyond a long counts as the long's end; vectors of different lengths are compared over their common
    components; rows that share the query's id count as its own; rows that repeat an id and its vector are one, and an id with
    several vectors is a candidate, and asks, with each of them; an empty table gives no rows; other columns are ignored. Ids
    must be whole numbers: text that is none counts as null.
    """
    scaled = F.transform(F.col(vec_col).cast("array<double>"), lambda v: v * F.lit(float(scale)))
    x = F.transform(scaled, lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v))  # larger ones are whole
    fine = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).try_cast("long").alias("id"), F.col(vec_col).alias("_v"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"), fine.alias("_fine"))
    rows = durable(rows.where("id is not null and _v is not null and _fine").select("id", "x", "asks"), "topk-rows")
    spark = df.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    same = durable(rows.groupBy("x").agg(F.min("id").alias("qkey"), F.max("asks").alias("asked")), "topk-distinct")
    ranked = rows.select("id", "x").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy("id")))
    candidates = durable(ranked.where(F.col("_r") <= k + 1).select("id", "x"), "topk-candidates")
    n, asked = candidates.count(), same.where("asked").count()
    if not n or not asked:
        return none

    shards_wanted = -(-n // SHARD)
    drawn = candidates.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, ROUTED / n) * (1 << 30)))).select("x").limit(2 * ROUTED)
    sample = _matrix(drawn.toArrow().column("x").combine_chunks())
    router = fit_router(sample, min(ROUTES, shards_wanted) if len(sample) else 1)
    routed = durable(mapped(candidates, _routed(router), "id long, x array<double>, leaf long"), "topk-routed")
    leaves = routed.groupBy("leaf").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("salts"))  # ROUTES rows at most
    dealt = routed.join(F.broadcast(leaves), "leaf").select("leaf", F.pmod(F.xxhash64("id"), "salts").alias("salt"), "id", "x")
    dealt = dealt.repartition(shards_wanted, "leaf", "salt").sortWithinPartitions("leaf", "salt", "id")
    shards = durable(mapped(dealt, _made_shards, "number long, data binary, ball binary"), "topk-shards")

    def met(sent: DataFrame) -> DataFrame:
        """Each row of sent (_SENT) searches its shard; a shard with many queries is served in parts."""
        parts = sent.groupBy("number").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
        trees = shards.join(parts, "number").select("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "data")
        trees = trees.select("*", F.lit(None).cast("long").alias("qkey"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("floor_id"))
        asks = sent.join(parts, "number").select("number", F.pmod(F.xxhash64("qkey"), "parts").alias("part"), F.lit(None).cast("binary").alias("data"), "qkey", "x", "floor", "floor_id")
        together = trees.unionByName(asks).repartition("number", "part").sortWithinPartitions("number", "part", F.asc_nulls_first("qkey"))
        return mapped(together, _searched(k + 1), _FOUND)

    own = same.where("asked").select("qkey", "x").mapInArrow(_routed(router), "qkey long, x array<double>, leaf long")
    numbers = shards.select((F.shiftright("number", 32)).alias("leaf"), "number").groupBy("leaf").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    homed = own.join(numbers, "leaf", "left")
    home = F.get("numbers", F.pmod(F.xxhash64("qkey"), F.size("numbers")).cast("int"))
    asks = durable(homed.select("qkey", "x", F.coalesce(home, F.lit(-1)).alias("home")), "topk-asks")
    none_yet = [F.lit(float("-inf")).alias("floor"), F.lit(HIGHEST).alias("floor_id")]
    first = durable(met(asks.where("home >= 0").select(F.col("home").alias("number"), "qkey", "x", *none_yet)), "topk-first")
    kth = first.groupBy("qkey").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("neg"))).alias("kth")).where(F.col("n") == k + 1)
    small = F.abs(F.col("kth.score").cast("double")) < float(1 << 53)
    floors = kth.where(small).select("qkey", F.col("kth.score").cast("double").alias("floor"), (-F.col("kth.neg")).alias("floor_id"))
    again = asks.join(floors, "qkey", "left").select("qkey", "x", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.coalesce("floor_id", F.lit(HIGHEST)).alias("floor_id"))
    chunks = -(-ROUTES // CHUNK) if shards_wanted <= CHUNK else -(-2 * shards_wanted // CHUNK)
    balls = shards.groupBy(F.pmod(F.xxhash64("number"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("number", "ball")).alias("s"))
    balls = balls.select("chunk", F.col("s.number").alias("numbers"), F.col("s.ball").alias("balls"))
    blocks = again.repartition(max(1, -(-asked // BLOCK)), "qkey").mapInArrow(_blocks, "queries binary")
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    sent = durable(balls.join(blocks, "chunk").select("chunk", "numbers", "balls", "queries").mapInArrow(_sent, _SENT), "topk-sent")
    found = first.unionByName(met(sent))
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    lists = best.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), "vec_id", "score")), False).alias("l"))  # k + 1 each
    keyed = rows.where("asks").select("id", "x").distinct().join(same.where("asked").select("x", "qkey"), "x").select("id", "qkey")
    out = keyed.join(lists, "qkey").select(F.col("id").alias("query_id"), F.slice(F.filter("l", lambda e: e["vec_id"] != F.col("id")), 1, k).alias("l"))
    out = out.select("query_id", F.posexplode("l").alias("p", "e"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
