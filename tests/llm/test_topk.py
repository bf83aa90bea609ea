import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexistrata.llm import topk
from lexistrata.llm.queries import op7_top_k
from lexistrata.llm.topk import HIGHEST, LOWEST, build_tree, exact_top_k, search


def brute(rows, k, asks):
    """rows: (id, whole numbers)."""
    out = []
    for q, x in rows:
        if asks(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 2000, 60_000_000, 3e12])
def test_tree_search_is_exact(scale):
    rnd = np.random.default_rng(1)
    rows = np.floor(rnd.standard_normal((900, 8)) * scale / 4)
    rows[100:400] = rows[100]
    ids = rnd.permutation(900) * 3
    tree = build_tree(ids, rows, leaf=16)
    pairs = list(zip(ids.tolist(), [[int(v) for v in r] for r in rows], strict=True))
    want = []
    for q in range(50):
        scores = sorted((max(-sum(a * b for a, b in zip(pairs[q][1], y, strict=True)), -HIGHEST), i) for i, y in pairs)[:7]
        want.append([(i, min(max(-s, LOWEST), HIGHEST)) for s, i in scores])
    at, found, scores = search(tree, rows[:50], 7, np.full(50, -np.inf), np.full(50, HIGHEST))
    got = [sorted(zip(found[at == q].tolist(), scores[at == q].tolist(), strict=True), key=lambda e: (-e[1], e[0])) for q in range(50)]
    assert got == want
    if scale < 1e6:  # only what comes before a floor's (score, id) is reported
        floor, floor_id = (np.array([w[4][i] for w in want]) for i in (1, 0))
        at, found, _ = search(tree, rows[:50], 7, floor.astype(float), floor_id)
        assert [sorted(found[at == q].tolist()) for q in range(50)] == [sorted(i for i, _ in w[:4]) for w in want]


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rnd = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rnd.standard_normal(5)]) for i in range(200)] + [(1000 + i, [0.5] * 5) for i in range(60)]
    odd = [(5000, None), (5020, [1.0, None]), (5040, [float("nan")] * 5), (5060, [math.inf] * 5), (None, [1.0] * 5)]
    more = [(6000, [0.25]), (6020, []), (7000, [2e6, 0.0]), (7020, [-3e9, 1.0, 2.0])]
    df = spark.createDataFrame([(x, i, "clash") for i, x in [*rows, *odd, *more]], "embedding array<double>, vec_id long, score string")
    want = brute([(i, [math.floor(64 * v) for v in x]) for i, x in [*rows, *more]], 20, lambda q: q % 20 == 0)
    assert sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 20 == 0).collect()) == want
    few = df.where("vec_id < 3")
    assert sorted(tuple(r)[:3] for r in exact_top_k(few, F.col("vec_id") % 20 == 0).collect())[0][:2] == (0, 1)
    assert exact_top_k(few, F.col("vec_id") % 20 == 0).count() == 2
    assert exact_top_k(few.unionByName(few), F.col("vec_id") % 20 == 0).count() == 2
    assert exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [1e200, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_top_k(huge, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, HIGHEST), (0, 2, 3, HIGHEST), (0, 3, 4, HIGHEST), (0, 4, 2, LOWEST)]


def test_group_of_equal_vectors_larger_than_a_shard(spark, monkeypatch):
    """Copies and queries of one vector: exact rows, and the group is searched once, so what shards report stays small."""
    monkeypatch.setattr(topk, "SHARD", 50)
    rnd = np.random.default_rng(4)
    rows = [(int(i), [1.0, 2.0, -1.0]) for i in rnd.permutation(700)] + [(1000 + i, [float(v) for v in rnd.standard_normal(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute([(i, [math.floor(64 * v) for v in x]) for i, x in rows], 5, lambda q: q % 7 == 0)
    assert sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 7 == 0, 5).collect()) == want


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [math.floor(64 * v) for v in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    assert sorted(tuple(r) for r in op7_top_k(spark, d).collect()) == brute(rows, 20, lambda q: q % 20 == 0)
