import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexistrata.llm import simhash
from lexistrata.llm.components import connected_components
from lexistrata.llm.simhash import fingerprint, fingerprint_edges, fingerprint_of, shingle_hashes, simhash_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Brute force: every fingerprint to its class's members."""
    fps = list(fps)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_plain_definition():
    rnd = random.Random(3)
    words = ["Ab", "cd", "É", "x y", "longer-word", "!", "1"]
    for n in (0, 1, 2, 3, 4, 50, 500):
        t = "".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
        assert fingerprint(t) == plain_fingerprint(t) == fingerprint_of(shingle_hashes(t, 3), 7) if n > 3 else fingerprint(t) == plain_fingerprint(t)


def test_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(-1, None), (-2, " \n"), (2000, "a b"), (2001, "A  B"), (2001, "a B")]
    df = spark.createDataFrame([(t, i, "c", 0) for i, t in rows], "text string, doc_id long, component_id string, fp int")
    out = simhash_components(df).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = classes(fps)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == want


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_large_buckets_stay_exact(spark, seed):
    """Thousands of fingerprints that share a segment: cut again by the other one's halves."""
    rnd = random.Random(seed)
    base = rnd.getrandbits(64)
    few = {base ^ (rnd.getrandbits(32) & rnd.getrandbits(32) & rnd.getrandbits(32) if rnd.random() < 0.5 else rnd.getrandbits(12) << 9) for _ in range(2600)}
    fps = np.array(sorted(few), np.uint64).view(np.int64).tolist()
    edges = fingerprint_edges(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    want = classes([f & (1 << 64) - 1 for f in fps])
    groups = {}
    for f, r in zip(fps, want, strict=True):
        groups.setdefault(r, []).append(f)
    for members in groups.values():
        for m in members:
            assert roots.get(m, m) == min(members)


def test_cube_agrees_with_direct_search():
    rnd = np.random.default_rng(5)
    bits = np.array([*range(40, 56), 3, 21])
    picked = np.unique(rnd.integers(0, 1 << 18, 900))
    fps = np.zeros(len(picked), np.int64)
    for i, b in enumerate(bits):
        fps |= ((picked >> i) & 1) << b
    a, b = simhash._star_edges(fps)
    c, d = simhash._star_edges_of_cube(fps, bits)
    assert dict(zip(a, b, strict=True)) == dict(zip(c, d, strict=True))


def test_buckets_across_batches(monkeypatch):
    """A bucket that spans batches, and one that is passed on, give the same links as one batch."""
    rnd = np.random.default_rng(1)
    keys = np.sort(rnd.integers(0, 9, 400)) * 7
    fps = rnd.integers(0, 40, 400)
    def run(step):
        cut = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(fps[i : i + step])], ["key", "fp"]) for i in range(0, 400, step)]
        rows = [r for b in simhash._buckets(iter(cut)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        return rows
    fps = np.concatenate([rnd.permutation(5000)[: (keys == k).sum()] for k in np.unique(keys)])
    whole = sorted(run(400))
    assert sorted(run(7)) == whole
    monkeypatch.setattr(simhash, "DIRECT", 20)
    over = [r for r in run(7) if r[2]]
    assert sorted((a, b) for a, b, _ in over) == sorted(zip(keys.tolist(), fps.tolist(), strict=True))
    assert sorted(r for r in run(400)) == sorted(run(7))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3)] + [(500, 501)] * 3
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{i: 100 for i in range(200, 260)}, 500: 500, 501: 500}
