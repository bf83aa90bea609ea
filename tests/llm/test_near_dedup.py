import numpy as np

from corpus_pipeline import drop_near_copies
from lexistrata.llm import near_dedup
from lexistrata.llm.near_dedup import band_keys, link_classes, near_components, shingles


def plain_set(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_components(rows):
    """Brute force over all pairs: the least id of each row's class."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: least[find(i)] for i, (key, _) in enumerate(rows)}


def chain(n=60, steps=12):
    """Texts that each differ from the next by a word or two: neighbours link, the ends don't."""
    words = [f"w{i}" for i in range(n)]
    return [" ".join(f"new{i}" if i < k else w for i, w in enumerate(words)) for k in range(steps)]


def test_stage_reaches_similarity(spark):
    """Documents whose SimHashes differ by more than 3 bits, in a table that has such pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = plain_components(sorted(rows.items()))
    assert {want[1], want[177]} == {1} and {want[6], want[145]} == {6}
    kept = {r.doc_id for r in drop_near_copies(spark, docs, "").collect()}
    assert kept == set(want.values())


def test_edges(spark):
    texts = [None, " \n", "a b", "A  B", "a c", *chain(), *chain(40, 30)[::7], "lone text of some few words"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(t, i, "x", 0) for i, t in rows], "text string, doc_id long, component_id string, row int")
    got = {r.doc_id: r.component_id for r in near_components(df).collect()}
    assert got == plain_components(rows)
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c d"), (3, "c d")], "doc_id long, text string")
    assert sorted(map(tuple, near_components(odd).collect()), key=str) == [(3, 3), (3, 3), (None, None), (None, None)]
    assert near_components(df.limit(0)).collect() == []


def test_large_groups_go_through_rounds(spark, monkeypatch):
    """A third of all texts near copies of one, and graded versions around the threshold: pivots, parts and rounds lose nothing."""
    monkeypatch.setattr(near_dedup, "PART", 16)
    monkeypatch.setattr(near_dedup, "SMALL", 1 << 15)
    rnd = np.random.default_rng(7)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        changed = set(rnd.choice(120, rnd.integers(0, 4), replace=False).tolist())
        texts.append(" ".join(f"x{k}y{i}" if i in changed else w for i, w in enumerate(words)))
    texts += [" ".join(words[: 120 - 3 * k] + [f"z{k}u{i}" for i in range(3 * k)]) for k in range(12)]
    texts += chain(100, 12) + [" ".join(rnd.choice(words, 60)) for _ in range(20)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_bands_meet_at_the_similarity():
    """Pairs of similarity 0.8: 40 bands of 7 lose one in ten thousand."""
    rnd = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        a = rnd.integers(0, 1 << 63, 180).astype(np.uint64)
        b = np.concatenate([a[20:], rnd.integers(0, 1 << 63, 20).astype(np.uint64)])
        met += bool((band_keys(a) == band_keys(b)).any())
    assert met >= 398


def test_classes_are_those_of_all_pairs():
    sets = [shingles(t) for t in chain(80, 20)[::3] + chain(50, 9)]
    label = link_classes(sets)
    texts = list(enumerate(chain(80, 20)[::3] + chain(50, 9)))
    assert dict(enumerate(label.tolist())) == plain_components(texts)
