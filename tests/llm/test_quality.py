import zlib

import numpy as np
import pytest

from lexistrata.llm import quality
from lexistrata.llm.quality import CHUNK, FILTERS, WIDTH, QualityNet, chunk_starts, gradients, keep_quality, score_quality, train, train_quality, training_chunks
from lexistrata.llm.queries import op9_quality

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return train_quality(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))


def plain_score(net, text):
    """Filters, chunks and pooling by loops."""
    data = list(text.encode()) + [0] * (WIDTH - 1) if text else [0] * WIDTH
    places = len(data) - WIDTH + 1
    starts = [0] if places <= CHUNK else list(range(0, places - CHUNK + 1, quality.STEP))
    if starts[-1] + CHUNK < places:
        starts.append(places - CHUNK)
    peaks = [[max(0.0, max(sum(float(net.taps[w][data[i + w]][f]) for w in range(WIDTH)) for i in range(s, min(s + CHUNK, places))) + float(net.bias[f])) for f in range(FILTERS)] for s in starts]
    x = np.array(peaks)
    z = float(np.concatenate([x.mean(axis=0), x.max(axis=0)]) @ net.weights) + net.offset
    return 1 / (1 + np.exp(-z))


def test_chunks_cover_everything():
    for n in (1, CHUNK, CHUNK + 1, 3000, 4096, 100_000):
        starts = chunk_starts(n)
        covered = np.zeros(n, bool)
        for s in starts:
            covered[s : s + CHUNK] = True
        assert covered.all() and (starts >= 0).all() and (np.diff(starts) <= CHUNK).all()


def test_scores_equal_plain_loops(net, monkeypatch):
    monkeypatch.setattr(quality, "_BLOCK", 1000)
    for text in ("", "a", "Abc def.", "é% " * 700):
        assert net.scores([text])[0] == pytest.approx(plain_score(net, text), abs=1e-4)


def test_gradients_by_finite_differences():
    rnd = np.random.default_rng(3)
    net = QualityNet(rnd.standard_normal((WIDTH, 256, FILTERS)), rnd.standard_normal(FILTERS), rnd.standard_normal(2 * FILTERS), 0.3)
    docs = [[np.frombuffer(c, np.uint8) for c in training_chunks(t, rnd)] for t in ("ab" * 400, "", "some text " * 90, "\xe9" * 30)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    _, grads = gradients(net, docs, labels)
    step = 1e-6
    for x, g in ((net.taps, grads[0]), (net.bias, grads[1]), (net.weights, grads[2])):
        busy = np.argwhere(np.abs(g) > 1e-4)
        for i in map(tuple, [*busy[:: max(1, len(busy) // 15)].tolist(), [0] * x.ndim]):
            x[i] += step
            up = gradients(net, docs, labels)[0]
            x[i] -= 2 * step
            down = gradients(net, docs, labels)[0]
            x[i] += step
            assert abs((up - down) / (2 * step) - g[i]) < 1e-5


def test_chunks_for_training_are_those_scored():
    text = "abc " * 1000
    some = training_chunks(text, np.random.default_rng(0))
    data = text.encode() + bytes(WIDTH - 1)
    assert some == [data[s : s + CHUNK + WIDTH - 1] for s in chunk_starts(len(text)).tolist()]
    assert len(training_chunks(text, np.random.default_rng(0), 4)) == 4 and training_chunks("", np.random.default_rng(0)) == [bytes(WIDTH)]


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    out = op9_quality(spark, D).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) > 0.95


def test_edges(spark, net):
    rows = [(1, None), (2, ""), (None, "text"), (3, "a" * 300_000), (3, "a")]
    df = spark.createDataFrame([(t, i, "clash") for i, t in rows], "text string, doc_id long, score string")
    out = score_quality(df, net).collect()
    assert [r.doc_id for r in out] == [1, 2, None, 3, 3] and out[0].score == out[1].score and all(0 <= r.score <= 1 for r in out)
    assert score_quality(df.limit(0), net).collect() == []
    kept = keep_quality(df, net, threshold=0.0)
    assert kept.columns == df.columns and kept.count() == 5 and keep_quality(df, net, threshold=1.1).count() == 0


def test_labels_of_one_class_or_none(spark):
    assert isinstance(train(["a", "b"], np.array([1, 1])), QualityNet)
    docs = spark.createDataFrame([(i, "t") for i in range(9)], "doc_id long, text string")
    for rows in ([], [(1, 1), (2, 1), (3, None), (None, 0)]):
        net = train_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert len({r.score for r in score_quality(docs, net).collect()}) == 1
