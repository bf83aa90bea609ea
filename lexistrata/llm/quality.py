"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import crc_mod, mapped, small_batches, texts_of

FILTERS, WIDTH = 16, 5
#: A chunk's positions, and how far the next one begins: chunks overlap and the last ends with the text.
CHUNK, STEP = 512, 448
#: Labelled documents that training draws at most (about, by a hash of the id), and chunks of each: texts of up to some 14 KB are
#: whole, of longer ones so many chunks are drawn. What reaches the driver is TRAIN_DOCS x TRAIN_CHUNKS x 516 bytes, 50 MB, at most.
TRAIN_DOCS, TRAIN_CHUNKS = 3000, 32
#: A predicted label is 1 from this score on.
THRESHOLD = 0.3
_BLOCK = 1 << 15


@dataclass
class QualityNet:
    """taps[w][byte] are the filters' values for a byte at place w; relu, the maximum in each chunk, then mean and maximum over
    the chunks go through one logistic unit."""

    taps: np.ndarray  # (WIDTH, 256, FILTERS) float32
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 x FILTERS,)
    offset: float

    def activations(self, data: np.ndarray) -> np.ndarray:
        """The filters at each place of data (bytes, WIDTH - 1 more than places)."""
        n = len(data) - WIDTH + 1
        out = self.taps[0][data[:n]]
        for w in range(1, WIDTH):
            out += self.taps[w][data[w : w + n]]
        return out

    def chunk_maxima(self, data: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS) of one text's bytes: a long text is walked block by block."""
        data = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)]) if len(data) else np.zeros(WIDTH, np.uint8)
        places = len(data) - WIDTH + 1
        starts = chunk_starts(places)
        out = np.empty((len(starts), FILTERS), np.float32)
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
            a, b = int(starts[at]), min(int(starts[stop - 1]) + CHUNK, places)
            values = self.activations(data[a : b + WIDTH - 1])
            for i in range(at, stop):
                s = int(starts[i]) - a
                out[i] = values[s : s + CHUNK].max(axis=0)
            at = stop
        return np.maximum(out + self.bias, 0)

    def score(self, data: np.ndarray) -> float:
        peaks = self.chunk_maxima(data)
        x = np.concatenate([peaks.mean(axis=0), peaks.max(axis=0)])
        return float(1 / (1 + np.exp(-(float(x @ self.weights) + self.offset))))

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.array([self.score(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in texts])


def chunk_starts(places: int) -> np.ndarray:
    """Begins of chunks that cover all places; one for a short text, and the last ends with the text."""
    if places <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, places - CHUNK + 1, STEP)
    return starts if starts[-1] + CHUNK >= places else np.append(starts, places - CHUNK)


def training_chunks(text: str, rnd: np.random.Generator, limit: int = TRAIN_CHUNKS) -> list[bytes]:
    """The text's chunks, each with the WIDTH - 1 bytes after it; of more than `limit`, as many drawn at random."""
    data = text.encode("utf-8", "surrogatepass")
    data = data + bytes(WIDTH - 1) if data else bytes(WIDTH)
    starts = chunk_starts(len(data) - WIDTH + 1)
    if len(starts) > limit:
        starts = np.sort(rnd.choice(starts, limit, replace=False))
    return [data[s : s + CHUNK + WIDTH - 1] for s in starts.tolist()]


def gradients(net: QualityNet, docs: list[list[np.ndarray]], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean logistic loss over documents, each a list of its chunks' bytes, and its derivatives by taps, bias, weights, offset."""
    cols = np.arange(FILTERS)
    x, where = [], []  # features; bytes under each chunk's maximal places
    for chunks in docs:
        peaks, tops = [], []
        for data in chunks:
            values = net.activations(data)
            top = values.argmax(axis=0)
            peaks.append(values[top, cols])
            tops.append(data[top[:, None] + np.arange(WIDTH)])
        x.append(np.array(peaks) + net.bias)
        where.append(np.array(tops))
    active = [np.maximum(p, 0) for p in x]
    feats = np.array([np.concatenate([p.mean(axis=0), p.max(axis=0)]) for p in active])
    z = feats @ net.weights + net.offset
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    miss = (1 / (1 + np.exp(-z)) - labels) / len(docs)
    grads = [np.zeros_like(net.taps), np.zeros_like(net.bias), feats.T @ miss, np.array([miss.sum()])]
    for i, p in enumerate(active):
        g = np.repeat((miss[i] * net.weights[:FILTERS] / len(p))[None], len(p), axis=0)
        g[p.argmax(axis=0), cols] += miss[i] * net.weights[FILTERS:]
        g *= p > 0
        grads[1] += g.sum(axis=0)
        for w in range(WIDTH):
            np.add.at(grads[0][w], (where[i][:, :, w], cols[None]), g)
    return loss, grads


def train(texts: list[str], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 7) -> QualityNet:
    """train_chunks on the texts' chunks."""
    rnd = np.random.default_rng(seed)
    return train_chunks([training_chunks(t, rnd) for t in texts], labels, epochs, batch, rate, seed)


def train_chunks(chunks: list[list[bytes]], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 7) -> QualityNet:
    """Adam on the logistic loss, from each document's chunks; gradients reach each chunk's maximal place. With one class only, a
    constant that follows it."""
    rnd = np.random.default_rng(seed)
    net = QualityNet((rnd.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32), rnd.standard_normal(2 * FILTERS).astype(np.float32) * 0.1, 0.0)
    labels = np.asarray(labels, np.float64)
    rate_of_one = (labels.sum() + 1) / (len(labels) + 2)
    net.offset = float(np.log(rate_of_one / (1 - rate_of_one)))
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        return net
    docs = [[np.frombuffer(c, np.uint8) for c in some] for some in chunks]
    params = [net.taps, net.bias, net.weights, np.array([net.offset], np.float64)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rnd.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            net.offset = float(params[3][0])
            _, grads = gradients(net, [docs[d] for d in some.tolist()], labels[some])
            grads[0] += 1e-5 * params[0]
            grads[2] = grads[2] + 1e-4 * params[2]
            step += 1
            lr = rate * (0.3 if epoch >= 2 * epochs // 3 else 1)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return QualityNet(params[0], params[1], params[2], float(params[3][0]))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCS, chunks: int = TRAIN_CHUNKS) -> QualityNet:
    """A network fitted on labelled documents whose crc32(id as text) mod 5 is not 0.

    About `limit` documents, a share by hash of each label's, are drawn: half the places go to the rarer label as far as it has
    rows, and the drawn shares are undone by the offset. The executor that reads a drawn document cuts it into chunks, `chunks`
    at most; these alone come to the driver. That is the one bounded sample here.

    Defined results: null labels and ids take no part; of several labels of an id the least counts; rows that repeat an id are
    all taken; null texts are empty; without two labels the network is a constant."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != 0))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_y"))
    counts = {r._y: r.n for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, limit / 2 / n) for y, n in counts.items()}
    hashed = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    drawn = usable.where(hashed < F.when(F.col("_y") == 1, share.get(1, 0.0) * (1 << 20)).otherwise(share.get(0, 0.0) * (1 << 20)))
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    joined = picked.join(F.broadcast(drawn.limit(2 * limit)), "_id")  # at most 2 x limit ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            made = [training_chunks(t, np.random.default_rng(zlib.crc32(i.encode())), chunks) for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.binary())), b.column(2)], ["id", "chunks", "y"])

    cut = mapped(joined.select(F.col("_id").cast("string").alias("id"), "_text", "_y"), run, "id string, chunks array<binary>, y int")
    rows = sorted(cut.collect(), key=lambda r: (r.id, r.chunks))
    net = train_chunks([[bytes(c) for c in r.chunks] for r in rows], np.array([r.y for r in rows], np.float64))
    if len(share) == 2:  # the odds as they are, not as they were drawn
        net.offset += float(np.log(share[0] / share[1]))
    return net


def score_quality(df: DataFrame, net: QualityNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The id, score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on) of every row.

    Nothing is shuffled; the network, some 80 KB whatever the corpus, travels with the task, and a text is walked in blocks.
    Defined results: null and empty texts are scored as one empty chunk; ids may be null or repeat; an empty table gives no
    rows; other columns are ignored, so labels and sources can't be inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            s = net.scores(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["_id", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return mapped(picked, run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def keep_quality(df: DataFrame, net: QualityNet, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that the network predicts as 1. Rows stay in their tasks; none is shuffled.

    Defined results: null and empty texts are scored as one empty chunk; ids may be null or repeat, and repeated rows have the
    same fate; an empty table stays empty; other columns are kept, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield b.filter(pa.array(net.scores(texts_of(b.column(at))) >= threshold))

    at = df.columns.index(text_col)
    return mapped(df, run, df.schema)
