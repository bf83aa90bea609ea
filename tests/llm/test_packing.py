import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lexistrata.llm import packing
from lexistrata.llm.packing import WordIds, best_two_fit, pack, packed_documents, packed_sequences, tokenized_pieces
from lexistrata.llm.queries import op8_packing

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    """The library as it is, without extra flags."""
    return Tokenizer.from_file(PATH)


def test_word_ids_equal_the_library(tokenizer, monkeypatch):
    from tests.llm.test_bpe import random_texts

    texts = [*random_texts(800, 5), "", "<|endoftext|> a", "hi <|endoftext|> there", "a<|endoftext|><|endoftext|>", "<|endoftext| >", "x" * 5000]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in WordIds(PATH)(texts)] == want
    monkeypatch.setattr(packing, "CACHE", 20)
    few = WordIds(PATH)
    assert [few([t])[0].tolist() for t in texts[:50]] == want[:50]


def test_added_tokens_are_plain_text_on_request(tokenizer):
    own = WordIds(PATH, added_as_text=True)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    text = "hi <|endoftext|> there"
    assert own([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids != tokenizer.encode(text, add_special_tokens=False).ids


def test_all_code_points(tokenizer):
    """Letters, numbers, blanks and others are told apart as the file's own split does, whatever engine matches here."""
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    own = WordIds(PATH)
    texts = [f"a{c}1{c}!{c} {c}\n {c}" for c in chars[:0x3400]] + [f"a{c} {c}1" for c in chars[0x3400::17]] + [chr(c) + "a " + chr(c) for c in range(0x10000, 0x1FFFF, 7)]
    texts += ["".join(chars[i : i + 64]) for i in range(0, len(chars), 6400)]
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own(texts)] == want


def valid(lengths, bins, offsets, capacity):
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
        assert lengths[at].sum() <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_valid_and_few(seed):
    rnd = np.random.default_rng(seed)
    capacity = 100
    lengths = np.concatenate([rnd.integers(1, 101, 500), np.full(20, 100), rnd.integers(30, 60, 300)])
    bins, offsets = best_two_fit(lengths, capacity)
    valid(lengths, bins, offsets, capacity)
    gaps: list[int] = []  # first-fit decreasing
    for n in sorted(lengths.tolist(), reverse=True):
        for i, g in enumerate(gaps):
            if g >= n:
                gaps[i] -= n
                break
        else:
            gaps.append(capacity - n)
    assert bins.max() + 1 <= 1.01 * len(gaps) + 1


def test_smallest_gives_way_to_two():
    bins, offsets = best_two_fit(np.array([60, 35, 21, 18]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]  # 60 + 21 + 18 is tighter than 60 + 35


def test_documents(spark, tokenizer):
    rnd = random.Random(1)
    some = "the of and tion ing 12 é\n".split(" ")
    texts = {i: " ".join(rnd.choice(some) for _ in range(rnd.choice([0, 1, 5, 90, 200]))) for i in range(120)} | {900: None, 901: "", 902: "a " * 40_000}
    df = spark.createDataFrame([(t, i, 1, "clash") for i, t in texts.items()], "text string, doc_id long, piece int, ids string")
    out = packed_documents(df, PATH, capacity=128).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for i, rows in by.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert [r.length for r in rows[1:]] == [128] * (len(rows) - 1)
        at = 0
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths, bins, offsets = (np.array([getattr(r, c) for r in out]) for c in ("length", "sequence_id", "offset"))
    valid(lengths, bins, offsets, 128)
    assert len(np.unique(bins)) <= -(-lengths.sum() // 128) * 1.05 + 1
    assert packed_documents(df.limit(0), PATH).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer, tmp_path):
    rows = [(i, "word " * i) for i in range(30)] + [(None, "lost"), (None, "lost"), (3, "again and again"), (3, "again and again")]
    tokenized_pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 64).write.parquet(str(tmp_path / "pieces"))
    pieces = spark.read.parquet(str(tmp_path / "pieces"))
    placed = pack(pieces.drop("ids"), 64)
    made = [np.frombuffer(b"".join(r.ids), "<u4").tolist() for r in packed_sequences(pieces, placed).collect()]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for _, t in rows]
    assert sorted(x for s in made for x in s) == sorted(x for ids in want for x in ids)
    assert all(len(s) <= 64 for s in made)
    found = [s[a : b + 1] for s in made for a, b in zip([0, *[i + 1 for i, x in enumerate(s) if x == 0]], [i for i, x in enumerate(s) if x == 0], strict=False)]
    assert all(ids in found for ids in want if len(ids) <= 64)


def test_query_equals_plain_tokenizer(spark, tokenizer):
    """The query's pieces of all documents: ids by the library alone, places valid and gapless."""
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    by = {}
    rows = op8_packing(spark, d).collect()
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for i, found in by.items():
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        sizes = [len(ids) % 2048 or 2048] + [2048] * ((len(ids) - 1) // 2048)
        at, want = 0, []
        for k, n in enumerate(sizes):
            want.append((k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    lengths, bins, offsets = (np.array([getattr(r, c) for r in rows]) for c in ("length", "sequence_id", "offset"))
    valid(lengths, bins, offsets, 2048)
    assert len(np.unique(bins)) <= -(-lengths.sum() // 2048) + 1
