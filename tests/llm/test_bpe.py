import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lexistrata.llm import words
from lexistrata.llm.bpe import Bpe, bpe_decode, bpe_encode

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return Bpe(PATH, P.PATTERN)


def random_texts(n, seed):
    rnd = random.Random(seed)
    alphabets = ["abcdefgh", "aab", "éüßñ", "日本語中文", "0123456789", " \n\t\x0b\x1c\x85  ", "!?.,;'*#", "😀👩‍👧", "".join(map(chr, range(0x300, 0x310))), "<|endoftext|>"]
    for _ in range(n):
        yield "".join("".join(rnd.choice(a) for _ in range(rnd.randint(1, 12))) for a in rnd.choices(alphabets, k=rnd.randint(0, 12)))


def test_equals_tiktoken(own, reference):
    texts = [*random_texts(1500, 1), "", "I'll don't they've", "a b  c", " a", "a ", "a\n b", "a \nb", "é.\nÜb, c", "²³ ½a ª's", "\xa0a \xa0 b\x85", "\u3000 a", "a \x1c b 's 'S", "a" * 255, "a" * 256, "ab" * 128 + "a", "ba" * 200, "abc" * 340 + "dcab", "cab" * 342, "éa" * 700]
    flat, lengths = own.encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [reference.encode_ordinary(t) for t in texts]
    assert own.decode(flat, lengths) == [t.encode() for t in texts]


def test_long_pieces(own, reference):
    rnd = random.Random(2)
    for n in (257, 3000, 40_000):
        for letters in ("a", "ab", "theinga", "etaoinshrdlu", " "):
            t = "".join(rnd.choice(letters) for _ in range(n))
            assert own.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_heap_equals_matrices(own):
    for t in random_texts(300, 3):
        b = t.encode()[:200]
        if len(b) < 2:
            continue
        row = np.full((1, 256), own.pairs.n - 1, np.int32)
        row[0, : len(b)] = own.bytes_to_id[np.frombuffer(b, np.uint8)]
        assert own.merge_rows(row)[0].tolist() == own.merge_long(b).tolist()


def test_cache_and_blocks_do_not_matter(own, reference, monkeypatch):
    texts = list(random_texts(60, 4))
    monkeypatch.setattr(words, "CACHE", 50)
    monkeypatch.setattr(words, "BLOCK", 9)
    monkeypatch.setattr(words, "LONG_TEXT", 20)
    small = Bpe(PATH, P.PATTERN)
    for t in texts:
        assert small.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_operator(spark, reference):
    rows = [(1, "x " * 300_000, "c"), (2, None, "c"), (3, "", "c"), (None, "Hallo\tWelt", "c"), (1, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe_decode(bpe_encode(df, PATH, P.PATTERN), PATH).collect()
    assert [(r.doc_id, r.ids, bytes(r.decoded)) for r in out] == [(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert bpe_decode(bpe_encode(df.limit(0), PATH, P.PATTERN), PATH).collect() == []


def test_query(spark, reference):
    from lexistrata.llm.queries import op1_bpe

    d = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in op1_bpe(spark, d).collect()) == sorted(want)
