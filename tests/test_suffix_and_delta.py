import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexistrata.operators import delta, suffix

WORD = "abracadabra"


def test_fixture_word(spark):
    df = spark.createDataFrame([(1, WORD), (2, ""), (3, None)], "id int, text string")
    rows = sorted((r.rank, r.pos, r.lcp) for r in suffix.lcp(df, "id", "text").collect())
    assert [r[1] for r in rows] == [11, 10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2]
    assert [r[2] for r in rows] == [0, 0, 1, 4, 1, 1, 0, 3, 0, 0, 0, 2]


@given(st.text(st.sampled_from("abé\U0001f600"), max_size=60))
def test_doubling_sorts_like_text(text):
    want = sorted(range(len(text) + 1), key=lambda i: text[i:].encode("utf-32-be"))
    assert suffix.sort_suffixes(text).tolist() == want


@given(st.text(st.sampled_from("abé\U0001f600"), max_size=60))
def test_common_lengths_and_order_of_the_transform(text):
    own = suffix.SuffixArray(text)
    order = own.order.tolist()
    for r, n in enumerate(suffix.common_lengths(text, own.order).tolist()):
        a, b = (text[order[r] :], text[order[r - 1] :]) if r else ("", "")
        assert a[:n] == b[:n] and (not r or n == min(len(a), len(b)) or a[n] != b[n])
    assert order[own.start] == 0 and own.bwt() == "".join(text[i - 1] for i in order if i)
    again = suffix.SuffixArray(text, own.order)
    assert again.positions("a") == [i for i, c in enumerate(text) if c == "a"] and again.positions("") == []


def test_bwt(spark):
    df = spark.createDataFrame([(1, WORD), (2, ""), (3, None)], "id int, text string")
    assert [tuple(r) for r in suffix.bwt(df, "id", "text").collect()] == [(1, 3, "ardrcaaaabb")]


def test_matches(spark):
    text = "ab|abc|abcd|abcde|fffffab|abc|ab"
    out = spark.createDataFrame([(text,)], "t string").select(suffix.all_positions(F.col("t"), F.lit("ab")).alias("p"), suffix.all_positions(F.col("t"), F.lit("")).alias("e"), suffix.all_positions(F.lit("aaaa"), F.lit("aa")).alias("o")).first()
    assert (out.p, out.e, out.o) == ([0, 3, 7, 12, 23, 26, 30], [], [0, 1, 2]) and suffix.SuffixArray(text).positions("ab") == out.p
    df = spark.createDataFrame([("XX" + WORD[2:], WORD), (None, "a"), ("X", "a"), ("", "")], "t string, s string")
    got = [(r.nonmatch, r.start, r.length) for r in suffix.matches(df, "s", "t", 2).collect()]
    assert got == [(0, 2, 9), (None, None, None), (None, None, None), (None, None, None)]
    got = [(r.nonmatch, r.start, r.length) for r in suffix.matches(df, "s", "t", 0, 3).collect()]
    assert got == [(2, 2, 9), (None, None, None), (1, 0, 0), (0, 0, 0)]


@pytest.mark.parametrize("i", range(len(WORD)))
def test_nonmatch_fixture(i):
    non, start, n = suffix.SuffixArray(WORD.encode()).longest_nonmatch(("X" * 10 + WORD[i:]).encode(), 0, 0)
    assert non == 10 and n == len(WORD) - i and WORD[start : start + n] == WORD[i:]


def test_repeated_parts_take_near_linear_time():
    took = []
    for n in (20_000, 160_000):
        source = b"0123456789abcdef" * (n // 16)
        target = b"x".join(source[i : i + 50] for i in range(0, n, 50))
        began = time.perf_counter()
        ops = delta.make(source, target)
        took.append(time.perf_counter() - began)
        assert delta.apply_ops(source, ops) == target
    assert took[1] < 30 * took[0] and took[1] < 5


def brute_longest(source, target, at):
    n = max(n for n in range(len(target) - at + 1) if target[at : at + n] in source)
    return (source.find(target[at : at + n]) if n else 0), n


def brute_nonmatch(source, target, start, least):
    for at in range(start, len(target)):
        i, n = brute_longest(source, target, at)
        if n > least:
            return at - start, i, n
    return len(target) - start, 0, 0


@given(st.binary(max_size=80).map(lambda b: bytes(x % 3 for x in b)), st.binary(max_size=80).map(lambda b: bytes(x % 3 for x in b)), st.sampled_from([0, 3, 7, 8, 12]))
@settings(max_examples=150, deadline=None)
def test_against_brute_force(source, target, least):
    index = suffix.SuffixArray(source)
    for at in range(len(target) + 1):
        assert index.longest_match(target, at) == brute_longest(source, target, at)
        assert index.longest_nonmatch(target, at, least) == brute_nonmatch(source, target, at, least)
    ops = delta.make(source, target, least)
    assert delta.apply_ops(source, ops) == target == delta.apply_ops(source, delta.decode(delta.encode(ops)))
    assert all(o[2] > least for o in ops if o[0] == delta.MATCH)


def test_bad_records():
    with pytest.raises(ValueError, match="Invalid delta"):
        delta.decode(b"\x07abc")


def test_operators(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(20):
        s = bytes(rnd.randint(0, 255) for _ in range(400))
        rows.append((i, s, s[:100] + b"new" * 9 + s[150:] + s[:60]))
    rows += [(100, b"", b""), (101, b"", b"x"), (102, b"x", b""), (103, b"same" * 20, b"same" * 20)]
    df = delta.make_deltas(spark.createDataFrame(rows, "id int, source binary, target binary"))
    out = df.select("id", F.md5(delta.apply_deltas(F.col("source"), F.col("ops"))).alias("d"), delta.delta_stats(F.col("ops")).alias("s"), delta.no_change(F.col("source"), F.col("target"), F.col("ops")).alias("same")).collect()
    assert {r.id: r.d for r in out} == {i: hashlib.md5(t).hexdigest() for i, _, t in rows}
    assert {r.id: r.s.match_total + r.s.insert_total for r in out} == {i: len(t) for i, _, t in rows}
    assert [r.id for r in out if r.same] == [103]
    coded = df.select("id", "ops", delta.encode_ops("ops").alias("c")).withColumn("again", delta.decode_ops("c"))
    assert all(r.ops == r.again for r in coded.collect())
    coded.createOrReplaceTempView("coded")
    spark.udtf.register("delta_events", delta.Events)
    events = spark.sql("SELECT id, e.* FROM coded, LATERAL delta_events(c) e").collect()
    assert sorted((e.id, e.n, e.op, e.length) for e in events) == sorted((r.id, n, ("INSERT", "MATCH")[o.op], o.length) for r in df.collect() for n, o in enumerate(r.ops))
