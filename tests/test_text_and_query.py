"""The tokenizer against a walk over characters, the logarithm against repeated division, the grammar's edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexistrata.functions.text import STANDARD, score_log
from lexistrata.operators import index as ix
from lexistrata.plans import boolean


def walk(text):
    """Classes of characters, one by one."""
    out, run, kind = [], "", None
    for c in text:
        k = None if c in STANDARD.space else c in STANDARD.delimiter
        if k != kind and run:
            out.append(run)
            run = ""
        if k is not None:
            run += c
        kind = k
    return out + ([run] if run else [])


EDGE = ["Foo,bar. BAZ--", "a(b)c", '"quoted text"', "x...", "---", "ÄÖ é", "w" * 60, "a\tb\nc\x0cd\x0be\rf", "", " ", "!!", ".x"]


def test_tokens(spark):
    rnd = random.Random(1)
    texts = EDGE + ["".join(rnd.choice("ab ,.!(\\]^[-\t\né'\"") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in ix.analyze(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.pos, r.asis, r.word, r.wnum))
    for i, t in enumerate(texts):
        toks = walk(t)
        want = [(p, x[:49], "" if x[0] in STANDARD.delimiter else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x[:49]).rstrip("+,-.:;@"), len(toks)) for p, x in enumerate(toks)]
        assert sorted(got.get(i, [])) == want
        assert STANDARD.tokenize(t)[1] == [w[2] for w in want]


def test_logarithm(spark):
    def divided(x):
        n, v = 0, float(x) ** 10
        if x <= 1:
            return 0.0
        while v > 1.0:
            v /= math.e
            n += 1
        return n / 10

    rows = spark.range(0, 3000).select("id", score_log(F.col("id")).alias("l")).collect()
    assert all(r.l == pytest.approx(divided(r.id)) for r in rows)


CASES = [
    ("a b", "a & b", {2, 3}, [], ""), ("a & b | c", "a & b | c", {2, 3, 6}, [], ""), ("a | b & c", "a | b & c", {3}, [], ""), ("a ! b", "a ! b", {1, 4}, [], ""),
    ("a ! (b c)", "a ! ( b & c )", {1, 2, 4}, [], ""), ("a&(b|c)", "a & ( b | c )", {2, 3}, [], ""), ("A! B", "A ! B", {1, 4}, [], ""), ("zz | a", "zz | a", {1, 2, 3, 4}, [], ""),
    ("(a b) c", "( a & b ) c", {2, 3}, [], "c"), ("a (b c)", "a ( b & c )", {1, 2, 3, 4}, [], "( b & c )"), ("a) b", "a ) b", {1, 2, 3, 4}, [], ") b"),
    ("! a", "! a", set(), [boolean.INVALID], "a"), ("-a", "-a", set(), [boolean.INVALID], ""), ("a ! -b", "a ! -b", {1, 2, 3, 4}, [boolean.INVALID], ""),
    (".a | b", ".a | b", {2, 3, 5}, [boolean.INVALID], ""), ('"a b"', '" a & b "', set(), [boolean.INVALID], 'a & b "'), ('a "b', 'a " & b', {1, 2, 3, 4}, [], '" & b'),
    ("(a", "( a", {1, 2, 3, 4}, [boolean.NOT_CLOSED], ""), ("()", "( )", set(), [boolean.INVALID, boolean.NOT_CLOSED], ""), ("(a (b", "( a ( b", {1, 2, 3, 4}, [boolean.UNBALANCED], "b"),
]


@pytest.fixture(scope="module")
def posts(spark):
    holds = {"a": [1, 2, 3, 4], "b": [2, 3, 5], "c": [3, 6]}
    docs = {}
    for w, ids in holds.items():
        for i in ids:
            docs.setdefault(i, []).append(w)
    return ix.postings(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "id int, text string"), "id", "text").cache()


@pytest.mark.parametrize("text, tokens, ids, errors, ignored", CASES)
def test_grammar(posts, text, tokens, ids, errors, ignored):
    q = boolean.parse(text)
    assert (" ".join(q.tokens), q.errors, " ".join(q.ignored)) == (tokens, errors, ignored)
    df, said = boolean.run(text, posts)
    assert {r.id for r in df.collect()} == ids and said[: len(errors)] == errors and len(said) == len(errors) + bool(ignored)


@pytest.mark.parametrize("text", ["a &", "(a &", "", "  "])
def test_queries_without_a_value(text):
    with pytest.raises(boolean.QueryFailed):
        boolean.parse(text)


def test_scores_add_and_rank(posts):
    a = {r.id: r.score for r in boolean.weighed(posts, ["a"]).collect()}
    b = {r.id: r.score for r in boolean.weighed(posts, ["b"]).collect()}
    rows = [(r.id, r.score) for r in boolean.run("a | b", posts)[0].collect()]
    assert rows == sorted(((i, a.get(i, 0) + b.get(i, 0)) for i in a.keys() | b.keys()), key=lambda x: (-x[1], x[0]))
    page = boolean.page(boolean.compile(boolean.parse("a | b").tree, posts), 1, 2).collect()
    assert [(r.rank, r.id) for r in page] == [(1, rows[1][0]), (2, rows[2][0])]


def test_plan_has_one_scan_and_no_join_of_id_sets(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = boolean.compile(boolean.parse("the & and | of ! (der das)").tree, ix.postings(df, "doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # document frequencies, one row for each term


def test_index_lifecycle(spark):
    df = spark.createDataFrame([(1, "u1", "red fox"), (2, "u2", "red dog dog"), (3, "u3", "blue")], "id long, uri string, text string")
    index = ix.build(df, "id", F.col("uri"), "text")
    new = ix.documents(spark.createDataFrame([("u2", "green"), ("u9", "red red")], "uri string, text string").withColumn("id", F.lit(0)), "id", F.col("uri"), "text").drop("id")
    put = ix.put(index, new)
    docs = {r.uri: r.id for r in put.docs.collect()}
    assert docs["u1"] == 1 and docs["u3"] == 3 and {docs["u2"], docs["u9"]} == {4, 5}
    assert {r.id for r in ix.search(put.postings, "dog").collect()} == {2}
    clean = ix.purge(put)
    assert ix.search(clean.postings, "dog").collect() == [] and {r.id for r in ix.search(clean.postings, "red").collect()} == {1, docs["u9"]}
    kept = ix.put(index, new, over=False)
    assert {r.uri: r.id for r in kept.docs.collect()} == {"u1": 1, "u2": 2, "u3": 3, "u9": 4}
    merged = ix.merge([index, index])
    assert {(r.id, r.uri) for r in merged.docs.collect()} == {(1, "u1"), (2, "u2"), (3, "u3")}
    assert {r.id for r in ix.search(merged.postings, "red").collect()} == {1, 2, 4, 5}
    gone = ix.delete(index, spark.createDataFrame([("u1",)], "uri string"))
    assert {r.id for r in ix.search(ix.purge(gone).postings, "red").collect()} == {2}
    assert [r.word for r in ix.keywords(index.docs, 1).orderBy("id").collect()] == ["fox", "dog", "blue"]
    empty = ix.build(df.limit(0), "id", F.col("uri"), "text")
    assert ix.stats(empty).first().doc_count == 0 and ix.put(empty, new).docs.count() == 2
