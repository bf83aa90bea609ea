import hashlib
import re

from pyspark.sql import functions as F

from lexistrata.llm.exact_dedup import exact_dedup

SCHEMA = "text string, doc_id long, keep_id string, _h int"


def expected(rows):
    groups = {}
    for text, i in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), m[3] == keep, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


ROWS = [("a b", 5), ("ab", 1), (" ab\t", 7), ("a  b ", 9), (None, 3), ("", 2), (" \n", 4), ("é x", 6), ("x" * 300_000, 8), ("A b", -2), ("tie ", 20), (" tie", 19), ("z", None), ("z", 30)]


def frame(spark, rows):
    return spark.createDataFrame([(t, i, "clash", 1) for t, i in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_edges_and_ties(spark):
    assert got(exact_dedup(frame(spark, ROWS))) == expected(ROWS)


def test_collisions_are_told_apart_by_bytes(spark):
    assert got(exact_dedup(frame(spark, ROWS), content_hash=lambda c: F.lit("00"))) == expected(ROWS)


def test_repeated_rows_and_empty_table(spark):
    assert [r.kept for r in exact_dedup(frame(spark, [("q", 1), ("q", 1)])).collect()] == [True, True]
    assert exact_dedup(frame(spark, [])).collect() == []
