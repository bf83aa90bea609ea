"""Edge cases of column functions that the tables' rows do not reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexistrata.functions import dates, markup, strings
from lexistrata.functions.text import STANDARD
from lexistrata.operators import keyvalue as kv
from lexistrata.operators.ranking import with_rank
from lexistrata.plans import find
from lexistrata.streaming import incremental


@pytest.fixture(scope="module")
def value(spark):
    return lambda *cols: tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_strings(value):
    lit = F.lit
    assert value(strings.icmp(lit("aB"), lit("Ab")), strings.icmp(lit("É"), lit("é")), strings.icmp(lit("b"), lit("A"))) == (0, -1, 1)
    assert value(strings.squeeze(lit(" \t a \n\n b\x01 ")), strings.trim(lit("\x07 a \x0d"))) == ("a b", "a")
    assert value(strings.split(lit(",a,,b,"), ","), strings.split(lit(""), ","), strings.split(lit("a]b-c"), "]-")) == (["", "a", "", "b", ""], [], ["a", "b", "c"])
    assert value(strings.replace_map(lit("aab\nb"), [("a", "b"), ("ab", "x"), ("b", "a")])) == ("bba\na",)
    assert value(strings.replace_map(lit("abab"), [("ab", "b"), ("b", "z"), ("ab", "never")])) == ("bb",)
    assert value(strings.quoted_printable_encode(lit("a=é\t\x01~\x7f")), strings.quoted_printable_decode(lit("soft=\r\nbreak=3D=C3=A9=zz"))) == ("a=3D=C3=A9\t=01~=7F", "softbreak=é=zz")
    assert value(strings.mime_word_decode(lit("=?utf-8?b?w6k=?=")), strings.mime_word_decode(lit("plain"))) == ("é", "plain")
    assert value(strings.base64_encode(lit("x" * 100)))[0].count("\n") == 0
    assert value(strings.transcode(lit("é€")), strings.crc32(lit("123456789"))) == ("é?", 0xCBF43926)


def test_markup(value):
    lit = F.lit
    assert value(markup.url_decode(lit("a%20b%zzc")), markup.url_decode(lit("%")), markup.url_encode(lit("a b*~é/"))) == ("a b", "", "a%20b%2A%7E%C3%A9%2F")
    assert value(markup.url_decode(lit("%41" * 20_000)))[0] == "A" * 20_000
    xml = "<a>t<!-- c > d --><![CDATA[<x>&]]></a>"
    assert value(markup.xml_break(lit(xml)), markup.xml_break(lit(xml), comments=False)) == (["<a>", "t", "<!-- c > d -->", "&lt;x&gt;&amp;", "</a>"], ["<a>", "t", "&lt;x&gt;&amp;", "</a>"])
    attrs = value(markup.xml_attributes(lit("""<img src=x.png alt='a "b" &lt;' src="second" wide/>""")))[0]
    assert {r.key: r.value for r in attrs} == {"": "img", "src": "x.png", "alt": 'a "b" <'} and len(attrs) == 3
    assert value(markup.csv_rows(lit('a,"x\ny",c\r\n\r\nd')), markup.csv_cells(lit('a,"x ""y"" ,z",,'))) == (['a,"x\ny",c', "d"], ["a", 'x "y" ,z', "", ""])
    message = "To: a\r\nSubject: one\r\n two\r\nsubject: later\r\n\r\nbody\r\n\r\nmore"
    m = value(markup.mime_break(lit(message)))[0]
    assert m.headers == {"to": "a", "subject": "one two"} and m.body == "body\n\nmore"
    assert value(markup.mime_break(lit("A: b")))[0].body == ""
    assert value(markup.mime_parts(lit("pre\n--x.y\none\n--x.y\ntwo\n--x.y--\npost"), lit("x.y"))) == (["one", "two"],)
    url = value(markup.url_break(lit("gopher://h/..")))[0]
    assert "scheme" not in url and "file" not in url


def test_dates(value):
    t = int(datetime.datetime(1994, 11, 6, 8, 49, 37, tzinfo=datetime.UTC).timestamp())
    assert value(dates.rfc1123(F.lit(t)), dates.w3c(F.lit(t), -5400)) == ("Sun, 06 Nov 1994 08:49:37 GMT", "1994-11-06T07:19:37-01:30")
    for text, want in {"Sun, 06 Nov 1994 08:49:37 GMT": t, "6 Nov 1994 08:49:37 PST": t + 8 * 3600, "06 Nov 1994 08:49:37 +0130": t - 5400, "1994-11-06": t - 31777, "1994-11-06T08:49:37Z": t, "1994/11/06 08:49:37": t, " 12 ": 12, "-5": -5, "0xfF": 255, "": -1, "1994-13-01": -1, "tomorrow": -1}.items():
        assert value(dates.parse(F.lit(text))) == (want,), text
    assert value(dates.day_of_week(F.lit(t)), dates.calendar(F.lit(0), 3600)["hour"]) == (0, 1)


def test_key_orders(spark):
    keys = ["10", "9", "-2", "0.5", "a", "100"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    order = lambda name: [r.key for r in with_rank(df, [c.asc_nulls_first() for c in kv.ORDERS[name](F.col("key"))], "r", 3).orderBy("r").collect()]
    assert order("lex") == sorted(keys)
    assert order("int") == ["0.5", "a", "-2", "9", "10", "100"]
    assert order("num") == ["9", "a", "-2", "10", "0.5", "100"]
    assert order("dec") == ["a", "-2", "0.5", "9", "10", "100"]
    assert with_rank(df.limit(0), [F.col("key")], "r").collect() == []


def test_display(spark):
    docs = spark.createDataFrame([(1, "the one\nthe and\nand the"), (2, None)], "id int, text string")
    got = lambda *a: [(r.id, r.line_no) for r in find.matching_lines(docs, *a).collect()]
    assert got(["the", "and"], "all") == [(1, 2)] and got(["the", "and"], "first") == [(1, 1)] and got(["the"], "any", "one|^and") == [(1, 1), (1, 3)]
    assert find.line_pattern(["a.b", "c"], "any") == r"(a\.b|c)"
    n = F.array(*[F.lit(w) for w in "a b c a".split()])
    assert spark.range(1).select(find.summary(n, ["b", "zz", "a"], 2)).first()[0] == "b c ... a b"


def test_windowed_terms(spark):
    at = [datetime.datetime(2024, 1, 1, h, m) for h, m in ((0, 5), (0, 50), (1, 1))]
    rows = spark.createDataFrame([(t, "w") for t in at], "ts timestamp, word string")
    assert sorted(r.n for r in incremental.windowed_terms(rows, "ts", "word").collect()) == [1, 2]


def test_hashes_primes_and_compression(value):
    def plain(key, start, factor, scale, back):
        h, codes = start, key.encode()
        for b in reversed(codes) if back else codes:
            h = (h * factor + b) & 0xFFFFFFFF
        return (h * scale) & 0x7FFFFFFF

    for key in ("", "a", "abcd", "a longer key", "\xe9"):
        start = int.from_bytes(key.encode(), "little") if len(key.encode()) == 4 else 751
        got = value(kv.inner_hash(F.lit(key)), kv.second_hash(F.lit(key)), kv.outer_hash(F.lit(key)))
        assert got == (plain(key, start, 31, 87767623, False), plain(key, 19780211, 37, 43321879, True), plain(key, 774831917, 29, 5157883, True))
    assert value(*[kv.prime_at_least(F.lit(n)) for n in (-5, 2, 4, 90, 10_000_000)]) == (2, 2, 5, 97, 10_000_019)
    for kind in ("zlib", "raw", "gzip"):
        small, back, bad = value(strings.deflate(F.lit("ab" * 500), kind), strings.inflate(strings.deflate(F.lit("ab" * 500), kind), kind), strings.inflate(F.lit("ab"), kind))
        assert len(small) < 60 and bytes(back) == b"ab" * 500 and bad is None


def test_limits_of_words_count_characters(value):
    """Thirty accented letters are sixty bytes: they are one word, kept whole."""
    word = "\xe9" * 30
    assert value(STANDARD.tokens(F.lit(word)), STANDARD.normal(F.lit(word)), STANDARD.parts(F.lit(word))) == ([word], word, [word])
    assert value(STANDARD.as_is(F.lit("\xe9" * 60)))[0] == "\xe9" * 49
