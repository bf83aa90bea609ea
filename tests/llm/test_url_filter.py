from lexistrata.llm.queries import ORACLE_SQL, URL_RULES, op2_url_filter
from lexistrata.llm.url_filter import RULE_SCHEMA, filter_urls


def judged(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = ["http://a.org/x", "https://EXAMPLE.org/es/1?q", "http://b.example.org/es", "http://example.org/en/12#t", "http://x.com/fr/a?b=c", "http://com/de/", "x.org/no-scheme", None, "", "http://", "http://org", "http://a.org?x/", "ftp://u@h.org:80/a", "http://notorg/", "http://a..org/", "http://x.org/" + "y" * 5000, "http://É.org/é", "http://a.com/de/\nz", "http://a.org/x", "http://" + "a." * 100_000 + "org/x", "http://" + "." * 1000]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(u, "clash", i) for i, u in enumerate(URLS)], "url string, host string, page_id long")
    for rules in (URL_RULES, [*URL_RULES, ("a.org", "/x", "block"), ("org", "/x/zz", "block"), ("org", "", "block"), ("é.org", "/é", "block")]):
        out = filter_urls(df, spark.createDataFrame(rules, RULE_SCHEMA), keys=("page_id",)).collect()
        assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == [(i, *judged(u, rules, "allow")) for i, u in enumerate(URLS)]


def test_empty_tables(spark):
    df = spark.createDataFrame([("http://a.org/", 1)], "url string, page_id long")
    none = spark.createDataFrame([], RULE_SCHEMA)
    assert [r.verdict for r in filter_urls(df, none, "block", keys=("page_id",)).collect()] == ["block"]
    assert filter_urls(df.limit(0), none).collect() == []
    odd = spark.createDataFrame([(None, "/", "block"), ("a.org", None, "block")], RULE_SCHEMA)
    assert [r.rule for r in filter_urls(df, odd, keys=("page_id",)).collect()] == ["a.org"]


def test_query_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert sorted(map(tuple, op2_url_filter(spark, d).collect()), key=str) == sorted(con.sql(ORACLE_SQL["op2_url_filter"]).fetchall(), key=str)
