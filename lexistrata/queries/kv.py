"""Key-value and ordered multimap queries over orders, lineitem, customer and others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.functions import collections
from lexistrata.operators import keyvalue as kv
from lexistrata.operators.ranking import with_rank
from lexistrata.queries.common import Query, table
from lexistrata.sources import storage
from lexistrata.sources.versions import Versions, salvaged

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))


def by_customer(spark, d) -> DataFrame:
    """A batch of writes: each customer's orders, in the order of their keys."""
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value"))


def lines(spark, d) -> DataFrame:
    """A multimap: each order's line items in line order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").cast("string").alias("value"))


_STORE = "store AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer)"
_BATCH = "batch AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders)"
_MULTI = "multi AS (SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS seq, CAST(l_partkey AS VARCHAR) AS value FROM lineitem)"
_WITH = f"WITH {_STORE}, {_BATCH}"
_LAST = "SELECT key, arg_max(value, seq) AS value FROM batch GROUP BY key"
_FIRST = "SELECT key, arg_min(value, seq) AS value FROM batch GROUP BY key"


@query("kv_put_over", f"{_WITH} SELECT key, coalesce(b.value, s.value) AS value FROM store s FULL JOIN ({_LAST}) b USING (key)")
def kv_put_over(spark, d):
    return kv.put_over(customers(spark, d), by_customer(spark, d))


@query("kv_put_keep", f"{_WITH}, half AS (SELECT * FROM store WHERE value < 'Customer#000000500') SELECT key, coalesce(s.value, b.value) AS value FROM half s FULL JOIN ({_FIRST}) b USING (key)")
def kv_put_keep(spark, d):
    return kv.put_keep(customers(spark, d).where("value < 'Customer#000000500'"), by_customer(spark, d))


@query("kv_put_cat", f"{_WITH}, r AS (SELECT key, -1 AS seq, value FROM store UNION ALL SELECT key, seq, value FROM batch) SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM r GROUP BY key")
def kv_put_cat(spark, d):
    return kv.put_cat(customers(spark, d), by_customer(spark, d))


@query("kv_out", f"{_WITH} SELECT key, value FROM store WHERE key NOT IN (SELECT key FROM batch)")
def kv_out(spark, d):
    return kv.remove(customers(spark, d), by_customer(spark, d))


@query("kv_scan", f"{_WITH} SELECT key, value FROM store")
def kv_scan(spark, d):
    return customers(spark, d)


@query("kv_get_slice", "SELECT CAST(p_partkey AS VARCHAR) AS key, substr(p_name, 4, 6) AS value FROM part")
def kv_get_slice(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.substring("p_name", 4, 6).alias("value"))


@query("kv_vsiz", "SELECT doc_id AS key, strlen(text) AS size FROM documents")
def kv_vsiz(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.octet_length("text").cast("long").alias("size"))


@query("kv_stats", f"{_WITH} SELECT count(*) AS records, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM store")
def kv_stats(spark, d):
    return customers(spark, d).agg(F.count("*").alias("records"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes"))


@query("kv_roundtrip", f"{_WITH} SELECT key, value FROM store")
def kv_roundtrip(spark, d):
    path = storage.scratch(spark, "kv")
    customers(spark, d).write.parquet(path)
    return spark.read.parquet(path)


@query("kv_repair", f"{_WITH} SELECT key, value FROM store")
def kv_repair(spark, d):
    """A store with a damaged file among its files, read without it and written anew."""
    path = storage.scratch(spark, "kv")
    customers(spark, d).write.parquet(path)
    bad = spark._jvm.org.apache.hadoop.fs.Path(path, "part-99999-damaged.snappy.parquet")
    out = bad.getFileSystem(spark._jsc.hadoopConfiguration()).create(bad)
    out.write(b"PAR1 no longer what it was")
    out.close()
    salvaged(spark, path, "key string, value string").write.parquet(f"{path}-again")
    return spark.read.parquet(f"{path}-again")


def _hash_sql(start: str, factor: int, scale: int, codes: str) -> str:
    return f"((list_reduce(list_prepend(CAST({start} AS BIGINT), {codes}), lambda h, b: (h * {factor} + b) & 4294967295) * {scale}) & 2147483647)"


_CODES = "[CAST(ascii(c) AS BIGINT) for c in string_split(key, '')]"
_OUTER = _hash_sql("774831917", 29, 5157883, f"list_reverse({_CODES})")
_SECOND = _hash_sql("19780211", 37, 43321879, f"list_reverse({_CODES})")
_INNER = _hash_sql("CASE WHEN length(key) = 4 THEN ascii(key[1]) + ascii(key[2]) * 256 + ascii(key[3]) * 65536 + CAST(ascii(key[4]) AS BIGINT) * 16777216 ELSE 751 END", 31, 87767623, _CODES)


@query("hash_outer_partition", f"{_WITH} SELECT CAST({_OUTER} % 17 AS BIGINT) AS part, count(*) AS n FROM store GROUP BY 1")
def hash_outer_partition(spark, d):
    """Records in each of 17 hash partitions: a skew report."""
    return customers(spark, d).select((kv.outer_hash(F.col("key")) % 17).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("hash_inner", f"{_WITH} SELECT key, {_INNER} AS bucket, {_SECOND} AS place FROM store")
def hash_inner(spark, d):
    return customers(spark, d).select("key", kv.inner_hash(F.col("key")).alias("bucket"), kv.second_hash(F.col("key")).alias("place"))


@query("prime_at_least", "SELECT p_partkey AS n, (SELECT min(x) FROM unnest(range(greatest(2, p_partkey), p_partkey + 302)) t(x) WHERE len([q for q in range(2, CAST(floor(sqrt(x)) AS BIGINT) + 1) if x % q = 0]) = 0) AS prime FROM part")
def prime_at_least(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), kv.prime_at_least(F.col("p_partkey")).alias("prime"))


@query("btree_put_dup", f"WITH {_MULTI}, {_BATCH.replace('CAST(o_custkey AS VARCHAR)', 'o_custkey')}, top AS (SELECT key, max(seq) AS t FROM multi GROUP BY key) SELECT key, seq, value FROM multi UNION ALL SELECT b.key, coalesce(t, 0) + seq, value FROM batch b LEFT JOIN top USING (key)")
def btree_put_dup(spark, d):
    return kv.put_dup(lines(spark, d), by_customer(spark, d).withColumn("key", F.col("key").cast("long")))


@query("btree_out_first", f"WITH {_MULTI} SELECT key, seq, value FROM multi QUALIFY seq > min(seq) OVER (PARTITION BY key)")
def btree_out_first(spark, d):
    return kv.remove_first(lines(spark, d))


@query("btree_out_all", f"WITH {_MULTI} SELECT key, seq, value FROM multi WHERE key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def btree_out_all(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return kv.remove(lines(spark, d), gone)


@query("btree_vnum", f"WITH {_MULTI} SELECT key, count(*) AS n FROM multi GROUP BY key")
def btree_vnum(spark, d):
    return lines(spark, d).groupBy("key").agg(F.count("*").alias("n"))


@query("btree_getcat", f"WITH {_MULTI} SELECT key, string_agg(value, '' ORDER BY seq, value) AS value FROM multi GROUP BY key")
def btree_getcat(spark, d):
    return kv.concatenated(lines(spark, d))


@query("btree_getlist", f"WITH {_MULTI} SELECT key, string_agg(value, ',' ORDER BY seq, value) AS list FROM multi GROUP BY key")
def btree_getlist(spark, d):
    return kv.value_lists(lines(spark, d)).select("key", F.array_join("values", ",").alias("list"))


_ORDERS = "SELECT o_orderkey AS key, o_orderstatus AS value FROM orders"


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))


@query("btree_range", f"SELECT * FROM ({_ORDERS}) WHERE key >= 100 AND key < 900")
def btree_range(spark, d):
    return kv.key_range(_orders(spark, d), F.lit(100), F.lit(900))


@query("btree_jump_fwd", f"SELECT * FROM ({_ORDERS}) WHERE key >= 1001 ORDER BY key LIMIT 1")
def btree_jump_fwd(spark, d):
    return kv.jump(_orders(spark, d), F.lit(1001))


@query("btree_jump_back", f"SELECT * FROM ({_ORDERS}) WHERE key <= 1001 ORDER BY key DESC LIMIT 1")
def btree_jump_back(spark, d):
    return kv.jump(_orders(spark, d), F.lit(1001), False)


@query("btree_neighbors", f"WITH k AS (SELECT DISTINCT key FROM ({_ORDERS})) SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM k")
def btree_neighbors(spark, d):
    return kv.neighbors(_orders(spark, d))


def _first_in_order(name: str, sort: str) -> None:
    @query(f"btree_order_{name}", f"WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT CAST(s_acctbal AS VARCHAR) FROM supplier) SELECT key, row_number() OVER (ORDER BY {sort}) AS rank FROM k")
    def ordered(spark, d):
        keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")).unionByName(table(spark, d, "supplier").select(F.col("s_acctbal").cast("string").alias("key")))
        return with_rank(keys, [c.asc_nulls_first() for c in kv.ORDERS[name](F.col("key"))], "rank")


for _name, _sort in (("lex", "key"), ("int", "CASE WHEN regexp_matches(key, '^-?[0-9]+$') THEN CAST(key AS BIGINT) END NULLS FIRST, key"), ("num", "strlen(key), key"), ("dec", "TRY_CAST(key AS DOUBLE) NULLS FIRST, key")):
    _first_in_order(_name, _sort)


def _transaction(spark, d) -> tuple[Versions, object]:
    """A store of one version, and a transaction that wrote a second one."""
    store = Versions(spark, storage.scratch(spark, "versions"))
    first = store.begin()
    first.write(customers(spark, d))
    first.commit()
    txn = store.begin()
    txn.write(kv.put_over(txn.read(), by_customer(spark, d)))
    return store, txn


@query("btree_txn_abort", f"{_WITH} SELECT key, value, 1 AS version FROM store")
def btree_txn_abort(spark, d):
    store, txn = _transaction(spark, d)
    txn.abort()
    return store.read().withColumn("version", F.lit(store.last()))


@query("btree_txn_commit", f"{_WITH} SELECT key, coalesce(b.value, s.value) AS value, 2 AS version FROM store s FULL JOIN ({_LAST}) b USING (key)")
def btree_txn_commit(spark, d):
    store, txn = _transaction(spark, d)
    txn.commit()
    return store.read().withColumn("version", F.lit(store.last()))


@query("lob_scan", """WITH put AS (SELECT 'b' || item_id AS key, CASE WHEN item_id % 3 = 0 THEN reverse(text) ELSE text END AS value FROM benchmark WHERE item_id % 5 <> 0
UNION ALL SELECT 'new' || item_id, text || '!' FROM benchmark WHERE item_id % 3 = 0) SELECT key, strlen(value) AS size, md5(value) AS digest FROM put""")
def lob_scan(spark, d):
    """Large binary values by name: put, put over, deleted, listed with size and digest from storage."""
    path = storage.scratch(spark, "lob")
    b = table(spark, d, "benchmark")
    binary = lambda c: c.cast("binary").alias("value")
    store = b.select(F.concat(F.lit("b"), "item_id").alias("key"), binary(F.col("text")))
    third = b.where("item_id % 3 = 0")
    batch = third.select(F.concat(F.lit("b"), "item_id").alias("key"), F.lit(1).alias("seq"), binary(F.reverse("text"))).unionByName(third.select(F.concat(F.lit("new"), "item_id").alias("key"), F.lit(1).alias("seq"), binary(F.concat("text", F.lit("!")))))
    gone = b.where("item_id % 5 = 0").select(F.concat(F.lit("b"), "item_id").alias("key"))
    kv.remove(kv.put_over(store, batch), gone).write.parquet(path)
    return kv.described(spark.read.parquet(path)).select("key", F.col("size").cast("long").alias("size"), "digest")


@query("env_ops", "SELECT 'user.' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'set' ELSE c_name END AS value FROM customer WHERE c_custkey % 3 <> 0")
def env_ops(spark, d):
    """Settings set, read again and deleted."""
    env = table(spark, d, "customer").select(F.concat(F.lit("user."), "c_custkey").alias("key"), F.col("c_name").alias("value"), "c_custkey")
    set_ = env.where("c_custkey % 2 = 0").select("key", F.lit(1).alias("seq"), F.lit("set").alias("value"))
    return kv.remove(kv.put_over(env.select("key", "value"), set_), env.where("c_custkey % 3 = 0")).select("key", "value")


@query("line_counts", "SELECT source, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(len([x for x in string_split(text, chr(10)) if trim(x, ' ' || chr(9)) = ''])) AS BIGINT) AS blank, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def line_counts(spark, d):
    """Files, lines, blank lines and bytes by source."""
    lines = F.split("text", "\n", -1)
    blank = F.size(F.filter(lines, lambda x: F.trim(x, F.lit(" \t")) == ""))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.size(lines)).alias("lines"), F.sum(blank).alias("blank"), F.sum(F.octet_length("text")).alias("bytes"))


@query("list_dump", "SELECT doc_id AS id, 2 + len(string_split(source, 'r')) AS n, source AS again FROM documents")
def list_dump(spark, d):
    """Lists written as one binary each, and loaded."""
    l = F.concat(F.array(F.lit('a "quoted", one'), F.lit("")), F.split("source", "r"))  # noqa: E741
    kept = table(spark, d, "documents").select(F.col("doc_id").alias("id"), collections.dump(l).alias("data"))
    back = kept.select("id", collections.load_list(F.col("data")).alias("l"))
    return back.where(F.get("l", 0) == 'a "quoted", one').select("id", F.size("l").cast("long").alias("n"), F.array_join(F.slice("l", 3, F.size("l")), "r").alias("again"))


@query("map_dump", "SELECT doc_id AS id, lang, source || chr(10) AS source, 2 AS n FROM documents")
def map_dump(spark, d):
    """Maps written as one binary each, and loaded."""
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.concat("source", F.lit("\n")))
    back = table(spark, d, "documents").select(F.col("doc_id").alias("id"), collections.dump(m).alias("data")).select("id", collections.load_map(F.col("data")).alias("m"))
    return back.select("id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"), F.size("m").alias("n"))


@query("read_lines", "SELECT unnest(string_split(text, chr(10))) AS line FROM documents")
def read_lines(spark, d):
    path = storage.scratch(spark, "lines")
    table(spark, d, "documents").select("text").write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("list_sort", "SELECT doc_id AS id, array_to_string(list_sort(string_split(text, ' ')), ' ') AS sorted FROM documents")
def list_sort(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(F.split("text", " ")), " ").alias("sorted"))


@query("list_search", "SELECT doc_id AS id, coalesce(list_position(string_split(text, ' '), 'the'), 0) - 1 AS pos FROM documents")
def list_search(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.array_position(F.split("text", " "), "the") - 1).cast("int").alias("pos"))


@query("list_ops", "WITH l AS (SELECT doc_id AS id, string_split(source, 'r') AS a, string_split(lang, '') AS b FROM documents) SELECT id, array_to_string(list_append(a, 'end'), '|') AS push, array_to_string(a[1:len(a) - 1], '|') AS pop, array_to_string(a[2:], '|') AS shift, array_to_string(list_prepend('new', a), '|') AS unshift, array_to_string(list_concat(list_append(a[1:1], 'ins'), a[2:]), '|') AS ins, CAST(len(a) AS INT) AS num, a[1] AS val FROM l")
def list_ops(spark, d):
    a = F.split("source", "r")
    join = lambda c: F.array_join(c, "|")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), join(F.array_append(a, F.lit("end"))).alias("push"), join(F.slice(a, F.lit(1), F.size(a) - 1)).alias("pop"), join(F.slice(a, F.lit(2), F.size(a))).alias("shift"),
        join(F.array_prepend(a, F.lit("new"))).alias("unshift"), join(F.array_insert(a, 2, F.lit("ins"))).alias("ins"), F.size(a).alias("num"), F.element_at(a, 1).alias("val"),
    )


@query("map_ops", "SELECT doc_id AS id, 'x' || lang AS over, lang AS keep, lang || source AS cat, 2 AS n, 'lang,source' AS keys, FALSE AS has FROM documents")
def map_ops(spark, d):
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    without = F.map_filter(m, lambda k, v: k != "lang")
    over = F.map_concat(without, F.create_map(F.lit("lang"), F.concat(F.lit("x"), m["lang"])))
    keep = F.map_concat(m, F.map_filter(F.create_map(F.lit("lang"), F.lit("never")), lambda k, v: ~F.map_contains_key(m, k)))
    cat = F.transform_values(m, lambda k, v: F.when(k == "lang", F.concat(v, F.col("source"))).otherwise(v))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), over["lang"].alias("over"), keep["lang"].alias("keep"), cat["lang"].alias("cat"), F.size(m).alias("n"), F.array_join(F.map_keys(m), ",").alias("keys"), F.map_contains_key(without, "lang").alias("has"))
