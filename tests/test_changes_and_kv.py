import random

import pytest
from pyspark.sql import functions as F

from lexistrata.operators import changes as ch
from lexistrata.operators import keyvalue as kv
from lexistrata.operators import lineage as ln
from lexistrata.plans.registry import Registry
from lexistrata.sources import catalog, files, mail, storage
from lexistrata.sources.versions import Conflict, Versions
from lexistrata.streaming import incremental

SNAP = "path string, content string, mtime long"


def random_tree(rnd):
    return {f"./{rnd.choice('ab')}/{rnd.choice(['x', 'y', 'z/w'])}/{rnd.randint(0, 30)}.txt": ("" if rnd.random() < 0.1 else f"text {rnd.randint(0, 50)}", rnd.randint(0, 3)) for _ in range(40)}


@pytest.mark.parametrize("seed", range(4))
def test_journal_turns_one_tree_into_the_other(spark, seed, tmp_path):
    rnd = random.Random(seed)
    a, b = random_tree(rnd), random_tree(rnd)
    for p in list(a)[:6]:  # moved files
        if p not in b:
            b["./moved/" + p.rsplit("/", 1)[1]] = a[p]
    b = {p: (c, m if p not in a or a[p][0] == c else a[p][1] + 1) for p, (c, m) in b.items()}  # a new text comes with a new time
    frames = [spark.createDataFrame([(p, c, m) for p, (c, m) in t.items()], SNAP) for t in (a, b)]
    ops = ch.journal(*frames).cache()
    rows = ops.orderBy("seq").collect()
    files = [r for r in rows if r.type != "directory"]
    assert [r.seq for r in files] == list(range(len(files))) and {r.seq for r in rows if r.type == "directory"} <= {len(files)}
    assert [ch.TYPES.index(r.type) for r in rows] == sorted(ch.TYPES.index(r.type) for r in rows)
    there = ch.apply_journal(frames[0], ops)
    assert {r.path: r.content for r in there.collect()} == {p: c for p, (c, _) in b.items()}
    ch.write_changeset(*frames, str(tmp_path))
    back = ch.undo(ch.apply_journal(frames[0], ch.read_changeset(spark, str(tmp_path))), str(tmp_path))
    assert {r.path: r.content for r in back.collect()} == {p: c for p, (c, _) in a.items()}
    verdicts = {r.type: set() for r in rows}
    for r in ch.verdicts(ops, frames[0]).collect():
        verdicts[r.type].add(r.verdict)
    assert all(v == {1} for v in verdicts.values())
    assert ch.test_failures(ops, frames[0]).first().failures == 0


def test_verdict_table(spark):
    md5 = lambda s: spark.range(1).select(F.md5(F.lit(s))).first()[0]
    state = spark.createDataFrame([("same", "x", 0), ("other", "y", 0), ("target", "z", 0)], SNAP)
    ops, want, n = [], {}, 0
    for kind, by_path in {"delete": {"same": 1, "other": -1, "none": 0}, "create": {"same": 0, "other": -1, "none": 1}, "delta": {"same": 1, "other": -1, "none": -1}}.items():
        for path, v in by_path.items():
            ops.append((n, kind, path, None, md5("x"), None))
            want[n], n = v, n + 1
    for path, to, v in (("same", "new", 1), ("other", "new", -1), ("none", "target", 0), ("none", "new", -1)):
        ops.append((n, "move", path, to, md5("x"), None))
        want[n], n = v, n + 1
    df = spark.createDataFrame(ops, "seq int, type string, path string, to_path string, digest string, created boolean")
    assert {r.seq: r.verdict for r in ch.verdicts(df, state).collect()} == want
    dirs = spark.createDataFrame([(0, "directory", "d", None, None, False), (0, "directory", "c", None, None, True)], df.schema)
    for have, v in ((["d", "c"], 1), (["c"], 0), ([], 1)):
        present = spark.createDataFrame([(x,) for x in have], "path string")
        assert ch.verdicts(dirs, state, present).first().verdict == v
    with pytest.raises(Exception, match="unknown operation"):
        ch.verdicts(spark.createDataFrame([(0, "format", "same", None, "", None)], df.schema), state).collect()


def test_deltas_carry_the_edit_alone(spark):
    """An edited word costs its delta, a new time without a new text nothing."""
    text = "many words of a long text " * 400
    a = spark.createDataFrame([("./a", text, 0), ("./b", text, 0), ("./c", "", 0)], SNAP)
    b = spark.createDataFrame([("./a", text[:5000] + "EDIT" + text[5000:], 1), ("./b", text, 1), ("./c", "now", 1)], SNAP)
    rows = {r.path: r for r in ch.journal(a, b).collect()}
    assert rows["./a"].type == "delta" and rows["./a"].content is None and sum(len(o.data) for o in rows["./a"].ops if o.data) < 40
    assert rows["./b"].type == "delta" and rows["./b"].ops is None and rows["./c"].type == "create"
    assert sorted(map(tuple, ch.apply_journal(a, ch.journal(a, b)).collect())) == sorted(map(tuple, b.collect()))


def test_unique_basename_is_needed_for_a_move(spark):
    a = spark.createDataFrame([("./a/f", "x", 0), ("./b/f", "x", 0), ("./a/g", "q", 0)], SNAP)
    b = spark.createDataFrame([("./c/f", "x", 0), ("./c/g", "q", 5)], SNAP)
    assert [(r.path, r.to_path, r.mtime) for r in ch.moved(a, b).collect()] == [("./a/g", "./c/g", 5)]


def test_key_value(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    batch = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("c", 1, "z"), ("c", 2, "w")], "key string, seq long, value string")
    got = lambda df: {r.key: r.value for r in df.collect()}
    assert got(kv.put_over(store, batch)) == {"a": "1", "b": "y", "c": "w"}
    assert got(kv.put_keep(store, batch)) == {"a": "1", "b": "2", "c": "z"}
    assert got(kv.put_cat(store, batch)) == {"a": "1", "b": "2xy", "c": "zw"}
    assert got(kv.remove(store, batch)) == {"a": "1"}
    assert {(r.key, r.seq) for r in kv.remove_first(batch).collect()} == {("b", 2), ("c", 2)}
    keys = spark.createDataFrame([(k,) for k in (5, 1, 9, 3, 3)], "key int")
    assert sorted(tuple(r) for r in kv.neighbors(keys, 3).collect()) == [(1, None, 3), (3, 1, 5), (5, 3, 9), (9, 5, None)]
    assert kv.jump(keys, F.lit(4)).first().key == 5 and kv.jump(keys, F.lit(4), False).first().key == 3 and kv.jump(keys, F.lit(10)).collect() == []


def test_lineage(spark):
    chain = [(str(i), ln.ROOT if i == 0 else str(i - 1)) for i in range(150)] + [("b1", "3"), ("b2", "3")]
    df = spark.createDataFrame([(i, p, "r", "e@x") for i, p in chain], "id string, parent_id string, revision string, email string")
    depth = {r.id: (r.root, r.depth) for r in ln.depths(df).collect()}
    assert depth["149"] == ("0", 149) and depth["b1"] == ("0", 4)
    paths = {r.id: r.path for r in ln.paths(df.where("length(id) = 1 or id in ('b1', 'b2')"), 1000).collect()}
    assert paths["b2"] == "0/1/2/3/b2"
    names = {r.id: r.name for r in ln.readable_names(df).collect()}
    assert names["7"] == "r" and names["b1"] == "r-b1"
    assert {r.id: r.children for r in ln.tree(df).collect()}["3"] == ["4", "b1", "b2"]


def test_lineage_of_broken_trees(spark):
    """Cycles have no root, a revision of an unknown parent is one."""
    rows = [("a", ln.ROOT), ("b", "a"), ("o", "unknown"), ("p", "o"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")]
    out = ln.depths(spark.createDataFrame(rows, "id string, parent_id string"))
    assert sorted(map(tuple, out.collect())) == [("a", "a", 0), ("b", "a", 1), ("o", "o", 0), ("p", "o", 1), ("s", None, None), ("x", None, None), ("y", None, None), ("z", None, None)]
    assert ln.depths(out.limit(0).select("id", F.col("root").alias("parent_id"))).collect() == []


def test_successors(spark):
    want = {"1.9": "1.10", "1.009": "1.010", "a.b": "a.c", "az": "ba", "9": "10", "zz99": "aaa00", "a!": "b!", "a-9": "a-10", "Zz": "AAa", "***": "**+", "<<koala>>": "<<koalb>>", "v1.": "v1.", "0.5.9": "0.5.10", "1.zz": "1.aaa", "-9": "-10", "rc1": "rc2", "": ""}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", ln.successor(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == want


def test_files(spark, tmp_path):
    for p in ("a/x.txt", "a/.hid", ".git/y", "CVS/z", "b.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("hello " + p)
    assert {(r.path, r.content) for r in files.snapshot(spark, str(tmp_path)).collect()} == {("./a/x.txt", "hello a/x.txt"), ("./b.txt", "hello b.txt")}
    assert files.tree(spark, str(tmp_path), content=False).columns == ["path", "size", "mtime"]
    assert [r.path for r in files.tree(spark, str(tmp_path), excludes=["^./a/", "z$"]).collect()] == ["./b.txt"]
    assert files.find_up(spark, str(tmp_path / "a"), "b.txt").endswith(tmp_path.name) and files.find_up(spark, str(tmp_path / "a"), "no such name") is None


def test_transactions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    assert store.last() == 0
    df = lambda *rows: spark.createDataFrame([(k, v) for k, v in rows], "key string, value string")
    first = store.begin()
    first.write(df(("a", "1")))
    assert store.last() == 0 and first.commit() == 1
    one, two = store.begin(), store.begin()
    one.write(df(("a", "2")))
    two.write(df(("a", "3")))
    two.write(kv.put_over(two.read(), df(("b", "4")).withColumn("seq", F.lit(1))))
    assert {tuple(r) for r in two.read().collect()} == {("a", "3"), ("b", "4")} and {tuple(r) for r in store.read().collect()} == {("a", "1")}
    assert one.commit() == 2 and {tuple(r) for r in store.read().collect()} == {("a", "2")}
    with pytest.raises(Conflict):
        two.commit()
    two.abort()
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["v1", "v2"] and store.begin().commit() == 2


def test_mailbox(spark, tmp_path):
    rows = [("Subject: a\nX-A: 1", "From here on\n>From there\n\nend\n\n"), ("Subject: b", "")]
    spark.createDataFrame(rows, "h string, b string").coalesce(1).select(mail.mbox_row(F.col("h"), F.col("b")).alias("value")).write.text(str(tmp_path / "m"))
    got = [(r.headers, r.body) for r in mail.mbox(spark, str(tmp_path / "m")).collect()]
    assert got == [({"subject": "a", "x-a": "1"}, "From here on\n>From there\n\nend"), ({"subject": "b"}, "")]


def test_hot_keys_are_joined_by_parts(spark):
    rows = [("hot", i, f"{i},") for i in range(9000)] + [("b", 1, "x"), ("b", None, "first")]
    df = spark.createDataFrame(rows, "key string, seq long, value string").repartition(7)
    got = {r.key: r.value for r in kv.concatenated(df).collect()}
    assert got == {"hot": "".join(f"{i}," for i in range(9000)), "b": "firstx"}
    assert {r.key: r["values"] for r in kv.value_lists(df).collect()}["hot"] == [f"{i}," for i in range(9000)]


def test_storage_needs_a_shared_folder_off_a_local_master(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "a"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_registry(spark):
    r, seen = Registry(), []

    @r.operator("numbers")
    def numbers(s, p):
        return s.range(p["n"])

    r.before.append(lambda name, p: seen.append((name, dict(p))))
    r.after.append(lambda name, df: df.where("id > 0"))
    assert r.run(spark, "numbers", n=3).count() == 2 and seen == [("numbers", {"n": 3})]
    with pytest.raises(KeyError, match="known: numbers"):
        r.run(spark, "other")
    with pytest.raises(ValueError):
        r.operator("numbers")(numbers)


def test_stream_keeps_the_index_current(spark, tmp_path):
    schema = "id long, uri string, date long, text string"
    inbox, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "u1", 1, "red fox"), (2, "u2", 1, "dog")], schema).coalesce(1).write.parquet(inbox)
    stream = lambda: incremental.index_stream(spark.readStream.schema(schema).parquet(inbox), out, ck, availableNow=True)
    stream().awaitTermination()
    spark.createDataFrame([(3, "u1", 2, "blue")], schema).coalesce(1).write.mode("append").parquet(inbox)
    stream().awaitTermination()
    index = incremental.current(spark, out)
    assert {(r.id, r.uri) for r in index.docs.collect()} == {(3, "u1"), (2, "u2")}
    assert {(r.word, r.id) for r in index.postings.collect()} == {("blue", 3), ("dog", 2)}


def test_catalog_round_trip(spark):
    from lexistrata.operators import index as ix

    df = spark.createDataFrame([(1, "u", "red red fox")], "id long, uri string, text string")
    path = storage.scratch(spark, "test")
    catalog.save(ix.build(df, "id", F.col("uri"), "text"), path)
    assert {r.word for r in catalog.load(spark, path).postings.collect()} == {"red", "fox"}
    with pytest.raises(Exception, match="(?i)exists"):
        catalog.save(ix.build(df, "id", F.col("uri"), "text"), path)
    catalog.save(ix.build(df.withColumn("text", F.lit("blue")), "id", F.col("uri"), "text"), path, "overwrite")
    assert {r.word for r in catalog.load(spark, path).postings.collect()} == {"blue"} and catalog.load(spark, path).docs.count() == 1


def test_look_up_of_a_word_is_pruned(spark):
    """A search of a saved catalog reads postings alone, filtered by word in the scan, and analyses no text."""
    from lexistrata.plans import boolean

    df = spark.createDataFrame([(i, f"u{i}", f"red fox number{i}") for i in range(50)], "id long, uri string, text string")
    found = catalog.opened(spark, "test of pruning", lambda path: catalog.index_texts(df, path, "id", F.col("uri"), "text"))
    again = catalog.opened(spark, "test of pruning", lambda path: pytest.fail("made twice"))
    for result in (boolean.run("red & number7", found.postings)[0], boolean.run("number7", again.postings)[0]):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "word" in plan.split("PushedFilters: [")[1].split("\n")[0] and "regexp" not in plan and "nwords" not in plan
        assert [r.id for r in result.collect()] == [7]


def test_an_uri_twice_in_a_batch_is_one_document(spark):
    from lexistrata.operators import index as ix

    base = ix.build(spark.createDataFrame([(1, "u", "old")], "id long, uri string, text string"), "id", F.col("uri"), "text")
    new = ix.documents(spark.createDataFrame([(1, "u", "one"), (2, "u", "two"), (3, "v", "three")], "n long, uri string, text string"), "n", F.col("uri"), "text").withColumnRenamed("id", "n")
    over = ix.put(base, new, order="n").docs.collect()
    assert sorted((r.uri, r.nwords) for r in over) == [("u", ["two"]), ("v", ["three"])] and len({r.id for r in over}) == 2
    assert sorted((r.uri, r.nwords) for r in ix.put(base, new, over=False, order="n").docs.collect()) == [("u", ["old"]), ("v", ["three"])]


def test_similarity_loses_no_pair(spark):
    from lexistrata.operators import index as ix

    rnd = random.Random(3)
    rows = {i: {w: rnd.choice([1, 2, 5]) for w in rnd.sample(["common", "usual", "a", "b", "c", "d", "e", "f"], 4) + ["the"]} for i in range(40)}
    keys = spark.createDataFrame([(i, w, n) for i, v in rows.items() for w, n in v.items()], "id long, word string, num long")
    for least in (0.5, 0.9):
        want = {}
        for a in rows:
            for b in rows:
                dot = sum(n * rows[b].get(w, 0) for w, n in rows[a].items())
                cosine = dot / (sum(n * n for n in rows[a].values()) * sum(n * n for n in rows[b].values())) ** 0.5
                if a < b and cosine >= least - 1e-9:
                    want[a, b] = (dot, round(cosine, 9))
        assert {(r.a, r.b): (r.dot, round(r.cosine, 9)) for r in ix.similarity(keys, least).collect()} == want
