"""The revision graph: (id, parent_id, revision) rows, roots with parent NONE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.sources.storage import Rounds

ROOT = "NONE"


def tree(revisions: DataFrame) -> DataFrame:
    """id, children (sorted) of every revision, leaves with an empty list, and of the root. Children of one parent are as many
    as were made from it by hand; the list is what the tree is."""
    kids = revisions.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    ids = revisions.select("id").unionByName(revisions.where(F.col("parent_id") == ROOT).select(F.col("parent_id").alias("id")).distinct())
    return ids.join(kids, "id", "left").select("id", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def children(revisions: DataFrame, of: DataFrame) -> DataFrame:
    """parent_id, id for the parents given as id."""
    return revisions.join(of.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("parent_id", "id")


def parent(revisions: DataFrame) -> DataFrame:
    return revisions.select("id", "parent_id")


def depths(revisions: DataFrame) -> DataFrame:
    """id, root, depth (0 at a root) by pointer doubling: after round n every revision knows its ancestor 2^n steps up, so rounds
    grow with the logarithm of the longest chain and no recursion limit applies. Each round is written to the shared folder.

    Defined results: a revision whose parent is unknown is a root; of what leads into a cycle of parents, root and depth are null;
    an empty table gives no rows. Ids are unique."""
    ids = revisions.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    known = revisions.select("id", "parent_id").join(ids, "parent_id", "left").withColumn("top", F.col("_known").isNull() | (F.col("parent_id") == ROOT))
    rounds = Rounds("lineage")
    up = rounds.next(known.select("id", F.when(F.col("top"), F.col("id")).otherwise(F.col("parent_id")).alias("up"), F.when(F.col("top"), 0).otherwise(1).cast("long").alias("depth"), "top"))
    total, left = up.agg(F.count("*"), F.count_if(~F.col("top"))).first()
    for _ in range(int(total).bit_length()):  # a chain without a cycle is shorter than that
        if not left:
            break
        above = up.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("top").alias("_t"))
        moved = up.where("not top").join(above, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_t").alias("top"))
        up = rounds.next(up.where("top").unionByName(moved))
        left = up.where("not top").count()
    return up.select("id", F.when(F.col("top"), F.col("up")).alias("root"), F.when(F.col("top"), F.col("depth")).cast("int").alias("depth"))


def paths(revisions: DataFrame, limit: int = 100) -> DataFrame:
    """id, path (ids from the root on, joined by /) by a recursive common table expression; chains may be `limit` long."""
    return revisions.sparkSession.sql(
        f"""WITH RECURSIVE p(id, path) MAX RECURSION LEVEL {limit} AS (
              SELECT id, id FROM {{revisions}} WHERE parent_id = '{ROOT}'
              UNION ALL SELECT r.id, concat(p.path, '/', r.id) FROM {{revisions}} r JOIN p ON r.parent_id = p.id)
            SELECT id, path FROM p""",
        revisions=revisions,
    )


def readable_names(revisions: DataFrame) -> DataFrame:
    """id, name: the revision; with `-` and three characters of the id where a sibling has the same; with the author's e-mail
    in front where that still is not unique. revisions has id, parent_id, revision, email."""
    named = revisions.withColumn("n1", F.col("revision")).withColumn("n2", F.concat("revision", F.lit("-"), F.substring("id", 1, 3)))
    same1 = named.groupBy("parent_id", "n1").agg(F.count("*").alias("c1"))
    same2 = named.groupBy("parent_id", "n2").agg(F.count("*").alias("c2"))
    both = named.join(same1, ["parent_id", "n1"]).join(same2, ["parent_id", "n2"])
    return both.select("id", F.when(F.col("c1") == 1, F.col("n1")).when(F.col("c2") == 1, F.col("n2")).otherwise(F.concat("email", F.lit("-"), "n2")).alias("name"))


def resolve(revisions: DataFrame, names: DataFrame) -> DataFrame:
    """revision, matches, id: the only revision of that name, else null (several or none). Names come as `revision`."""
    counts = revisions.groupBy("revision").agg(F.count("*").alias("n"), F.min("id").alias("_id"))
    return names.join(counts, "revision", "left").select("revision", F.coalesce("n", F.lit(0)).alias("matches"), F.when(F.col("n") == 1, F.col("_id")).alias("id"))


def _kind(c: Column) -> Column:
    """d for a digit, l and u for letters, empty for others."""
    return F.when(c.rlike("^[0-9]$"), "d").when(c.rlike("^[a-z]$"), "l").when(c.rlike("^[A-Z]$"), "u").otherwise("")


def successor(name: Column) -> Column:
    """The next revision name: the last dotted component counts up.

    Its last letter or digit moves on by one; past 9, z and Z it begins again and carries to the letter or digit before it, and
    in front of the first one a new 1, a or A is put: 1.009 to 1.010, a.b to a.c, az to ba, 9 to 10. A carry passes other
    characters, but there only from letters to letters and from digits to digits. Without letters and digits the last character
    moves on."""
    head, last = F.regexp_extract(name, r"^(?s)(.*\.)?([^.]*)$", 1), F.regexp_extract(name, r"^(?s)(.*\.)?([^.]*)$", 2)
    none = F.lit("")
    # from the end: what is done, characters passed since the last letter or digit, whether to carry, the kind that carried
    start = F.struct(none.alias("out"), none.alias("gap"), F.lit(True).alias("carry"), none.alias("kind"))

    def step(s: Column, c: Column) -> Column:
        kind = _kind(c)
        apart = (s["gap"] != "") & (s["kind"] != "") & ((kind == "d") != (s["kind"] == "d"))
        moves = s["carry"] & (kind != "") & ~apart
        ends = c.isin("9", "z", "Z")
        begin = F.when(kind == "d", "0").when(kind == "l", "a").otherwise("A")
        next_one = F.when(ends, begin).otherwise(F.char(F.ascii(c) + 1))
        first = F.when(s["kind"] == "d", "1").when(s["kind"] == "l", "a").otherwise("A")
        stopped = s["carry"] & (kind != "") & apart  # the new character goes in front of the kind that carried
        passes = s["carry"] & (kind == "")
        out = F.when(moves, F.concat(next_one, s["gap"], s["out"])).when(stopped, F.concat(c, s["gap"], first, s["out"])).when(passes, s["out"]).otherwise(F.concat(c, s["gap"], s["out"]))
        return F.struct(out.alias("out"), F.when(passes, F.concat(c, s["gap"])).otherwise(none).alias("gap"), (passes | (moves & ends)).alias("carry"), F.when(moves, kind).otherwise(s["kind"]).alias("kind"))

    def done(s: Column) -> Column:
        first = F.when(s["kind"] == "d", "1").when(s["kind"] == "l", "a").otherwise("A")
        plain = F.concat(F.substr(last, F.lit(1), F.length(last) - 1), F.char(F.ascii(F.substr(last, F.length(last))) + 1))
        return F.when(s["carry"] & (s["kind"] == ""), plain).when(s["carry"], F.concat(s["gap"], first, s["out"])).otherwise(F.concat(s["gap"], s["out"]))

    return F.concat(head, F.when(last == "", last).otherwise(F.aggregate(F.reverse(F.split(last, "")), start, step, done)))


def guarded(candidates: DataFrame, top: Column) -> DataFrame:
    """Candidates that may be applied: their parent is the top of the path, or the path is empty."""
    return candidates.where(top.isNull() | (F.col("parent_id") == top))
