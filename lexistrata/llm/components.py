"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.sources.storage import Rounds


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. large: every larger neighbour of u joins the least node near u; small: every smaller neighbour and u do."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # dealt anew, so that both sides of the join come straight from a shuffle: only such a join is split where a hub has most edges
    moved = near.join(least.repartition(F.xxhash64("a")), "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(a long, b long) edges, any direction, to (node, root): each node that has an edge, and the least node it can reach.

    Only the number and a sum over edges reach the driver, once a round. Each round is written to the shared folder, so the
    plan does not grow and a lost executor costs one round at most. Minima are aggregated before they are shuffled, and the
    join back to a hub's edges is one that adaptive execution splits. The rounds grow with the logarithm of the longest
    chain, and a finished round's table is deleted. Loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    rounds = Rounds(label)
    now = rounds.next(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(sign) or not sign[0]:
            break
        seen = tuple(sign)
        now = rounds.next(_stars(_stars(now, True), False))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
