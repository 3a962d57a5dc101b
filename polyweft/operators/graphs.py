"""Connected components of a relation of edges, and ranks along chains, in a number of rounds that grows with the logarithm of their size.

Each round is written, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweft.storage import written


def components(edges: DataFrame, group: str = "image_id") -> DataFrame:
    """(group, node, root): of edges (group, a, b) the least node that each node is connected to.

    Large stars and small stars in turn: every node links its larger neighbours, then itself and its smaller ones,
    to the least of them. Least neighbours are found by map-side aggregation; a node of many neighbours is one
    large key of a plain join, which Spark splits. Repeated edges, loops and an empty relation are fine.
    """
    e = edges.select(group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = written(e.where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(group, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(group, "a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.join(least, [group, "a"]).where("b > a").select(group, F.col("b").alias("a"), F.col("least").alias("b"))
        # small star: all of a node's links go to smaller nodes now
        least = large.groupBy(group, "a").agg(F.min("b").alias("least"))
        small = large.join(least, [group, "a"])
        linked = small.select(group, "a", F.col("least").alias("b")).unionByName(small.where("b <> least").select(group, F.col("b").alias("a"), F.col("least").alias("b")))
        e = written(linked.distinct(), "edges")
        # what an equal relation has, whatever its order
        now = e.agg(F.count("*"), F.sum(F.xxhash64(group, "a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(group, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(group, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def ranks(links: DataFrame, group: str = "image_id") -> DataFrame:
    """(group, node, first, rank, closed) of links (group, node, next): where each node stands in its chain.

    Every node follows one node and is followed by one, at most. The first of an open chain has no node before it,
    the first of a closed one is its least. Each node looks twice as far back in every round, by a join on itself.
    """
    nodes = links.select(group, "node").unionByName(links.select(group, F.col("next").alias("node"))).distinct()
    before = links.select(group, F.col("next").alias("node"), F.col("node").alias("jump"))
    # the best node seen so far: one without a node before it, else the least; and how many steps back it is
    state = nodes.join(before, [group, "node"], "left").select(group, "node", "jump", F.struct(F.col("jump").isNotNull().alias("later"), F.col("node").alias("node"), F.lit(0).cast("long").alias("steps")).alias("best"))
    state = written(state, "chains")
    ahead = 1
    while True:
        other = state.select(group, F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("best").alias("theirs"))
        moved = F.struct(F.col("theirs.later").alias("later"), F.col("theirs.node").alias("node"), (F.col("theirs.steps") + ahead).alias("steps"))
        joined = state.join(other, [group, "jump"], "left")
        better = F.col("theirs").isNotNull() & (moved < F.col("best"))
        state = written(joined.select(group, "node", F.col("further").alias("jump"), F.when(better, moved).otherwise(F.col("best")).alias("best"), F.coalesce(better, F.lit(False)).alias("moved")), "chains")
        if not state.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            break
        state = state.drop("moved")
        ahead *= 2
    return state.select(group, "node", F.col("best.node").alias("first"), F.col("best.steps").alias("rank"), F.col("best.later").alias("closed"))
