"""Connected components over links, by alternating star contractions; every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweft.llm.common import MOST_SENT, looked_up, met, written

#: Neighbours from which a node is a hub; there are at most twice the links over this many hubs.
HUB = 256


def _with_least(links: DataFrame, least: DataFrame, nodes: int) -> DataFrame:
    """``links`` (u, v) with m, the least v of each u, as ``least`` has it. Few nodes are broadcast; of many a hub's links stay where they are and its minimum is looked up."""
    if nodes <= MOST_SENT:
        return links.join(F.broadcast(least.select("u", "m")), "u")
    marked = looked_up(links, least.where(F.col("n") > HUB).select("u", F.col("m").alias("hub")), "u")
    few = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(few)


def _least(links: DataFrame) -> tuple[DataFrame, int, int]:
    """(u, m, n): the least v of each u and the number of its links, summed map-side; how many u there are; how many of them have a smaller v and others."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    nodes, between = least.agg(F.count(F.lit(1)), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
    return least, nodes, between


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them. ``links`` have u > v."""
    least, nodes, _ = _least(links)
    led = _with_least(links, least, nodes)
    return led.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(led.where("v = m").select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that stands in a link, once each, as read from a written table; root is the least node of the component.

    Loops and repeated links are allowed. Each round is written to the shared folder; rounds grow with the
    logarithm of the longest chain. They end when all links are stars: a node has one link or is less than all its neighbours.
    """
    now = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, nodes, between = _least(both)
        if not between:
            break
        # large star: each node hands its larger neighbours to the least of its neighbourhood, one row a link
        stars = written(_with_least(both, least, nodes).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "stars")
        now = written(_small_star(stars).where("u != v").distinct(), "links")
    else:
        raise RuntimeError("the components did not settle")
    return least.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links of ``found``, a result of it, and of more ``links`` (a, b): only links between different roots go through rounds."""
    rooted = links.select("a", "b")
    for side in ("a", "b"):
        roots = found.select(F.col("node").alias(side), F.col("root").alias("of"))
        rooted = met(rooted, roots, side).withColumn(side, F.coalesce("of", side)).drop("of")
    rooted = written(rooted.where("a != b").distinct(), "between-roots")
    if rooted.isEmpty():
        return found
    more = components(rooted)
    moved = looked_up(found, more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root")
    # a root stands on both sides, with the same new root
    return written(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(more).distinct(), "roots")
