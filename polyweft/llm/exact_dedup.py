"""Exact deduplication with a split of heavy hitters.

Texts are equal when identical after each run of white space is one space. One pass takes the SHA-256 of every
text; all that follows works on these small rows.

Misra-Gries: Spark's frequent-items sketch keeps ``TRACKED`` counters per task; sketches are merged in two steps,
those of some tasks first. It names up to ``HEAVY`` digests, which is the size bound of the broadcast. What it
names is counted exactly with map-side sums, the verified winners are broadcast, and their rows leave without a
shuffle. Whatever the sketch leaves out stays right: the other digests are summed with map-side aggregation and
the sums joined back to their rows, so a group is spread over a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweft.llm.common import SPACE, free_name, text_of, written

#: Counters of a sketch, heavy digests that are broadcast at most (64 characters each), and sketches of the first merge.
TRACKED, HEAVY, MERGED = 8192, 1024, 64


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row."""
    normal = F.regexp_replace(text_of(text_col), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normal.cast("binary"), 256).alias("text_sha256"))


def heavy_hitters(rows: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) of the digests that the sketch names, counted exactly."""
    tasks = rows.select("text_sha256", (F.spark_partition_id() % MERGED).alias("part"))
    parts = tasks.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(text_sha256, {TRACKED})").alias("sketch"))
    # grouped, so that an empty table has no sketch
    top = parts.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch")).select(F.expr(f"approx_top_k_estimate(sketch, {HEAVY})").alias("top"))
    named = top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    # at most HEAVY digests, by the sketch's own limit
    return rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty; empty texts equal each other. A group keeps its smallest id; null ids come last,
    and a group of null ids only has a null keep_id. Rows that repeat an id and a text are one group like any
    other, all of them kept if theirs is the smallest id. Ids may be of any type that has an order. An empty
    table gives no rows.
    """
    rows = written(digested(docs, id_col, text_col), "digests")
    heavy = written(heavy_hitters(rows), "heavy")
    marked = rows.join(F.broadcast(heavy), "text_sha256", "left")
    hot = marked.where("group_size is not null")
    rest = marked.where("group_size is null").select(*rows.columns)
    sums = written(rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "sums")
    both = hot.unionByName(rest.join(sums.hint("merge"), "text_sha256"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; of rows that share the kept id and text, one stays.

    A null id is a key of its own, apart from any other. One shuffle of the texts, by id and digest; the merge
    join's order serves the last step as well.
    """
    key, none, digest = free_name(docs, "id_key", "id_null", "text_sha256")
    small = groups(docs, id_col, text_col).where("kept")
    as_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stay = small.select(as_key("doc_id").alias(key), F.col("doc_id").isNull().alias(none), F.col("text_sha256").alias(digest)).distinct()
    named = docs.withColumns({key: as_key(id_col), none: F.col(id_col).isNull(), digest: F.sha2(F.regexp_replace(text_of(text_col), SPACE, " ").cast("binary"), 256)})
    return named.join(stay.hint("merge"), [key, none, digest], "left_semi").dropDuplicates([key, none, digest]).drop(key, none, digest)
