"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w, u being a uniform number made of its id, its text and a seed and w its quality
weight; the documents of a source in the order of their keys are a weighted sample without replacement, whatever
prefix is taken. A source's target is first filled by complete epochs, then by the prefix of the next epoch
whose sizes come nearest to what is left.

The prefix sum needs no sort of a source. The logarithm of a key has a density of 0.37 at most, whatever the
weights, so equal steps of it are buckets whose share of a source is bounded. Sizes are summed by bucket with
map-side aggregation and buckets are the leaves of a tree of ``FAN`` children a node; the way down to the bucket
in which a budget ends is a window over ``FAN`` rows a source at each level. The documents of that bucket alone,
some hundred at most, are put in order. What is found is one cut a source: whether a document is taken once
more is a comparison of its own key with the cut, and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweft.llm.common import free_name, looked_up, text_of, word_count, written
from polyweft.llm.quality import Rating

SEED = 20
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Children of a node of buckets, documents that a last bucket should hold at most in the mean, and the range of ln(key).
FAN, PER_BUCKET, LEAST_LN, MOST_LN = 64, 256, -45.0, 6.0
#: Mean word length, white space included, of prose: the weight where no score of a classifier is given.
PROSE = 6.2


def _prose(text: Column) -> Column:
    return F.exp(-F.abs(F.ln((F.char_length(text) + 1.0) / (word_count(text) + 1.0) / F.lit(PROSE))))


#: Between 0 and 1: how near the mean length of a word is to that of prose.
PROSE_RATING = Rating(_prose, lambda rows: lambda measure: measure)


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, n_docs) with target: shares by weight, capped, the excess given again by weight.

    The capped shares are the water level: with sources in the order of cap / weight, those before the level
    stand at their cap, and the level is what the caps leave, divided by the weights left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * float(MOST_EPOCHS))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = capped.withColumns({
        "left": F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("left") / F.col("weights"))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    shared = level.withColumn("common", F.max(F.when(~full, F.col("level"))).over(everything))
    return shared.select("source", "source_size", "n_docs", F.when(F.col("common").isNull() | full, F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _uniform(doc_id: Column, text: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id, text), 11) + 0.5) / float(2**53)


def _key(uniform: Column, score: Column) -> Column:
    """The sampling key. Scores are rounded, lest the last bits of a sum decide; they weigh from 0.1 to 1."""
    weight = F.lit(0.1) + 0.9 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.coalesce(score, F.lit(0.0)), 6)))
    return -F.ln(uniform) / weight


def _bucket(key: Column, buckets: int) -> Column:
    at = F.floor((F.ln(key) - LEAST_LN) / (MOST_LN - LEAST_LN) * buckets)
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), at)).cast("long")


def _order() -> Column:
    """Documents of a source by key; equal keys by id and text."""
    return F.struct("key", "doc_id", "tie")


def cuts(keyed: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target, epochs, buckets, last (bucket) and cut (the last document of it that is taken)."""
    sources = written(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))), "sources")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = sources.select("source", "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))
    largest, depth = sources.agg(F.max("n_docs")).first()[0] or 0, 1
    while FAN**depth * PER_BUCKET < largest * 0.37 * (MOST_LN - LEAST_LN):
        depth += 1
    buckets = FAN**depth
    sums = written(keyed.groupBy("source", _bucket(F.col("key"), buckets).alias("bucket")).agg(F.sum("size").alias("words")), "bucket-words")
    at = budget.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("before"))
    siblings = Window.partitionBy("source").orderBy("child")
    for level in range(1, depth + 1):
        child = sums.groupBy("source", F.floor(F.col("bucket") / FAN ** (depth - level)).alias("child")).agg(F.sum("words").alias("words"))
        under = child.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("child") / FAN) == F.col("node")))
        reached = under.withColumn("until", F.col("before") + F.sum("words").over(siblings)).where("until >= rest").withColumn("n", F.row_number().over(siblings)).where("n = 1")
        at = reached.select(F.col("source").alias("s"), "rest", F.col("child").alias("node"), (F.col("until") - F.col("words")).alias("before"))
    ends = written(at.withColumnsRenamed({"s": "source", "node": "last"}), "ends")
    edge = looked_up(keyed, ends, "source", "inner").where(_bucket(F.col("key"), buckets) == F.col("last"))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = edge.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).where(F.col("ahead") + F.col("size") / 2.0 < F.col("rest"))
    last = taken.groupBy(F.col("source").alias("s2")).agg(F.max(_order()).alias("cut"))
    both = budget.join(ends.select(F.col("source").alias("s1"), "last"), F.col("source").eqNullSafe(F.col("s1")), "left").join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
    return written(both.select("source", "source_size", "target", "epochs", F.lit(buckets).alias("buckets"), "last", "cut"), "cuts")


def _copies(bucket: Column, order: Column, epochs: Column, last: Column, cut: Column) -> Column:
    more = F.coalesce((bucket < last) | ((bucket == last) & (order <= cut)), F.lit(False)).cast("long")
    return F.least(F.lit(MOST_EPOCHS), epochs + more).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, rating: Rating) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(doc_id, source, size, tie, key) of every row, small rows that are written, and the function that scores a measure."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text.alias("t"))
    measured = base.select("doc_id", "source", word_count(F.col("t")).alias("size"), F.xxhash64("t").alias("tie"), _uniform(F.col("doc_id"), F.col("t")).alias("u"), rating.measure(F.col("t")).alias("measure"))
    rows = written(measured, "measured")
    score = rating.learnt(rows.select("doc_id", "measure"))
    return written(rows.withColumn("score", score(F.col("measure"))).select("doc_id", "source", "size", "tie", _key(F.col("u"), F.col("score")).alias("key")), "keys"), score


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rating: Rating = PROSE_RATING) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row. ``rating``: the quality of a text, 0 to 1.

    Null texts have size 0; a null source is a source of its own, last in order. A null score is the least.
    Rows that repeat an id are rows of their own; whole repeated rows are taken alike, all or none at a cut.
    Reruns agree, as keys depend on id, text and seed alone. An empty table gives no rows.
    """
    keyed, _ = _keyed(docs, id_col, text_col, source_col, rating)
    found = cuts(keyed)
    buckets = (found.select("buckets").first() or [1])[0]
    rows = looked_up(keyed, found.drop("buckets"), "source", "inner")
    copies = _copies(_bucket(F.col("key"), buckets), _order(), F.col("epochs"), F.col("last"), F.col("cut"))
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rating: Rating = PROSE_RATING) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeated once for each epoch; columns as they were, whatever their names.

    Nulls, ties, repeated rows and empty tables as in ``mixed``. Texts are measured a second time and stay where they are.
    """
    keyed, score = _keyed(docs, id_col, text_col, source_col, rating)
    found = cuts(keyed)
    buckets = (found.select("buckets").first() or [1])[0]
    source, rated, key, epochs, last, cut, n = free_name(docs, "mix_source", "mix_score", "mix_key", "mix_epochs", "mix_last", "mix_cut", "mix_copies")
    text = text_of(text_col)
    named = docs.withColumns({source: F.col(source_col), rated: score(rating.measure(text))}).withColumn(key, _key(_uniform(F.col(id_col), text), F.col(rated)))
    small = found.select(F.col("source").alias(source), F.col("epochs").alias(epochs), F.col("last").alias(last), F.col("cut").alias(cut))
    order = F.struct(F.col(key).alias("key"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"))
    copies = _copies(_bucket(F.col(key), buckets), order, F.col(epochs), F.col(last), F.col(cut))
    taken = looked_up(named, small, source, "inner").withColumn(n, copies).where(F.col(n) > 0)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
