"""Dispatch, blocks and numbering of streams of any length: ranges of positions in parallel, and a prefix scan of their summaries.

A stream is cut into ranges of ``RANGE`` positions. What a range has to know of those before it is carried by one
summary row a range: sums are added up, and a state that a range may pass on unchanged is the last one that was set.
Summaries are scanned in groups of ``FAN``, then the groups' summaries, and so on, so that no window ever holds
more than a range of words or ``FAN`` summaries, however long a stream is. Two words on either side of a range
are copied to its neighbour, as a taste block is known by three words.

``dispatched`` and ``blocks`` give what the operators of the same names in ``streams`` give for whole streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweft.functions import words as W
from polyweft.storage import written

RANGE, FAN = 1 << 12, 1 << 10
_HALO = 2


def before(summaries: DataFrame, sums: list[str], lasts: list[str], fan: int = FAN) -> DataFrame:
    """Rows (stream_id, r, ...) with before_<c>: of the stream's rows of lower r the sum of c, or its last value that is not null."""
    most = summaries.agg(F.max("r")).first()[0]
    return _before(summaries, sums, lasts, fan, most or 0)


def _before(rows: DataFrame, sums: list[str], lasts: list[str], fan: int, most: int) -> DataFrame:
    whole = most < fan
    grouped = rows if whole else rows.withColumn("_g", F.floor(F.col("r") / fan))
    earlier = Window.partitionBy("stream_id", *([] if whole else ["_g"])).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumns({**{f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums}, **{f"before_{c}": F.last(c, ignorenulls=True).over(earlier) for c in lasts}})
    if whole:
        return own
    totals = grouped.groupBy("stream_id", F.col("_g").alias("r")).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("r"))).alias(c) for c in lasts])
    above = _before(totals, sums, lasts, fan, most // fan).select("stream_id", F.col("r").alias("_g"), *[F.col(f"before_{c}").alias(f"_above_{c}") for c in sums + lasts])
    joined = own.join(above, ["stream_id", "_g"])
    told = {**{f"before_{c}": F.col(f"before_{c}") + F.col(f"_above_{c}") for c in sums}, **{f"before_{c}": F.coalesce(f"before_{c}", f"_above_{c}") for c in lasts}}
    return joined.withColumns(told).drop("_g", *[f"_above_{c}" for c in sums + lasts])


def numbered(rows: DataFrame, order: str = "pos", into: str = "pos", length: int = RANGE, fan: int = FAN) -> DataFrame:
    """``rows`` with the numbers 0, 1, ... of each stream by an integer ``order`` that is unique in it, gaps and all."""
    cut = rows.withColumn("r", F.floor(F.col(order) / length))
    ahead = before(written(cut.groupBy("stream_id", "r").agg(F.count("*").alias("n")), "range-counts"), ["n"], [], fan).select("stream_id", "r", "before_n")
    inside = F.row_number().over(Window.partitionBy("stream_id", "r").orderBy(order))
    return cut.withColumn("_inside", inside).join(ahead, ["stream_id", "r"]).withColumn(into, F.col("before_n") + F.col("_inside") - 1).drop("r", "_inside", "before_n")


def _range(length: int) -> Column:
    return F.floor(F.col("pos") / length)


def dispatched(stream: DataFrame, length: int = RANGE, fan: int = FAN) -> DataFrame:
    """(stream_id, pos, word, modality) of streams whose positions are 0, 1, ... without gaps, see ``numbered``."""
    ok = F.coalesce(W.in_range("word"), F.lit(False))
    off = F.pmod("pos", F.lit(length))
    near = F.array_compact(F.array(F.col("r"), F.when(off < _HALO, F.col("r") - 1), F.when(off >= length - _HALO, F.col("r") + 1)))
    rows = stream.select("stream_id", "pos", "word", _range(length).alias("r")).withColumn("at", F.explode(near))
    w = Window.partitionBy("stream_id", "at").orderBy("pos")
    bit, v = ok & W.is_taste_bit("word"), W.version("word")
    ahead = lambda k: F.coalesce(F.lead(bit & (v == k), k).over(w), F.lit(False))
    behind = lambda k: F.coalesce(F.lag("_start", k).over(w), F.lit(False))
    marked = rows.withColumn("_start", bit & (v == 0) & ahead(1) & ahead(2)).withColumn("_in", F.col("_start") | behind(1) | behind(2)).where("at = r")
    # a continuation is in a block if the word before it is: null where only earlier ranges can tell
    settled = F.when(F.col("_in") | ~(bit & v.isin(2, 3)), F.col("_in"))
    run = marked.withColumn("_taste", F.last(settled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = written(run.select("stream_id", "r", "pos", "word", "_taste"), "ranges")
    last = written(run.groupBy("stream_id", "r").agg(F.max_by("_taste", "pos").alias("taste")), "range-states")
    told = run.join(before(last, [], ["taste"], fan).select("stream_id", "r", "before_taste"), ["stream_id", "r"])
    taste = F.coalesce("_taste", "before_taste", F.lit(False))
    return told.select("stream_id", "pos", "word", F.when(ok, F.when(taste, "taste").otherwise(W.modality("word"))).alias("modality"))


def pieces(classified: DataFrame, length: int = RANGE, fan: int = FAN) -> DataFrame:
    """(stream_id, modality, block, piece, start, words): what each range has of each block, pieces in order; see ``streams.blocks``."""
    labels = [m for m in W.LABELS if m not in ("text", "bpe")]
    m = F.coalesce("modality", F.lit(""))
    w = Window.partitionBy("stream_id", "r").orderBy("pos")
    rows = classified.select("stream_id", "pos", "word", m.alias("modality"), _range(length).alias("r"))
    opens = F.col("modality") != F.lag("modality").over(w)  # null for a range's first word
    rows = written(rows.withColumn("opens", opens), "range-blocks")
    per_range = rows.groupBy("stream_id", "r").agg(F.min_by("modality", "pos").alias("head"), F.max_by("modality", "pos").alias("tail"), *[F.count_if(F.col("opens") & (F.col("modality") == c)).alias(f"n_{c}") for c in labels])
    entered = before(written(per_range, "range-tails"), [], ["tail"], fan).withColumn("goes_on", F.col("head").eqNullSafe(F.col("before_tail"))).drop("before_tail")
    entered = written(entered.withColumns({f"n_{c}": F.col(f"n_{c}") + ((F.col("head") == c) & ~F.col("goes_on")).cast("int") for c in labels}), "range-opens")
    known = before(entered, [f"n_{c}" for c in labels], [], fan)
    seen = F.create_map(*[x for c in labels for x in (F.lit(c), F.col(f"before_n_{c}"))])
    told = rows.where(F.col("modality").isin(*labels)).join(known.select("stream_id", "r", "goes_on", seen.alias("seen")), ["stream_id", "r"])
    opened = F.coalesce("opens", ~F.col("goes_on"))
    by_label = Window.partitionBy("stream_id", "r", "modality").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("block", F.col("seen")[F.col("modality")] + F.sum(opened.cast("int")).over(by_label) - 1)
    pairs = F.array_sort(F.collect_list(F.struct("pos", "word")))
    out = told.groupBy("stream_id", "r", "modality", "block").agg(F.min("pos").alias("start"), F.transform(pairs, lambda p: p["word"]).alias("words"))
    return out.select("stream_id", "modality", F.col("block").cast("long").alias("block"), F.col("r").alias("piece"), "start", "words")


def blocks(classified: DataFrame, length: int = RANGE, fan: int = FAN) -> DataFrame:
    """(stream_id, modality, block, start, words) as ``streams.blocks`` has it: each block whole, so a block is as long as an array may be."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "words")))
    whole = pieces(classified, length, fan).groupBy("stream_id", "modality", "block").agg(F.min("start").alias("start"), F.flatten(F.transform(parts, lambda p: p["words"])).alias("words"))
    return whole.select("stream_id", "modality", "block", "start", "words")
