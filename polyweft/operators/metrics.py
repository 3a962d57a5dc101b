"""Metrics of distributions, runs and signals."""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweft.storage import written


def distribution(counts: DataFrame, key: str | None, count: str, label: str) -> DataFrame:
    """Per key of whole counts by label: coverage, entropy (bits), evenness, the first label and what ``RATIOS`` are made of: total, sum of squares, least count and the two largest.

    Zero counts do not count; equal counts stand in label order, null last. Entropies are summed in that order, and all
    else is whole numbers, so that no figure depends on the order of the rows.
    """
    keys = [key] if key else []
    n = F.col(count).cast("decimal(38,0)")
    one = F.struct((-n).alias("neg"), F.col(label).isNull().alias("none"), F.col(label).alias("label"))
    base = counts.where(n > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("coverage"), F.sum(n).alias("total"), F.sum(n * n).alias("squares"), F.min(n).alias("least"), F.array_sort(F.collect_list(one)).alias("sorted"))
    share = lambda x: -x["neg"].cast("double") / F.col("total").cast("double")
    entropy = F.aggregate("sorted", F.lit(0.0), lambda sum_, x: sum_ - share(x) * F.log2(share(x)))
    place = lambda i: F.get("sorted", F.lit(i))
    return base.withColumn("entropy", entropy).select(
        *keys, "coverage", "entropy", F.when(F.col("coverage") > 1, F.col("entropy") / F.log2(F.col("coverage").cast("double"))).otherwise(0.0).alias("evenness"),
        place(0)["label"].alias("first"), "total", "squares", "least", (-place(0)["neg"]).alias("a"), F.coalesce(-place(1)["neg"], F.lit(0).cast("decimal(38,0)")).alias("b"),
    )


#: Concentration, effective number, largest by least share, and the two largest shares with their product measure, as quotients of whole numbers.
RATIOS = {
    "hhi": ("squares", "total * total"), "effective": ("total * total", "squares"), "spread": ("a", "least"), "pair_share": ("a + b", "total"),
    "pair_balance": ("b", "a"), "pair_gap": ("a - b", "total"), "bimodality": ("(a + b) * b", "total * a"),
}


def ratio(name: str, scale: int = 1_000_000) -> Column:
    """One of ``RATIOS`` times ``scale``, rounded half to even without floating point."""
    above, below = (F.expr(e).cast("decimal(38,0)") for e in RATIOS[name])
    above = (above * F.lit(scale).cast("decimal(38,0)")).cast("decimal(38,0)")
    whole = F.call_function("div", above, below)
    twice = (above - whole.cast("decimal(38,0)") * below) * 2
    return (whole + F.when((twice > below) | ((twice == below) & (whole % 2 == 1)), 1).otherwise(0)).alias(name)


def unit(value: Column) -> Column:
    """Clamped to 0..1; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def transport_score(parts: list[Column]) -> Column:
    """100 times the mean of those parts, clamped to 0..1, that are not null."""
    known = F.filter(F.array(*[p.cast("double") for p in parts]), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + unit(x))
    return F.when(F.size(known) > 0, 100 * total / F.size(known)).otherwise(0.0)


def percentile(column: str, p: float) -> Column:
    """With linear interpolation; 0 for nothing."""
    return F.coalesce(F.percentile(column, F.lit(p)), F.lit(0.0))


def latest(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_rank") <= n).drop("_rank")


def first_known(maps: Column, *names: str) -> Column:
    """The value of the first name that a map has."""
    return F.coalesce(*[F.try_element_at(maps, F.lit(n)) for n in names])


def unpivoted(df: DataFrame, ids: list[str], digits: int = 6) -> DataFrame:
    """(ids, metric, value) of a wide row, values rounded half to even."""
    values = [c for c in df.columns if c not in ids]
    wide = df.select(*ids, *[F.bround(F.col(c).cast("double"), digits).alias(c) for c in values])
    return wide.unpivot(ids, values, "metric", "value")


def nearest_mean(a: DataFrame, b: DataFrame, key: str, cell: float = 8.0) -> DataFrame:
    """Mean distance of each key's points (x, y) of ``a`` to the nearest of ``b``; a key without points in ``b`` has no row.

    Equal points are asked once. Points lie in square cells; a point meets the distinct points of its cell and the
    eight around it, which settles it if the nearest is within a cell's width. What is not settled goes on with cells
    twice as wide, in which far points are few: no point meets all points of its key unless they lie within its reach.
    Cells as wide as all points lie apart settle every point, so the rounds are as many as the extent has doublings of
    a cell. Coordinates that are no finite numbers raise.
    """
    asked = written(a.groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("n")), "asked")
    other = written(b.select(key, "x", "y").distinct(), "points")
    asked = asked.join(other.select(key).distinct(), key, "left_semi")
    at = lambda c, w: F.floor(F.col(c) / w).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    ends = [f(c) for c in ("x", "y") for f in (F.min, F.max)]
    x0, x1, y0, y1 = asked.select("x", "y").unionByName(other.select("x", "y")).agg(*ends).first()
    if x0 is not None and not all(map(math.isfinite, (x0, x1, y0, y1))):
        raise ValueError("points must have finite coordinates")
    done = []
    while True:
        tiles = other.select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), at("x", cell).alias("_i"), at("y", cell).alias("_j"))
        spread = asked.withColumn("_o", F.explode(around)).withColumns({"_i": at("x", cell) + F.col("_o.i"), "_j": at("y", cell) + F.col("_o.j")})
        d = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
        near = written(spread.join(tiles, [key, "_i", "_j"], "left").groupBy(key, "x", "y", "n").agg(F.min(d).alias("d")), "near")
        done.append(near.where(F.col("d") <= cell))
        asked = near.where("d is null or d > %r" % cell).drop("d")
        if asked.isEmpty():
            break
        cell *= 2
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    return settled.groupBy(key).agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_distance"))


def descriptor_distance(a: list[Column], b: list[Column]) -> Column:
    """Mean absolute difference of two formant bands, speaking rate (0..15) and emotion (0..7); unknown ones count as 0."""
    norm = lambda c, d: F.coalesce(unit(c.cast("double") / d), F.lit(0.0))
    return sum((F.abs(norm(x, d) - norm(y, d)) for x, y, d in zip(a, b, (15.0, 15.0, 15.0, 7.0))), F.lit(0.0)) / 4


def blended(base: Column, delta: Column, weight: float = 0.35) -> Column:
    return unit(base.cast("double") + weight * delta)


def trends(df: DataFrame, key: str, order: str, value: str, window: int = 5, threshold: float = 5.0) -> DataFrame:
    """(key, bucket, trend) of tumbling count windows over known values: last minus first against the threshold; single values give none."""
    w = Window.partitionBy(key).orderBy(order)
    known = df.where(F.col(value).isNotNull()).withColumn("bucket", F.floor((F.row_number().over(w) - 1) / window))
    ends = known.groupBy(key, "bucket").agg((F.max_by(value, order) - F.min_by(value, order)).alias("slope"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return ends.select(key, "bucket", F.when(F.col("slope") > threshold, "UP").when(F.col("slope") < -threshold, "DOWN").otherwise("LEVEL").alias("trend"))


def contour(df: DataFrame, key: str, order: str, value: str, levels: int = 8) -> DataFrame:
    """(key, order, level, dir) of a series scaled to ``levels``: right, up-right or down-right by the change of level."""
    whole, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(order)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    scaled = df.withColumn("level", F.when(high > low, F.rint((F.col(value) - low) / (high - low) * (levels - 1))).otherwise(0).cast("int"))
    change = F.col("level") - F.lag("level").over(w)
    return scaled.select(key, order, "level", F.when(change.isNull() | (change == 0), 0).when(change > 0, 1).otherwise(7).alias("dir"))


def merged_ties(notes: DataFrame) -> DataFrame:
    """(doc_id, part, voice, pitch, onset, duration) of notes with a tie: start and continue go on to the next, stop ends, none stands alone."""
    w = Window.partitionBy("doc_id", "part", "voice", "pitch").orderBy("onset")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joins = F.lag("tie").over(w).isin("start", "continue") & F.coalesce(F.col("tie"), F.lit("")).isin("continue", "stop")
    chained = notes.withColumn("_chain", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(upto))
    return chained.groupBy("doc_id", "part", "voice", "pitch", "_chain").agg(F.min("onset").alias("onset"), F.sum("duration").alias("duration")).drop("_chain")


def grid_notes(notes: DataFrame, step: float) -> DataFrame:
    """Ticks of onsets and durations (at least 1), half to even, and the pitch above the document's lowest."""
    tick = lambda c: F.rint(F.col(c) / step).cast("int")
    origin = F.min("pitch").over(Window.partitionBy("doc_id"))
    return notes.select("doc_id", tick("onset").alias("start_tick"), F.greatest(tick("duration"), F.lit(1)).alias("duration_ticks"), "pitch", (F.col("pitch") - origin).alias("row"))


def grid_strokes(grid: DataFrame, origin: str = "origin", anchors: bool = False) -> DataFrame:
    """(doc_id, n, x, y, directions, anchor, pitch) of grid notes (doc_id, start_tick, duration_ticks, pitch, origin): a move and a step right for each tick.

    Strokes of a document are numbered by start and pitch, rests, which have no pitch and lie at 0, first. ``anchors``: a
    start of at most 127 is told as an anchor too.
    """
    order = Window.partitionBy("doc_id").orderBy("start_tick", F.coalesce("pitch", F.lit(-1)))
    y = F.coalesce(F.col("pitch") - F.col(origin), F.lit(0))
    anchor = F.when(F.col("start_tick").between(0, 127), F.col("start_tick")) if anchors else F.lit(None).cast("int")
    right = F.array_repeat(F.lit(0), F.greatest(F.lit(1), F.col("duration_ticks").cast("int")))
    return grid.select("doc_id", (F.row_number().over(order) - 1).alias("n"), F.col("start_tick").alias("x"), y.cast("int").alias("y"), right.alias("directions"), anchor.cast("int").alias("anchor"), "pitch")


def strokes_grid(strokes: DataFrame, origin: int = 0) -> DataFrame:
    """(doc_id, n, start_tick, duration_ticks, pitch) of strokes (doc_id, n, x, y, directions, rest): a note lasts as many ticks as its steps go right, one at least."""
    ticks = F.size(F.filter("directions", lambda d: d.isin(0, 1, 7)))
    return strokes.where("x is not null").select("doc_id", "n", F.col("x").alias("start_tick"), F.greatest(F.lit(1), ticks).alias("duration_ticks"), F.when(~F.col("rest"), F.col("y") + origin).alias("pitch"))


def path_points(steps: DataFrame, key: str, order: str, x: str, y: str, dx: str, dy: str) -> DataFrame:
    """Positions of a pen: each move (x, y known) starts anew, each step adds."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = steps.withColumn("_m", F.sum(F.col(x).isNotNull().cast("int")).over(upto))
    inner = Window.partitionBy(key, "_m").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda p, d: F.first(p, True).over(inner) + F.sum(F.coalesce(F.col(d), F.lit(0))).over(inner)
    return part.select(key, order, F.col("_m").alias("segment"), at(x, dx).alias("x"), at(y, dy).alias("y"))


def max_error(a: DataFrame, b: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, max_error): the largest difference of two series by place; places that only one of them has raise."""
    other = b.select(key, order, F.col(value).alias("_other"))
    both = a.select(key, order, value).join(other, [key, order], "full")
    gap = F.abs(F.col(value) - F.col("_other"))
    return both.withColumn("_gap", F.when(gap.isNotNull(), gap).otherwise(F.raise_error(F.lit("the series differ in length")).cast("double"))).groupBy(key).agg(F.max("_gap").alias("max_error"))


def time_steps(notes: DataFrame, key: str, onset: str = "onset", duration: str = "duration", limit: int = 1024) -> DataFrame:
    """(key, step) of scores: one over the least common multiple of the denominators of onsets and durations, ``limit`` at most each."""

    @F.pandas_udf("int")
    def denominator(x: pd.Series) -> pd.Series:
        return x.map(lambda v: Fraction(v).limit_denominator(limit).denominator)

    @F.pandas_udf("double")
    def step(sets: pd.Series) -> pd.Series:
        return sets.map(lambda ds: 1.0 / math.lcm(*map(int, ds)))

    both = notes.select(key, F.col(onset).cast("double").alias("v")).unionByName(notes.select(key, F.col(duration).cast("double").alias("v"))).where("v is not null")
    # a set of at most ``limit`` numbers
    return both.select(key, denominator("v").alias("d")).groupBy(key).agg(F.collect_set("d").alias("ds")).select(key, step("ds").alias("step"))
