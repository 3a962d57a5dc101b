"""Polylines on a grid as pen strokes, pen strokes as pixels, and grey images as black and white.

Strokes are made inside array expressions: each polyline's points are rounded, halves to even, moved to the nearest
place of the grid if they lie outside, and freed of repeats; a polyline of two places or more is a move with the pen up
to its first place and a step with the pen down to each other one. Between polylines stands a step of no length.

Drawing is a relation: where the pen is follows from a running sum since the last move, each step with the pen down is
a line, and a line's pixels are explicit, so none depends on the one before. Pixels outside the canvas are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_places(points: Column, grid: int) -> Column:
    """array<struct<x,y int>> of a polyline's points on a grid, repeats in a row once."""
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.rint(v).cast("long"))).cast("int")
    placed = F.transform(points, lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y")))
    # a lambda names the placed points once, for the filter to look at its neighbour
    return F.flatten(F.transform(F.array(placed), lambda ps: F.filter(ps, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(ps, i - 1)))))


def pen_strokes(polylines: Column, grid: int = 64) -> Column:
    """array<struct<dx,dy int, pen boolean>> of an array of polylines; null for null."""
    step = lambda dx, dy, pen: F.struct(dx.cast("int").alias("dx"), dy.cast("int").alias("dy"), F.lit(pen).alias("pen"))
    placed = F.filter(F.transform(polylines, lambda line: grid_places(line, grid)), lambda ps: F.size(ps) > 1)

    def one(ps: Column, i: Column) -> Column:
        first = F.get(ps, F.lit(0))
        moves = F.transform(F.slice(ps, 2, F.size(ps) - 1), lambda p, k: step(p["x"] - F.get(ps, k)["x"], p["y"] - F.get(ps, k)["y"], True))
        between = F.when(i > 0, F.array(step(F.lit(0), F.lit(0), False))).otherwise(F.array().cast("array<struct<dx:int,dy:int,pen:boolean>>"))
        return F.concat(between, F.array(step(first["x"], first["y"], False)), moves)

    return F.flatten(F.transform(placed, one))


def drawn(strokes: DataFrame, canvas: int = 256, grid: int = 64) -> DataFrame:
    """(drawing_id, x, y), each once: the pixels of pen strokes (drawing_id, steps).

    A move of no length with the pen up is a mere mark, so a drawing that begins at the grid's origin is drawn on from
    where the pen was, and steps before any move are not drawn.
    """
    c = F.col
    steps = strokes.select("drawing_id", F.posexplode("steps").alias("pos", "s")).select("drawing_id", "pos", "s.*")
    order = Window.partitionBy("drawing_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moves = ~c("pen") & ((c("dx") != 0) | (c("dy") != 0))
    run = steps.withColumn("move", F.sum(moves.cast("int")).over(order)).where("move > 0 and (pen or dx <> 0 or dy <> 0)")
    since = Window.partitionBy("drawing_id", "move").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = run.withColumns({"x": F.sum("dx").over(since), "y": F.sum("dy").over(since)}).where("pen")
    scale = (canvas - 1) / max(grid - 1, 1)
    pixel = lambda v: F.rint(v * F.lit(float(scale))).cast("long")
    lines = run.select("drawing_id", pixel(c("x") - c("dx")).alias("x0"), pixel(c("y") - c("dy")).alias("y0"), pixel(c("x")).alias("x1"), pixel(c("y")).alias("y1")).distinct()
    lines = lines.withColumns({"dx": F.abs(c("x1") - c("x0")), "dy": F.abs(c("y1") - c("y0")), "sx": F.when(c("x0") < c("x1"), 1).otherwise(-1), "sy": F.when(c("y0") < c("y1"), 1).otherwise(-1)})
    # along the longer side; the shorter one follows where more than half a pixel, or half of one, is behind
    n = F.greatest("dx", "dy")
    each = lines.withColumns({"n": n, "k": F.explode(F.sequence(F.lit(0).cast("long"), n))})
    short = F.when(c("n") == 0, 0).otherwise(F.floor((2 * c("k") * F.least("dx", "dy") + c("n")) / F.greatest(2 * c("n"), F.lit(1))))
    flat = c("dx") >= c("dy")
    x, y = c("x0") + c("sx") * F.when(flat, c("k")).otherwise(short), c("y0") + c("sy") * F.when(flat, short).otherwise(c("k"))
    return each.select("drawing_id", x.cast("int").alias("x"), y.cast("int").alias("y")).where(f"x between 0 and {canvas - 1} and y between 0 and {canvas - 1}").distinct()


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma of a colour in whole numbers."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16).cast("int")


def resized(pixels: DataFrame, side: int) -> DataFrame:
    """(image_id, x, y, v) of grey images (image_id, x, y, v) as squares of ``side``: the mean of the pixels that fall into each, or the pixel that lies under its middle."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    p = pixels.join(size, "image_id")
    into = lambda at, n: F.floor(F.col(at) * side / F.col(n)).cast("int")
    means = p.groupBy("image_id", into("x", "w").alias("x"), into("y", "h").alias("y")).agg(F.rint(F.avg("v")).cast("int").alias("mean"))
    every = size.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    under = lambda at, n: F.floor((2 * F.col(at) + 1) * F.col(n) / (2 * side)).cast("int")
    nearest = every.withColumns({"ux": under("x", "w"), "uy": under("y", "h")}).join(pixels.select("image_id", F.col("x").alias("ux"), F.col("y").alias("uy"), "v"), ["image_id", "ux", "uy"], "left")
    return nearest.join(means, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("mean", "v").alias("v"))


def thresholds(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold) by Otsu's rule: the grey value that parts the values up to it from those above with the most variance between.

    Values are counted first, 256 at most an image; the sums up to each are a running sum over these few rows. Of equal
    variances the least value counts. An image of one value has that value, and an image without pixels none.
    """
    c = F.col
    counted = pixels.where("v is not null").groupBy("image_id", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    sums = counted.withColumns({"w1": F.sum("n").over(order), "s1": F.sum(c("n") * c("v")).over(order), "w": F.sum("n").over(whole), "s": F.sum(c("n") * c("v")).over(whole)})
    gap = (c("s1") * c("w") - c("s") * c("w1")).cast("double")
    between = F.when(c("w1") < c("w"), gap * gap / (c("w1").cast("double") * (c("w") - c("w1")).cast("double"))).otherwise(F.lit(0.0))
    return sums.withColumn("between", between).groupBy("image_id").agg(F.max_by("v", F.struct("between", (-c("v")).alias("first"))).alias("threshold"))


def binarised(pixels: DataFrame, threshold: float | None = None) -> DataFrame:
    """(image_id, x, y, on) of grey images: pixels darker than the threshold are on; without one, each image's own by Otsu's rule."""
    if threshold is not None:
        return pixels.select("image_id", "x", "y", (F.col("v") < threshold).alias("on"))
    # one row an image: small beside its pixels
    return pixels.join(thresholds(pixels), "image_id").select("image_id", "x", "y", (F.col("v") < F.col("threshold")).alias("on"))
