"""Regions of binary images as relations: connected components, their boxes, and their outlines as polylines.

An image is a relation (image_id, x, y, on) of any size; it is cut into tiles, and no image is ever gathered. A
tile's pixels are labelled at once, in a group of ``TILE`` squared rows at most; labels that meet at the edge of two
tiles are edges of a small graph, whose components give the labels of the whole. Pixels touch at their sides.

Outlines run between pixels that are on and pixels that are off, half way (marching squares), with pixels that are
on at the right hand where y goes down; where two of them meet at a corner only they are kept apart. Outlines that
end at the image's border are open, unless the image is closed first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.operators import graphs
from polyweft.storage import written

TILE = 64
#: A place as one number that sorts by rows: y * ROW + x.
ROW = 1 << 32


def place(x: Column, y: Column) -> Column:
    return y.cast("long") * ROW + x.cast("long")


def place_x(at: Column) -> Column:
    return (at % ROW).cast("int")


def place_y(at: Column) -> Column:
    return F.floor(at / ROW).cast("int")


def tile_labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pixels of one tile, the index of the first by rows in each one's component; pixels are in that order."""
    at = {p: i for i, p in enumerate(zip(y.tolist(), x.tolist()))}
    root = list(range(len(at)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (row, column), i in at.items():
        for near in ((row, column - 1), (row - 1, column)):
            if near in at:
                a, b = sorted((find(at[near]), find(i)))
                root[b] = a
    return np.array([find(i) for i in range(len(root))], np.int64)


def labelled(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, x, y, label) of the pixels that are on; a label is the place of its component's first pixel by rows.

    Repeated pixels count once, null ones are off. An image without pixels that are on gives no rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"]).reset_index(drop=True)
        first = tile_labels(rows["x"].to_numpy(), rows["y"].to_numpy())
        rows["label"] = rows["y"].to_numpy(np.int64)[first] * ROW + rows["x"].to_numpy(np.int64)[first]
        return rows[["image_id", "x", "y", "label"]]

    on = pixels.where("on").select(F.col("image_id").cast("long").alias("image_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    tiled = on.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    own = written(tiled.groupBy("image_id", "tx", "ty").applyInPandas(run, "image_id long, x int, y int, label long"), "tile-labels")
    # each side of a tile's edge tells its label at the pixel behind the edge
    right, left = F.pmod("x", F.lit(tile)) == tile - 1, F.pmod("x", F.lit(tile)) == 0
    low, high = F.pmod("y", F.lit(tile)) == tile - 1, F.pmod("y", F.lit(tile)) == 0
    sides = [own.where(w).select("image_id", F.lit(d).alias("down"), x.alias("x"), y.alias("y"), "label") for w, d, x, y in ((right, 0, F.col("x") + 1, F.col("y")), (left, 0, F.col("x"), F.col("y")), (low, 1, F.col("x"), F.col("y") + 1), (high, 1, F.col("x"), F.col("y")))]
    met = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3]).groupBy("image_id", "down", "x", "y").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    roots = graphs.components(met.where("a <> b").select("image_id", "a", "b"))
    # a tile's label has a tile's pixels at most, so no key of this join is large
    return own.join(roots.withColumnRenamed("node", "label"), ["image_id", "label"], "left").select("image_id", "x", "y", F.coalesce("root", "label").alias("label"))


def boxes(labels: DataFrame) -> DataFrame:
    """(image_id, label, n, left, top, right, bottom, outline): each component's pixels and box; the outline is its five corners."""
    found = labels.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return found.withColumn("outline", F.array(corner("left", "top"), corner("right", "top"), corner("right", "bottom"), corner("left", "bottom"), corner("left", "top")))


#: Of the four pixels of a cell (1 upper left, 2 upper right, 4 lower right, 8 lower left), the cell's sides that an
#: outline comes in by and goes out of: 0 upper, 1 right, 2 lower, 3 left. Opposite corners are kept apart.
SIDES = {1: ((0, 3),), 2: ((1, 0),), 4: ((2, 1),), 8: ((3, 2),), 3: ((1, 3),), 6: ((2, 0),), 12: ((3, 1),), 9: ((0, 2),), 5: ((0, 3), (2, 1)), 10: ((1, 0), (3, 2)), 14: ((3, 0),), 13: ((0, 1),), 11: ((1, 2),), 7: ((2, 3),)}
#: The middle of a side, in half pixels from the cell's upper left pixel.
MIDDLES = ((1, 0), (2, 1), (1, 2), (0, 1))


def steps(pixels: DataFrame, closed: bool) -> DataFrame:
    """(image_id, node, next): places in half pixels that follow each other on an outline."""
    on = pixels.where("on").select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    corner = lambda dx, dy, bit: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(bit).alias("bit"))
    cells = on.select("image_id", F.inline(F.array(corner(0, 0, 1), corner(-1, 0, 2), corner(-1, -1, 4), corner(0, -1, 8))))
    cells = cells.groupBy("image_id", "x", "y").agg(F.sum("bit").alias("kind"))
    if not closed:  # cells whose four pixels are in the image
        size = pixels.groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
        cells = cells.join(size, "image_id").where("x >= x0 and y >= y0 and x < x1 and y < y1")
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    kinds = F.array(*[F.array(*[pair(a, b) for a, b in SIDES[k]]) if k in SIDES else none for k in range(16)])
    lines = cells.select("image_id", "x", "y", F.explode(F.get(kinds, F.col("kind").cast("int"))).alias("s"))
    middle = lambda s: place(*[2 * F.col(c) + F.get(F.array(*[F.lit(m[k]) for m in MIDDLES]), F.col(s)) for k, c in enumerate("xy")])
    return lines.select("image_id", middle("s.a").alias("node"), middle("s.b").alias("next"))


def outlines(pixels: DataFrame, closed: bool = False) -> DataFrame:
    """(image_id, outline, closed, step, x, y): points of each outline in order, one row each; a closed one comes back to its first point.

    An outline is named by its first point: where it comes in from the border, or the least by rows. With ``closed``
    the image counts as surrounded by pixels that are off, and all outlines are closed. One point of no length is none.
    Coordinates must not be negative.
    """
    links = written(steps(pixels, closed), "outline-steps")
    if closed:  # places one half pixel outside the image: moved in by a pixel, and back below
        links = links.select("image_id", *[(F.col(c) + 2 * ROW + 2).alias(c) for c in ("node", "next")])
    shift = 1.0 if closed else 0.0
    ranked = graphs.ranks(links)
    length = ranked.where("closed").groupBy("image_id", "first").agg(F.count("*").alias("rank"))
    again = length.select("image_id", F.col("first").alias("node"), "first", F.col("rank").cast("long").alias("rank"), F.lit(True).alias("closed"))
    rows = ranked.unionByName(again)
    half = lambda at, axis: axis(F.col(at)) / 2 - shift
    return rows.select("image_id", F.struct(half("first", place_x).alias("x"), half("first", place_y).alias("y")).alias("outline"), "closed", F.col("rank").alias("step"), half("node", place_x).alias("x"), half("node", place_y).alias("y"))


def polylines(points: DataFrame) -> DataFrame:
    """(image_id, outline, closed, points) of outlines that are short enough for a row each."""
    pairs = F.array_sort(F.collect_list(F.struct("step", "x", "y")))
    return points.groupBy("image_id", "outline", "closed").agg(F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
