"""Images as relations (image_id, x, y, r, g, b): quantisation, quadtrees as aggregations over levels, and distances.

A quadtree node is a leaf if it is one pixel or its mean channel variance is at most the threshold, and no node
above it is one. Levels are summed together: each pixel is counted in its node of every level with map-side
aggregation. Leaves stand in Morton order; a leaf's words follow from the part of its path that it shares with the
leaf before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweft.functions import words as W

CHANNELS = ("r", "g", "b")
# fixed values: commands and metadata kinds of the enhanced image profile
PAINT, SET_COLOUR, BACKTRACK, META = 4, 5, 6, 7


def level_of(value: Column, bit_depth: int) -> Column:
    return F.rint(value / F.lit(255.0) * (2**bit_depth - 1)).cast("int")


def value_of(level: Column, bit_depth: int) -> Column:
    return F.rint(level / F.lit(float(2**bit_depth - 1)) * 255.0).cast("int")


def quantised(value: Column, bit_depth: int = 3) -> Column:
    """The nearest of the values that ``bit_depth`` bits can say; halves to even."""
    return value_of(level_of(value, bit_depth), bit_depth)


def truncated(value: Column, bit_depth: int = 3) -> Column:
    """The variant that drops low bits."""
    return F.shiftleft(F.shiftright(value, 8 - bit_depth), 8 - bit_depth)


def thresholded(value: Column, threshold: float = 128.0) -> Column:
    """Dark pixels are 1."""
    return (value < threshold).cast("int")


def _command(command: Column | int, arg: int = 1) -> Column:
    c = F.lit(command) if isinstance(command, int) else command
    return W.extension(F.lit(W.IMAGE_ENHANCED).bitwiseOR(F.shiftleft(c.cast("int"), 6)).bitwiseOR(arg))


def _datum(kind: int, value: Column | int) -> Column:
    v = F.lit(value) if isinstance(value, int) else value
    return W.extension(F.lit(W.IMAGE_ENHANCED | 0x200 | (kind << 6)).bitwiseOR(v.cast("int").bitwiseAND(63)))


def padded(pixels: DataFrame) -> DataFrame:
    """Pixels in a square of a power of two, zeros added; with width, height and depth (levels below the root)."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    size = size.withColumn("depth", F.ceil(F.log2(F.greatest("width", "height"))).cast("int"))
    side = F.expr("shiftleft(1, depth)")
    grid = size.withColumn("x", F.explode(F.sequence(F.lit(0), side - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), side - 1)))
    return grid.join(pixels, ["image_id", "x", "y"], "left").na.fill(0, list(CHANNELS))


def leaves(square: DataFrame, threshold: float = 5.0, told: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(image_id, depth, level, path, r, g, b): leaves with their rounded means; level 0 is the root. ``told``: the columns of the means."""
    nodes = square.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("shift", F.col("depth") - F.col("level"))
    at = nodes.groupBy("image_id", "depth", "level", F.expr("shiftright(x, shift)").alias("nx"), F.expr("shiftright(y, shift)").alias("ny"))
    sums = at.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in CHANNELS], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in CHANNELS], *[F.sum(c).alias(f"t_{k}") for k, c in zip(CHANNELS, told)])
    variance = sum((F.col(f"q_{c}") / F.col("n") - F.pow(F.col(f"s_{c}") / F.col("n"), 2) for c in CHANNELS), F.lit(0.0)) / 3
    digits = F.transform(F.sequence(F.lit(1), F.col("level")), lambda k: (F.call_function("shiftright", F.col("ny"), F.col("level") - k).bitwiseAND(1) * 2 + F.call_function("shiftright", F.col("nx"), F.col("level") - k).bitwiseAND(1)).cast("string"))
    path = F.when(F.col("level") == 0, "").otherwise(F.array_join(digits, ""))
    passing = sums.withColumns({"path": path, "passes": (F.col("level") == F.col("depth")) | (variance <= threshold)}).where("passes")
    # a leaf has no passing node above it: of the passing nodes of each pixel's way down, the first
    above = passing.select("image_id", F.col("path").alias("above"))
    way = passing.withColumn("above", F.explode(F.when(F.col("level") > 0, F.transform(F.sequence(F.lit(0), F.col("level") - 1), lambda k: F.substr("path", F.lit(1), k))).otherwise(F.expr("cast(array() as array<string>)"))))
    covered = way.join(above, ["image_id", "above"], "left_semi").select("image_id", "path").distinct()
    found = passing.join(covered, ["image_id", "path"], "left_anti")
    return found.select("image_id", "depth", "level", "path", *[F.rint(F.col(f"t_{c}") / F.col("n")).cast("int").alias(c) for c in CHANNELS])


def leaf_words(found: DataFrame, bit_depth: int = 3, level=None, command=_command, colour_words=None) -> DataFrame:
    """``found`` with the words of each leaf, in Morton order; the last of an image climbs back to the root.

    ``level``, ``command`` and ``colour_words`` are what another layout says with: a mean's level, a command's word, and a colour's words.
    """
    order = Window.partitionBy("image_id").orderBy("path")
    level = level or (lambda c: level_of(c, bit_depth))
    colour_words = colour_words or (lambda levels: [command(SET_COLOUR), *[_datum(k, levels[c]) for k, c in enumerate(CHANNELS)]])
    levels = F.struct(*[level(F.col(c)).alias(c) for c in CHANNELS])
    seen = found.withColumns({"levels": levels}).withColumns({"before": F.lag("path").over(order), "colour_before": F.lag("levels").over(order), "is_last": F.lead("path").over(order).isNull()})
    shorter = F.least(F.length("path"), F.length("before"))
    shared = F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda k: (k <= shorter) & (F.substr("path", F.lit(1), k) == F.substr("before", F.lit(1), k)))), F.lit(0))
    seen = seen.withColumn("shared", F.when(F.col("before").isNull(), 0).otherwise(shared))
    none = F.expr("cast(array() as array<int>)")
    back = F.array_repeat(command(BACKTRACK), F.coalesce(F.length("before") - F.col("shared"), F.lit(0)))
    down = F.transform(F.filter(F.split(F.substr(F.col("path"), F.col("shared") + 1), ""), lambda d: d != ""), lambda d: command(d.cast("int")))
    colour = F.when(F.col("levels").eqNullSafe(F.col("colour_before")), none).otherwise(F.array(*colour_words(F.col("levels"))))
    home = F.when(F.col("is_last"), F.array_repeat(command(BACKTRACK), F.length("path"))).otherwise(none)
    return seen.withColumn("words", F.concat(back, down, colour, F.array(command(PAINT)), home))


def header_words(width: Column, height: Column, depth: Column, bit_depth: int, threshold: float) -> Column:
    side = F.call_function("shiftleft", F.lit(1), depth)
    two = lambda k, v: (_datum(k, F.shiftright(v, 6)), _datum(k + 1, v))
    return F.array(_command(META, 0), *two(0, width), *two(2, height), *two(4, side), _datum(6, bit_depth), _datum(7, int(round(threshold * 10))), _command(META, 1))


def encoded(pixels: DataFrame, threshold: float = 5.0, bit_depth: int = 3) -> DataFrame:
    """(image_id, words) of whole images in the enhanced profile."""
    q = pixels.select("image_id", "x", "y", *[quantised(F.col(c), bit_depth).alias(c) for c in CHANNELS])
    square = padded(q)
    body = leaf_words(leaves(square, threshold), bit_depth).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("path", "words"))).alias("parts"))
    size = square.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("depth").alias("depth"))
    return body.join(size, "image_id").select("image_id", F.concat(header_words(F.col("width"), F.col("height"), F.col("depth"), bit_depth, threshold), F.flatten(F.transform("parts", lambda p: p["words"]))).alias("words"))


def _painted(words: list[int]) -> np.ndarray:
    """Pixels of one image's words; malformed ones raise."""
    meta, i = {}, 1
    if not words or (words[0] & 0xFFFF) != W.IMAGE_ENHANCED | META << 6:
        raise ValueError("no header")
    while i < len(words) and words[i] & 0x200:
        meta[(words[i] >> 6) & 7] = words[i] & 63
        i += 1
    if set(meta) != set(range(8)) or i >= len(words) or (words[i] & 0xFFFF) != W.IMAGE_ENHANCED | META << 6 | 1:
        raise ValueError("incomplete header")
    width, height, side = (meta[k] << 6 | meta[k + 1] for k in (0, 2, 4))
    top = 2 ** meta[6] - 1
    if not 1 <= meta[6] <= 6 or side < max(width, height, 1) or side & (side - 1):
        raise ValueError("bad header")
    image, stack, colour = np.zeros((side, side, 3), np.uint8), [(0, 0, side)], None
    rest = iter(words[i + 1 :])
    for w in rest:
        if w & 0x200:
            raise ValueError("stray datum")
        command, times = (w >> 6) & 7, max(1, w & 63)
        if command < 4:
            for _ in range(times):
                x, y, s = stack[-1]
                if s == 1:
                    raise ValueError("below a pixel")
                stack.append((x + s // 2 * (command & 1), y + s // 2 * (command >> 1), s // 2))
        elif command == PAINT:
            if colour is None:
                raise ValueError("no colour")
            x, y, s = stack[-1]
            image[y : y + s, x : x + s] = colour
        elif command == SET_COLOUR:
            three = [next(rest, 0) for _ in range(3)]
            if any((d >> 6) & 0xF != 8 + k or (d & 63) > top for k, d in enumerate(three)):
                raise ValueError("bad colour")
            colour = [int(np.rint((d & 63) / top * 255)) for d in three]
        elif command == BACKTRACK:
            if len(stack) <= times:
                raise ValueError("above the root")
            del stack[-times:]
        else:
            raise ValueError("stray header")
    if len(stack) != 1:
        raise ValueError("unbalanced")
    return image[:height, :width]


def painted(words: Column) -> Column:
    """struct(width, height, pixels) of one image's words, pixels as r, g, b by rows; null for malformed ones, through Arrow."""

    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for w in column:
            if w is None:  # another modality's block
                rows.append((None, None, None))
                continue
            try:
                im = _painted([int(x) for x in w])
                rows.append((im.shape[1], im.shape[0], im.ravel().tolist()))
            except (ValueError, TypeError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "pixels"])

    made = F.pandas_udf(run, "width int, height int, pixels array<int>")(words)
    return F.when(made["width"].isNotNull(), made)


def decoded(images: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b, error) of images (image_id, words); a malformed one gives a row with its error alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, words in zip(batch["image_id"], batch["words"]):
                try:
                    im = _painted([int(w) for w in words])
                except ValueError as e:
                    yield pd.DataFrame({"image_id": [image_id], "x": [None], "y": [None], "r": [None], "g": [None], "b": [None], "error": [str(e)]})
                    continue
                y, x = np.mgrid[: im.shape[0], : im.shape[1]]
                yield pd.DataFrame({"image_id": image_id, "x": x.ravel(), "y": y.ravel(), **{c: im[:, :, k].ravel().astype(int) for k, c in enumerate(CHANNELS)}, "error": None})

    return images.select("image_id", "words").mapInPandas(run, "image_id long, x int, y int, r int, g int, b int, error string")


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, psnr) of images with the same pixels; 99 for equal ones."""
    other = b.select("image_id", "x", "y", *[F.col(c).alias(f"o_{c}") for c in CHANNELS])
    error = sum((F.pow((F.col(c) - F.col(f"o_{c}")).cast("double"), 2) for c in CHANNELS), F.lit(0.0)) / 3
    mse = a.join(other, ["image_id", "x", "y"]).groupBy("image_id").agg(F.avg(error).alias("mse"))
    return mse.select("image_id", F.when(F.col("mse") == 0, 99.0).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / F.when(F.col("mse") != 0, F.col("mse")))).alias("psnr"))


def grammar(images: DataFrame) -> DataFrame:
    """(image_id, balanced, no_underflow, headers, families): checks of image words as running sums over their order."""
    order = Window.partitionBy("image_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = images.select("image_id", F.posexplode("words").alias("pos", "word"))
    command = F.when(~W.has("word", 0x200), F.shiftright("word", 6).bitwiseAND(7))
    arg = F.greatest(F.col("word").bitwiseAND(63), F.lit(1))
    move = F.when(command < 4, arg).when(command == BACKTRACK, -arg).otherwise(0)
    run = w.withColumns({"depth": F.sum(move).over(order), "begin": (command == META) & (F.col("word").bitwiseAND(63) == 0), "family": F.col("word").bitwiseAND(W.IMAGE_FAMILY)})
    return run.groupBy("image_id").agg((F.max_by("depth", "pos") == 0).alias("balanced"), (F.min("depth") >= 0).alias("no_underflow"), F.count_if("begin").alias("headers"), F.count_distinct("family").alias("families"))
