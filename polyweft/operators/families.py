"""Image streams of several layouts: encoding in the older two, finding a stream's family, checking its grammar, and painting it.

Words of an image stream are extension words of version 0; all others are passed over. A stream's family is told by
two bits that all its words share. Its grammar has a depth, and a state that words set and others leave alone: both
compose, as sums and as the last value that was set, so that running windows give the state before each word, and the
first word that does not fit its state gives the stream's error. A stream that fits is painted by relations too: a step
back undoes the step that last reached its level, which the words of that level alone tell, so a node's place is a
running sum of steps done and undone; of nodes painted over each other the last counts.

A stream whose words have a run do the command so often. A stream of no image words has no family. Null words are none.
Equal image ids are one image, and its words have one order, by ``words``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweft.functions import words as W
from polyweft.operators import images as I
from polyweft.storage import written

LEGACY, ENHANCED = "legacy", "enhanced"
# fixed values: the bit of a colour or datum, and the kinds of the header's data in order
DATUM = 0x0200
HEADER = ("width_high", "width_low", "height_high", "height_low", "root_high", "root_low", "bit_depth", "threshold")


# ---- the older two layouts


def spread(level: Column) -> Column:
    """A channel of the legacy layout: three bits over a byte."""
    return F.shiftleft(level, 5).bitwiseOR(F.shiftleft(level, 2)).bitwiseOR(F.shiftright(level, 1))


def legacy_encoded(pixels: DataFrame, threshold: float = 5.0) -> DataFrame:
    """(image_id, words, width, height) in the legacy layout, of three bits a channel; nodes are split by the bytes that these stand for."""
    named = {c: F.shiftright(F.col(c).cast("int"), 5) for c in I.CHANNELS}
    square = I.padded(pixels.withColumns(named))
    square = square.withColumns({f"level_{c}": F.col(c) for c in I.CHANNELS}).withColumns({c: spread(F.col(c)) for c in I.CHANNELS})
    command = lambda c: W.extension((F.lit(c) if isinstance(c, int) else c).cast("int") * 64 + (W.IMAGE_LEGACY | 1))
    colour = lambda s: [command(I.SET_COLOUR), W.extension(s["r"] * 64 + s["g"] * 8 + s["b"] + (W.IMAGE_LEGACY | DATUM))]
    found = I.leaves(square, threshold, tuple(f"level_{c}" for c in I.CHANNELS))
    return _whole(I.leaf_words(found, level=lambda c: c, command=command, colour_words=colour), square)


def base_encoded(pixels: DataFrame, threshold: float = 5.0, bit_depth: int = 3) -> DataFrame:
    """(image_id, words, width, height) in the base layout, which has the type bit of drawings and no family."""
    square = I.padded(pixels.withColumns({c: I.truncated(F.col(c).cast("int"), bit_depth) for c in I.CHANNELS}))
    command = lambda c: W.extension((F.lit(c) if isinstance(c, int) else c).cast("int") * 1024 + (W.DIAGRAM | 1))
    datum = lambda k, v: W.extension(v + (W.DIAGRAM | 1 << 13 | k << 10))
    colour = lambda s: [command(I.SET_COLOUR), *[datum(k, s[c]) for k, c in enumerate(I.CHANNELS)]]
    return _whole(I.leaf_words(I.leaves(square, threshold), level=lambda c: I.truncated(c, bit_depth), command=command, colour_words=colour), square)


def _whole(leaves: DataFrame, square: DataFrame) -> DataFrame:
    parts = leaves.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("path", "words"))).alias("parts"))
    size = square.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    return parts.join(size, "image_id").select("image_id", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"), "width", "height")


# ---- state before each word


def _states(images: DataFrame) -> DataFrame:
    """Image words with what they say and the state before them."""
    w = images.select("image_id", F.posexplode("words").alias("pos", "word"))
    w = w.where((W.mode("word") == W.EXTENSION) & (W.version("word") == 0)).withColumn("p", W.payload("word"))
    order = Window.partitionBy("image_id").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    datum, code, arg = F.col("p").bitwiseAND(DATUM) != 0, F.shiftright("p", 6).bitwiseAND(7), F.col("p").bitwiseAND(63)
    said = w.withColumns({"marker": F.col("p").bitwiseAND(W.IMAGE_FAMILY), "datum": datum, "code": code, "arg": arg, "run": F.greatest(arg, F.lit(1))})
    # a header is opened and closed by its own two commands; the legacy layout has none
    bracket = (F.col("marker") == W.IMAGE_ENHANCED) & ~F.col("datum") & (F.col("code") == I.META)
    said = said.withColumns({"begins": bracket & (F.col("arg") == 0), "ends": bracket & (F.col("arg") == 1)})
    said = said.withColumn("open", F.coalesce(F.last(F.when(F.col("begins"), True).when(F.col("ends"), False), ignorenulls=True).over(before), F.lit(False)))
    move = F.when(F.col("datum"), 0).when(F.col("code") < 4, F.col("run")).when(F.col("code") == I.BACKTRACK, -F.col("run")).otherwise(0)
    sets = ~F.col("datum") & (F.col("code") == I.SET_COLOUR)
    said = said.withColumns({"move": move, "sets": sets, "colour": F.col("datum") & ~F.col("open")})
    said = said.withColumns({"depth": F.coalesce(F.sum("move").over(before), F.lit(0)), "colours": F.coalesce(F.sum(F.col("colour").cast("int")).over(before), F.lit(0)), "after_set": F.coalesce(F.lag("sets").over(order), F.lit(False))})
    # how many colour words there were when a colour was last asked for, and when each channel was last told
    asked = {"asked": F.last(F.when(F.col("sets"), F.col("colours")), ignorenulls=True).over(before)}
    told = {f"told_{k}": F.last(F.when(F.col("colour") & (F.col("code") == k), F.col("colours")), ignorenulls=True).over(before) for k in range(3)}
    return said.withColumns({**asked, **told})


def _legacy_error() -> Column:
    c = F.col
    return (
        F.when(c("datum") & ~c("after_set"), "a colour that no command asks for").when(~c("datum") & c("after_set"), "a command in place of a colour")
        .when(~c("datum") & (c("code") == I.BACKTRACK) & (c("depth") < c("run")), "a step above the root").when(c("sets") & (c("run") != 1), "a colour asked for several times")
    )


def _enhanced_error() -> Column:
    c = F.col
    pending = c("asked").isNotNull() & (c("colours") - c("asked") < 3)
    again = F.lit(False)
    for k in range(3):
        again = again | ((c("code") == k) & (c(f"told_{k}") >= c("asked")))
    bracket = ~c("datum") & (c("code") == I.META)
    return (
        F.when(c("colour") & ~pending, "a datum that no command asks for").when(c("colour") & (c("code") > 2), "a datum of the header outside it").when(c("colour") & F.coalesce(again, F.lit(False)), "a channel told twice")
        .when(c("begins") & c("open"), "a header in a header").when(c("ends") & ~c("open"), "an end without a header").when(bracket & ~c("begins") & ~c("ends"), "a header command of no meaning")
        .when(~c("datum") & ~bracket & c("open"), "a command in the header").when(~c("datum") & (c("code") == I.BACKTRACK) & (c("depth") < c("run")), "a step above the root").when(c("sets") & pending, "a colour asked for before the last was told")
    )


def checked(images: DataFrame) -> DataFrame:
    """(image_id, family, error, and the header's values) of each stream (image_id, words): error is null for a stream that can be painted."""
    return _checked(images, _states(images))


def _checked(images: DataFrame, states: DataFrame) -> DataFrame:
    c = F.col
    s = states.withColumns({"legacy_error": _legacy_error(), "enhanced_error": _enhanced_error()})
    first = lambda e: F.min_by(e, F.when(c(e).isNotNull(), c("pos"))).alias(e)
    header = [F.max_by("arg", F.when(c("datum") & c("open") & (c("code") == k), c("pos"))).alias(name) for k, name in enumerate(HEADER)]
    asked = F.max_by("colours", F.when(c("sets"), c("pos")))
    by_image = s.groupBy("image_id").agg(
        F.min_by("marker", "pos").alias("first_family"), (F.min("marker") != F.max("marker")).alias("mixed"), first("legacy_error"), first("enhanced_error"), *header, F.sum("move").alias("left"),
        F.bool_or("sets").alias("has_colour"), F.bool_or(~c("datum") & (c("code") == I.PAINT)).alias("has_paint"), F.max_by("sets", "pos").alias("asks"), F.max_by("begins", F.when(c("begins") | c("ends"), c("pos"))).alias("left_open"),
        F.count_if("begins").alias("begun"), F.count_if("ends").alias("ended"), F.coalesce(F.count_if("colour") - asked < 3, F.lit(False)).alias("untold"), F.max(F.when(c("colour"), c("arg"))).alias("largest"),
    )
    whole = F.when(c("left") != 0, "it does not end at the root").when(~c("has_colour") | ~c("has_paint"), "nothing is painted")
    legacy = F.coalesce("legacy_error", F.when(c("asks"), "it ends before a colour"), whole)
    missing = sum((c(name).isNull().cast("int") for name in HEADER), F.lit(0))
    root = c("root_high") * 64 + c("root_low")
    framed = F.when(F.coalesce("left_open", F.lit(False)), "it ends in the header").when(c("untold"), "it ends before a colour").when((c("begun") != 1) | (c("ended") != 1), "not one header").when(missing > 0, "a header without all values")
    sized = F.when(root == 0, "a root of no size").when(c("largest") >= F.expr("shiftleft(1, greatest(1, least(bit_depth, 6)))"), "a colour beyond the bit depth")
    enhanced = F.coalesce("enhanced_error", framed, whole, sized)
    known = F.when(c("first_family") == W.IMAGE_LEGACY, LEGACY).when(c("first_family") == W.IMAGE_ENHANCED, ENHANCED)
    told = by_image.select(
        "image_id", F.when(~c("mixed"), known).alias("family"), F.when(known.isNull(), "no image family").when(c("mixed"), "several families").when(known == LEGACY, legacy).otherwise(enhanced).alias("error"),
        (c("width_high") * 64 + c("width_low")).alias("header_width"), (c("height_high") * 64 + c("height_low")).alias("header_height"), root.alias("root"), F.greatest(F.lit(1), F.least("bit_depth", F.lit(6))).alias("bit_depth"),
    )
    out = images.select("image_id").distinct().join(told.withColumn("seen", F.lit(True)), "image_id", "left")
    return out.withColumn("error", F.when(c("seen").isNull(), "no image family").otherwise(c("error"))).drop("seen")


# ---- painting


def decoded(images: DataFrame) -> DataFrame:
    """(image_id, family, x, y, r, g, b, error): all pixels of each stream that fits, one row with the error of each that does not.

    ``images`` has image_id, words, width and height; the size is asked of legacy streams alone, which do not tell it,
    and a legacy stream without one has an error. Pixels that nothing paints are black.
    """
    c = F.col
    states = written(_states(images), "image-states")
    size = images.select("image_id", c("width").alias("given_width"), c("height").alias("given_height"))
    told = _checked(images, states).join(size, "image_id")
    legacy = c("family") == LEGACY
    unsized = legacy & c("error").isNull() & (c("given_width").isNull() | c("given_height").isNull() | (c("given_width") < 1) | (c("given_height") < 1))
    told = told.withColumn("error", F.when(unsized, "a legacy stream without its size").otherwise(c("error")))
    around = F.expr("shiftleft(1, cast(ceil(log2(greatest(given_width, given_height))) as int))")
    told = told.withColumns({"root": F.when(legacy, around).otherwise(c("root")), "width": F.when(legacy, c("given_width")).otherwise(c("header_width")), "height": F.when(legacy, c("given_height")).otherwise(c("header_height"))})
    told = written(told.select("image_id", "family", "error", "root", "width", "height", "bit_depth"), "image-sizes")
    good = told.where("error is null")

    w = states.join(good, "image_id")
    # one row for each level that is entered or left
    steps = w.where("move <> 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.abs("move").cast("int"))))
    down = c("move") > 0
    steps = steps.withColumn("level", F.when(down, c("depth") + c("k")).otherwise(c("depth") - c("k") + 1))
    half = F.greatest(F.lit(1), F.expr("cast(floor(root / pow(2, level)) as int)"))
    steps = steps.withColumns({"dx": F.when(down, half * c("code").bitwiseAND(1)), "dy": F.when(down, half * F.shiftright("code", 1))})
    same = Window.partitionBy("image_id", "level").orderBy("pos", "k")
    done = lambda d: F.coalesce(d, -F.lag(d).over(same))
    moves = steps.select("image_id", "pos", "k", done("dx").alias("dx"), done("dy").alias("dy")).groupBy("image_id", "pos").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    paints = (~c("datum")) & (c("code") == I.PAINT)
    # the colour words come by the order in which they are asked for: a legacy colour is one word, an enhanced one three
    asked = F.when(c("sets"), c("run")).otherwise(0)
    order = Window.partitionBy("image_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    legacy_colour = F.last(F.when(legacy & c("datum"), c("p").bitwiseAND(511)), ignorenulls=True)
    placed = w.join(moves, ["image_id", "pos"], "left").withColumns({"x": F.coalesce(F.sum("dx").over(order), F.lit(0)), "y": F.coalesce(F.sum("dy").over(order), F.lit(0)), "nth": F.sum(asked).over(order), "c3": legacy_colour.over(order)})
    nodes = placed.where(paints).withColumn("size", F.greatest(F.lit(1), F.expr("cast(floor(root / pow(2, depth)) as int)")))
    last = nodes.groupBy("image_id", "x", "y", "size").agg(F.max("pos").alias("pos"), F.max_by("nth", "pos").alias("nth"), F.max_by("c3", "pos").alias("c3"))
    triples = w.where(c("colour") & ~legacy).groupBy("image_id", (F.floor(c("colours") / 3) + 1).alias("nth")).agg(*[F.max(F.when(c("code") == k, c("arg"))).alias(f"l_{n}") for k, n in enumerate(I.CHANNELS)])
    coloured = last.join(triples, ["image_id", "nth"], "left").join(good, "image_id")
    enhanced_value = lambda n: F.rint(F.coalesce(f"l_{n}", F.lit(0)) / F.expr("double(shiftleft(1, bit_depth) - 1)") * 255.0).cast("int")
    legacy_value = lambda k: spread(F.shiftright(F.coalesce("c3", F.lit(0)), 6 - 3 * k).bitwiseAND(7))
    values = F.struct(*[F.when(legacy, legacy_value(k)).otherwise(enhanced_value(n)).alias(n) for k, n in enumerate(I.CHANNELS)])
    until = lambda a, s, most: F.least(c(a) + c(s), c(most), c("root")) - 1
    seen = coloured.withColumn("v", values).where("x < least(width, root) and y < least(height, root)")
    columns = seen.withColumn("px", F.explode(F.sequence(c("x").cast("int"), until("x", "size", "width").cast("int")))).withColumn("py", F.explode(F.sequence(c("y").cast("int"), until("y", "size", "height").cast("int"))))
    painted = columns.groupBy("image_id", c("px").alias("x"), c("py").alias("y")).agg(F.max_by("v", "pos").alias("v"))
    sides = good.where("width > 0 and height > 0").select("image_id", "family", F.explode(F.expr("sequence(0, cast(least(width, root) as int) - 1)")).alias("x"), F.least("height", "root").alias("h"))
    grid = sides.withColumn("y", F.explode(F.expr("sequence(0, cast(h as int) - 1)")))
    pixels = grid.join(painted, ["image_id", "x", "y"], "left")
    out = pixels.select("image_id", "family", "x", "y", *[F.coalesce(F.col(f"v.{n}"), F.lit(0)).alias(n) for n in I.CHANNELS], F.lit(None).cast("string").alias("error"))
    failed = told.where("error is not null").select("image_id", "family", *[F.lit(None).cast("int").alias(n) for n in ("x", "y", *I.CHANNELS)], "error")
    return out.unionByName(failed)
