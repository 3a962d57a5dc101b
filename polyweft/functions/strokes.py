"""Strokes made of other records: drawings anchored at each corner, voice timelines, anchored touch and touch traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyweft.functions import codecs as C
from polyweft.functions import scalars as S
from polyweft.functions import words as W

# fixed values: place of each body region on the anchor grid, by region number
CENTROIDS = ((3, 2), (5, 1), (7, 1), (9, 2), (11, 3), (4, 6), (10, 7), (7, 7), (7, 10), (7, 12), (8, 2), (8, 3), (8, 4), (8, 9), (8, 11), (8, 14))
# fixed values: receptors by number with their short name and whether they carry direction, pressure and vibration
RECEPTORS = (("SA-I", True, True, False), ("RA-I", True, True, False), ("RA-II", False, False, True), ("SA-II", True, True, False))
# fixed values: directions that follow a phoneme's duration, by its class
PATTERNS = {"vowel": (0,), "stop": (0, 6), "affricate": (0, 1), "fricative": (0, 1), "nasal": (0, 7), "liquid": (0, 4), "glide": (0, 4), "silence": (), "other": (0,)}
# fixed values: lane of a pitch trend, and the directions that go right
LANES = {"UP": -1, "DOWN": 1}
RIGHT = (0, 1, 7)


def anchored_segments(points: Column) -> Column:
    """A move and its steps for each side of a polyline: struct(x, y, directions); fewer than two points give none."""
    at = lambda i, c: F.element_at(points, i)[c].cast("int")
    sides = F.filter(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: i < F.size(points))
    return F.transform(sides, lambda i: F.struct(at(i, "x").alias("x"), at(i, "y").alias("y"), C.segment_steps(at(i, "x"), at(i, "y"), at(i + 1, "x"), at(i + 1, "y")).alias("directions")))


def voice_stroke(symbol: Column, stress: Column, trend: Column, start: Column, duration: Column) -> Column:
    """struct(x, lane, directions) of a phoneme's span: a step right for each tick, none for silence, then the pattern of its class."""
    kind = S.phoneme_class(symbol)
    pattern = F.when(F.lit(False), C.ints(()))
    for name, steps in PATTERNS.items():
        pattern = pattern.when(kind == name, C.ints(steps))
    bump = F.when((kind == "vowel") & stress, C.ints((2, 6))).otherwise(C.ints(()))
    ticks = F.when(kind == "silence", C.ints(())).otherwise(F.array_repeat(F.lit(0), F.greatest(F.lit(1), duration.cast("int"))))
    lane = F.coalesce(*[F.when(trend == name, v) for name, v in LANES.items()], F.lit(0))
    return F.struct(start.cast("int").alias("x"), lane.alias("lane"), F.concat(ticks, bump, pattern).alias("directions"))


def voice_span(stroke: Column) -> Column:
    """struct(start, duration) that a stroke tells: its steps to the right, one at least."""
    right = F.size(F.filter(stroke["directions"], lambda d: d.isin(*RIGHT)))
    return F.struct(stroke["x"].alias("start"), F.greatest(F.lit(1), right).alias("duration"))


def _nibble(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(15), value.cast("int")))


def anchor(region: Column, dx: Column, dy: Column) -> Column:
    """struct(x, y): the region's centroid moved by an offset, inside the grid; unknown regions give nulls."""
    place = lambda k: F.get(C.ints([c[k] for c in CENTROIDS]), region)
    return F.struct(_nibble(place(0) + dx).alias("x"), _nibble(place(1) + dy).alias("y"))


def anchored_touch_words(at: Column, receptor: Column, region: Column, directions: Column, pressures: Column) -> Column:
    """An anchor word and the words of one stroke."""
    head = W.extension(C.bits((W.TOUCH, 0), (2, 8), (at["x"], 4), (at["y"], 0)), 2)
    return F.concat(F.array(head), C.touch_words(receptor, region, directions, pressures))


def anchored_touch(words: Column) -> Column:
    """struct(x, y, stroke) of words that begin with an anchor and hold a stroke, else null."""
    first = F.get(words, F.lit(0))
    is_anchor = (W.mode(first) == W.EXTENSION) & (W.version(first) == 2) & W.has(first, W.TOUCH) & (F.shiftright(first, 8).bitwiseAND(7) == 2)
    strokes = C.touch_strokes(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    return F.when(is_anchor & (F.size(strokes) > 0), F.struct(F.shiftright(first, 4).bitwiseAND(15).alias("x"), first.bitwiseAND(15).alias("y"), F.get(strokes, F.lit(0)).alias("stroke")))


def contour_trace(loops: Column) -> Column:
    """struct(directions, pressures): all eight directions in turn, at pressure 4."""
    n = 8 * F.greatest(F.lit(1), loops.cast("int"))
    return F.struct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i % 8).alias("directions"), F.array_repeat(F.lit(4), n).alias("pressures"))


def press_trace(peak: Column, steps: Column) -> Column:
    """struct(directions, pressures): up to a peak and down again in equal steps, halves to even; a single step is at its end."""
    n = F.greatest(F.lit(1), steps.cast("int"))
    level = lambda a, b: F.when(n == 1, F.array(b.cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: C.clamped(F.rint(a + (b - a) * (i / F.greatest(n - 1, F.lit(1)))), 0, 7).cast("int")))
    directions = F.concat(F.array_repeat(F.lit(2), n), F.array_repeat(F.lit(6), n))
    return F.struct(directions.alias("directions"), F.concat(level(F.lit(0), peak), level(peak, F.lit(0))).alias("pressures"))
