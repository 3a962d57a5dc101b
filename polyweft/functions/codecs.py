"""Packing of the modalities' records into words and back, as expressions over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyweft.functions import words as W
from polyweft.functions.scalars import ints

# fixed values: unit steps of the eight directions, counter-clockwise from the right, y downwards
STEPS = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))
NONE = "cast(array() as array<int>)"


def none() -> Column:
    return F.expr(NONE)


def joined(parts: Column) -> Column:
    return F.flatten(parts)


def clamped(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast("int")


def rounded(value: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.rint(value).cast("int")


def bits(*parts: tuple[Column | int, int]) -> Column:
    """Values shifted and put together: (value, shift), ..."""
    out = F.lit(0)
    for value, shift in parts:
        v = F.lit(value) if isinstance(value, int) else value.cast("int")
        out = out.bitwiseOR(F.shiftleft(v, shift))
    return out


# --- taste


def taste_words(event: Column) -> Column:
    """Words of one event: struct(dominant, secondary, intensity, direction, temporal, flavor)."""
    byte = lambda v, b: W.extension(bits((b.cast("int").bitwiseAND(255), 0), (W.TASTE, 0)), v)
    pair = lambda a, b: bits((a.cast("int").bitwiseAND(7), 3), (b.cast("int").bitwiseAND(7), 0))
    head = F.array(byte(0, pair(event["dominant"], event["secondary"])), byte(1, pair(event["intensity"], event["direction"])))
    return F.concat(head, F.transform(event["temporal"], lambda b: byte(2, b)), F.transform(event["flavor"], lambda b: byte(3, b)))


def taste_events(words: Column) -> Column:
    """Events of a block: one from each word of version 0 that words of versions 1 and 2 follow; later words of versions 2, 3 belong to it."""
    at = lambda i: F.get(words, i)
    is_ = lambda i, v: F.coalesce(W.is_taste_bit(at(i)) & (W.version(at(i)) == v), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: is_(i, 0) & is_(i + 1, 1) & is_(i + 2, 2))
    low = lambda w: W.payload(w, 8)
    # an event ends before the first word after its third that is no continuation
    rest = lambda s: F.slice(words, s + 3, F.greatest(F.size(words) - s - 2, F.lit(0)))
    stop = lambda s: F.coalesce(F.get(F.filter(F.transform(rest(s), lambda w, k: F.when(W.is_taste_bit(w) & W.version(w).isin(2, 3), -1).otherwise(k)), lambda k: k >= 0), F.lit(0)), F.size(rest(s)))
    body = lambda s: F.slice(rest(s), 1, stop(s))
    version_of = lambda s, v: F.transform(F.filter(body(s), lambda w: W.version(w) == v), low)
    field = lambda i, shift: F.shiftright(low(at(i)), shift).bitwiseAND(7)
    event = lambda s: F.struct(field(s, 3).alias("dominant"), field(s, 0).alias("secondary"), field(s + 1, 3).alias("intensity"), field(s + 1, 0).alias("direction"), version_of(s, 2).alias("temporal"), version_of(s, 3).alias("flavor"))
    return F.when(F.size(words) > 0, F.transform(starts, event))


# --- smell


def _smell(op: int, data: Column) -> Column:
    return W.extension(bits((W.SMELL, 0), (op, 6), (data.cast("int").bitwiseAND(63), 0)))


def smell_words(category: Column, pleasantness: Column, intensity: Column, directions: Column, sniff_hz: Column | None = None) -> Column:
    """Words of one odor stroke of at most seven steps; ``sniff_hz`` puts its word first."""
    pair = lambda a, b: bits((a.cast("int").bitwiseAND(7), 3), (b.cast("int").bitwiseAND(7), 0))
    head = F.array(_smell(0, pair(category, pleasantness)), _smell(1, pair(intensity, F.size(directions))))
    steps = F.transform(directions, lambda d, i: _smell(2, pair(d, F.least(i, F.lit(3)))))
    body = F.when(F.size(directions) <= 7, F.concat(head, steps)).otherwise(F.raise_error(F.lit("an odor stroke has at most 7 steps")).cast("array<int>"))
    return body if sniff_hz is None else F.concat(F.array(_smell(3, sniff_hz)), body)


def augmented_words(category: Column, pleasantness: Column, intensity: Column, directions: Column, tree: Column, complexity: Column, chirality: Column) -> Column:
    """A stroke and two more words: three tree operations, then chirality and complexity."""
    code = F.aggregate(F.transform(tree, lambda t, i: F.call_function("shiftleft", t.cast("int").bitwiseAND(3), i * 2)), F.lit(0), lambda a, x: a.bitwiseOR(x))
    return F.concat(smell_words(category, pleasantness, intensity, directions), F.array(_smell(3, code), _smell(3, bits((chirality, 4), (complexity.cast("int").bitwiseAND(15), 0)))))


def smell_strokes(words: Column) -> Column:
    """Strokes of a block: a header pair and the steps that follow it, as many as it announces at most."""
    op = lambda i: F.shiftright(F.get(words, i), 6).bitwiseAND(3)
    data = lambda i: F.get(words, i).bitwiseAND(63)
    ok = lambda i: F.coalesce((W.mode(F.get(words, i)) == W.EXTENSION) & (W.version(F.get(words, i)) == 0) & W.has(F.get(words, i), W.SMELL), F.lit(False))
    heads = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ok(i) & ok(i + 1) & (op(i) == 0) & (op(i + 1) == 1))
    wanted = lambda i: data(i + 1).bitwiseAND(7)
    near = lambda i: F.slice(F.sequence(i + 2, i + 9), 1, wanted(i))
    stop = lambda i: F.coalesce(F.get(F.filter(near(i), lambda k: ~ok(k) | (op(k) != 2)), F.lit(0)), i + 2 + wanted(i))
    steps = lambda i: F.transform(F.filter(near(i), lambda k: k < stop(i)), lambda k: F.shiftright(data(k), 3).bitwiseAND(7))
    stroke = lambda i: F.struct(F.shiftright(data(i), 3).bitwiseAND(7).alias("category"), data(i).bitwiseAND(7).alias("pleasantness"), F.shiftright(data(i + 1), 3).bitwiseAND(7).alias("intensity"), steps(i).alias("directions"))
    return F.when(F.size(words) > 0, F.transform(heads, stroke))


def augmented_records(words: Column) -> Column:
    """Strokes of a block with the two words after their steps: tree operations, complexity and chirality; nulls where those are missing."""
    op = lambda i: F.shiftright(F.get(words, i), 6).bitwiseAND(3)
    data = lambda i: F.get(words, i).bitwiseAND(63)
    ok = lambda i: F.coalesce((W.mode(F.get(words, i)) == W.EXTENSION) & (W.version(F.get(words, i)) == 0) & W.has(F.get(words, i), W.SMELL), F.lit(False))
    heads = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ok(i) & ok(i + 1) & (op(i) == 0) & (op(i + 1) == 1))
    after = lambda i: i + 2 + data(i + 1).bitwiseAND(7)
    meta = lambda i, k: F.when(ok(after(i) + k) & (op(after(i) + k) == 3), data(after(i) + k))
    tree = lambda i: F.array(*[F.shiftright(meta(i, 0), 2 * k).bitwiseAND(3) for k in range(3)])
    return F.when(F.size(words) > 0, F.transform(heads, lambda i: F.struct(i.alias("at"), tree(i).alias("tree"), meta(i, 1).bitwiseAND(15).alias("complexity"), F.shiftright(meta(i, 1), 4).alias("chirality"))))


def episode_words(level: Column, half_life: Column, floor: Column, records: Column) -> Column:
    """Three header words and one to four packed records."""
    n = F.size(records)
    # fixed values: markers of the header, the half-life and the floor
    head = F.array(_smell(3, bits((0x30, 0), (level.cast("int").bitwiseAND(3), 2), (n - 1, 0))), _smell(3, bits((0x20, 0), (half_life.cast("int").bitwiseAND(15), 0))), _smell(3, bits((0x10, 0), (floor.cast("int").bitwiseAND(15), 0))))
    return F.when(n.between(1, 4), F.concat(head, F.flatten(records))).otherwise(F.raise_error(F.lit("an episode has 1 to 4 records")).cast("array<int>"))


def episode(words: Column) -> Column:
    """struct(level, sniffs, half_life, floor, records) of a block that starts with an episode's header, else null; a level of 3 counts as 0."""
    data = lambda i: F.get(words, F.lit(i)).bitwiseAND(63)
    is_ = lambda i, marker: F.shiftright(F.get(words, F.lit(i)), 6).bitwiseAND(3).eqNullSafe(3) & (data(i).bitwiseAND(0x30) == marker)
    level = F.shiftright(data(0), 2).bitwiseAND(3)
    sniffs = data(0).bitwiseAND(3) + 1
    records = F.slice(augmented_records(words), F.lit(1), sniffs)
    return F.when(is_(0, 0x30) & is_(1, 0x20) & is_(2, 0x10), F.struct(F.when(level < 3, level).otherwise(0).alias("level"), sniffs.alias("sniffs"), data(1).bitwiseAND(15).alias("half_life"), data(2).bitwiseAND(15).alias("floor"), records.alias("records")))


def odor_signature(category: Column, pleasantness: Column, intensity: Column, directions: Column, tree: Column, complexity: Column, chirality: Column) -> Column:
    """A key that equal augmented records share."""
    parts = F.concat(F.array(category.cast("int"), pleasantness.cast("int"), intensity.cast("int")), directions, tree, F.array(complexity.cast("int"), chirality.cast("int")))
    return F.array_join(F.transform(parts, lambda p: p.cast("string")), ",")


# fixed values: weights of floral, fruity, spicy, woody, chemical in the two axes
PLEASANT_WEIGHTS = (0.95, 0.8, 0.15, -0.25, -1.0)
INTENSE_WEIGHTS = (0.35, 0.45, 0.65, 0.75, 0.95)
# fixed values: place and complexity of the odor categories
ODORS = {"FLORAL": (6, 3, 2), "FRUITY": (6, 4, 2), "SPICY_HERBAL": (4, 4, 3), "WOODY_EARTHY": (3, 5, 5), "CHEMICAL_SOLVENT": (1, 6, 6), "MUSKY_ANIMAL": (5, 5, 5), "MINTY_CAMPHOR": (4, 6, 4), "PUTRID_DECAY": (0, 7, 6)}


def _axis(weights: tuple[float, ...], quality: Column) -> Column:
    low, high = sum(min(0.0, w) for w in weights), sum(max(0.0, w) for w in weights)
    raw = sum((F.lit(w) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(quality, F.lit(i)).cast("double"))) for i, w in enumerate(weights)), F.lit(0.0))
    return clamped(F.rint((raw - low) / (high - low) * 7.0), 0, 7)


def odor_place(quality: Column) -> Column:
    """struct(pleasantness, intensity) of a five-channel quality."""
    return F.struct(_axis(PLEASANT_WEIGHTS, quality).alias("pleasantness"), _axis(INTENSE_WEIGHTS, quality).alias("intensity"))


def odor_place3(pleasantness: Column, intensity: Column, complexity: Column) -> Column:
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    return F.struct(clamped(F.rint((unit(pleasantness) - 0.15 * unit(complexity)) * 7.0), 0, 7).alias("pleasantness"), clamped(F.rint((unit(intensity) + 0.1 * unit(complexity)) * 7.0), 0, 7).alias("intensity"))


def direction_of(dx: Column, dy: Column) -> Column:
    """The direction of a unit step; null for none."""
    chain = F.when(F.lit(False), 0)
    for i, (x, y) in enumerate(STEPS):
        chain = chain.when((F.signum(dx) == x) & (F.signum(dy) == y), i)
    return chain


def step_of(direction: Column) -> Column:
    dx, dy = ints([x for x, _ in STEPS]), ints([y for _, y in STEPS])
    return F.struct(F.get(dx, direction).alias("dx"), F.get(dy, direction).alias("dy"))


def odor_walk(pleasantness: Column, intensity: Column, directions: Column) -> Column:
    """Places of a walk on the 8 by 8 grid, the start first; each step stops at the border."""
    start = F.array(F.struct(pleasantness.cast("int").alias("p"), intensity.cast("int").alias("i")))
    last = lambda a: F.element_at(a, -1)
    move = lambda a, d: F.struct(clamped(last(a)["p"] + step_of(d)["dx"], 0, 7).alias("p"), clamped(last(a)["i"] - step_of(d)["dy"], 0, 7).alias("i"))
    return F.aggregate(directions, start, lambda a, d: F.concat(a, F.array(move(a, d))))


def sniff_pattern(pleasantness: Column) -> Column:
    return F.when(pleasantness >= 5, ints((2, 1, 0, 6))).when(pleasantness <= 2, ints((2, 3, 4, 6))).otherwise(ints((2, 2, 4, 6)))


def adapted(intensity: Column, sniff: Column, half_life: Column, floor: Column) -> Column:
    """Intensity at a sniff under exponential adaptation towards a floor."""
    low = F.least(F.lit(7), rounded(floor / 15.0 * 7.0))
    value = low + F.greatest(F.lit(0.0), intensity.cast("double") - low) * F.pow(F.lit(0.5), sniff.cast("double") / F.greatest(F.lit(1), half_life))
    return F.when(sniff == 0, intensity.cast("int")).otherwise(clamped(F.rint(value), 0, 7))


def complexity_hint(weight: Column, groups: Column) -> Column:
    own = F.array_distinct(F.transform(groups, lambda g: F.lower(F.trim(g))))
    score = 0.55 * (F.least(F.lit(6.0), F.size(own).cast("double")) / 6.0) + 0.35 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight) / 220.0) + F.when(F.array_contains(own, "aromatic"), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


# fixed values: functional groups with a pleasant and with an aversive leaning
PLEASANT = ("ester", "terpene", "alcohol", "aldehyde", "lactone", "ketone")
AVERSIVE = ("sulfur", "thiol", "amine", "halogen", "nitro")


def tree_operations(weight: Column, vapor: Column, groups: Column, bias: Column) -> Column:
    """Three operations (0 left, 1 right, 2 descend, 3 ascend) of a molecular description."""
    own = F.array_distinct(F.transform(groups, lambda g: F.lower(F.trim(g))))
    any_of = lambda names: F.arrays_overlap(own, F.array(*[F.lit(n) for n in names]))
    first = F.when(any_of(AVERSIVE), 0).when(any_of(PLEASANT) | (bias >= 4.0), 1).otherwise(0)
    second = F.when(vapor >= 1.6, 2).otherwise(3)
    score = F.size(own) + F.array_contains(own, "aromatic").cast("int") + (weight >= 150).cast("int")
    return F.array(first, second, F.when(score <= 2, 0).when(score <= 4, 1).otherwise(2))


# --- touch


def touch_words(receptor: Column, region: Column, directions: Column, pressures: Column) -> Column:
    """A header and one word for each direction; missing pressures are 0."""
    head = W.extension(bits((W.TOUCH, 0), (receptor, 9), (region, 5), (31, 0)), 1)
    steps = F.transform(directions, lambda d, i: W.extension(bits((W.TOUCH, 0), (d, 3), (F.coalesce(F.get(pressures, i), F.lit(0)), 0))))
    return F.concat(F.array(head), steps)


def touch_strokes(words: Column) -> Column:
    """Strokes of a block: header words of version 1 and the words of version 0 up to the next header."""
    at = lambda i: F.get(words, i)
    is_head = lambda i: (W.mode(at(i)) == W.EXTENSION) & W.has(at(i), W.TOUCH) & (W.version(at(i)) == 1) & (at(i).bitwiseAND(31) == 31)
    heads = F.filter(F.sequence(F.lit(0), F.size(words) - 1), is_head)
    end = lambda h: F.coalesce(F.get(F.filter(heads, lambda k: k > h), F.lit(0)), F.size(words))
    own = lambda h: F.filter(F.slice(words, h + 2, end(h) - h - 1), lambda w: (W.version(w) == 0) & W.has(w, W.TOUCH))
    three = lambda w, s: F.shiftright(w, s).bitwiseAND(7)
    stroke = lambda h: F.struct(F.shiftright(at(h), 9).bitwiseAND(3).alias("receptor"), F.shiftright(at(h), 5).bitwiseAND(15).alias("region"), F.transform(own(h), lambda w: three(w, 3)).alias("directions"), F.transform(own(h), lambda w: three(w, 0)).alias("pressures"))
    return F.when(F.size(words) > 0, F.transform(heads, stroke))


def _control(tag: int, low: Column) -> Column:
    return W.extension(bits((W.TOUCH, 0), (tag, 8), (low, 0)), 2)


def frame_start(contacts: Column, frame: Column) -> Column:
    return _control(1, bits((contacts, 4), (frame, 0)))


def time_delta(ms: Column) -> Column:
    """Two words of a 12-bit delta."""
    return F.array(_control(3, F.shiftright(ms.cast("int"), 6).bitwiseAND(63)), _control(4, ms.cast("int").bitwiseAND(63)))


def time_delta_back(words: Column) -> Column:
    return bits((F.get(words, F.lit(0)).bitwiseAND(63), 6), (F.get(words, F.lit(1)).bitwiseAND(63), 0))


def timed_frame(frame: Column, contacts: Column) -> Column:
    """A frame of contacts: struct(delta_ms, receptor, region, directions, pressures)."""
    each = F.transform(contacts, lambda c: F.concat(time_delta(c["delta_ms"]), touch_words(c["receptor"], c["region"], c["directions"], c["pressures"])))
    return F.concat(F.array(frame_start(F.size(contacts), frame)), F.flatten(each))


def layer_word(level: Column | int, value: Column) -> Column:
    lv = F.lit(level) if isinstance(level, int) else level
    return _control(5, bits((lv, 6), (value, 0)))


def vibration_words(region: Column, band: Column, amplitude: Column, envelope: Column) -> Column:
    nibble = lambda c: c.cast("int").bitwiseAND(15)
    half = lambda tag, a, b: W.extension(bits((W.TOUCH, 0), (tag, 8), (nibble(a), 4), (nibble(b), 0)), 3)
    return F.array(half(2, band, amplitude), half(3, envelope, region))


def joint_quantum(angle: Column) -> Column:
    return F.when(angle.between(0, 180), rounded(angle / 180.0 * 255.0)).otherwise(F.raise_error(F.lit("angle out of range")).cast("int"))


def joint_angle(quantum: Column) -> Column:
    return quantum / 255.0 * 180.0


def joint_words(joint: Column, angle: Column, tension: Column) -> Column:
    """Three words of the deepest layer: joint, high six bits, low two with the tension."""
    q = joint_quantum(angle)
    return F.array(layer_word(3, joint), layer_word(3, F.shiftright(q, 2)), layer_word(3, bits((q.bitwiseAND(3), 4), (tension, 0))))


# fixed values: coordinates (across, down, depth) and names of the body regions
REGIONS = {
    "THUMB_TIP": (2, 1, 0), "INDEX_TIP": (3, 1, 0), "MIDDLE_TIP": (4, 1, 0), "RING_TIP": (5, 1, 0), "PINKY_TIP": (6, 1, 0), "PALM_THENAR": (3, 2, 1), "PALM_HYPOTHENAR": (6, 2, 1), "PALM_CENTER": (4, 2, 1),
    "DORSAL_HAND": (4, 3, 1), "WRIST_FOREARM": (4, 4, 2), "LIPS": (4, 0, 0), "TONGUE": (4, 0, 1), "FACE": (4, 0, 2), "TORSO": (4, 5, 2), "ARM_LEG": (4, 6, 2), "FOOT_SOLE": (4, 7, 1),
}


# --- mental


def mental_words(form: Column, symmetry: Column, frequency: Column, speed: Column, modulus: Column, x: Column, y: Column, directions: Column, frame: Column, delta: Column, rle: bool = True) -> Column:
    """Control words and run-length draw words of one stroke; ``modulus`` is 8 or 12, a null frame has no word."""
    control = lambda v, p: W.word(W.RESERVED, v, bits((W.MENTAL, 0), (p, 0)))
    head = bits((form, 10), (F.shiftright(symmetry, 1).bitwiseAND(1), 9), (symmetry.bitwiseAND(1), 7), (frequency, 4), (speed, 2), (F.when(modulus == 12, 2).otherwise(0), 0))
    runs = direction_runs(directions, F.when(modulus == 12, 16).otherwise(32)) if rle else F.transform(directions, lambda d: F.struct(d.alias("dir"), F.lit(1).alias("n")))
    drawn = lambda r: W.extension(bits((W.MENTAL, 0), (F.when(modulus == 12, F.shiftleft(r["dir"], 4)).otherwise(F.shiftleft(r["dir"], 5)), 0), (r["n"] - 1, 0)), 1 if rle else 0)
    lead = F.array(control(0, head), control(1, x), control(2, y), control(3, F.size(runs)))
    framed = F.when(frame.isNotNull(), F.array(control(3, bits((0x800, 0), (frame.cast("int").bitwiseAND(255), 0))))).otherwise(none())
    return F.concat(lead, framed, F.array(control(3, bits((0x200, 0), (delta.cast("int").bitwiseAND(255), 0)))), F.transform(runs, drawn))


def mental_strokes(words: Column) -> Column:
    """Strokes of a block: four control words in order start one, a frame word and a delta word may follow, then as many draw words as announced; anything else is passed over."""
    at = lambda i: F.get(words, i)
    low = lambda i: W.payload(at(i), 12)
    control = lambda i, v: F.coalesce((W.mode(at(i)) == W.RESERVED) & (W.version(at(i)) == v) & W.has(at(i), W.MENTAL), F.lit(False))
    heads = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: control(i, 0) & control(i + 1, 1) & control(i + 2, 2) & control(i + 3, 3))
    framed = lambda i: control(i + 4, 3) & (low(i + 4).bitwiseAND(0x800) != 0)
    delta_at = lambda i: i + 4 + framed(i).cast("int")
    timed = lambda i: control(delta_at(i), 3) & (low(delta_at(i)).bitwiseAND(0x200) != 0)
    first = lambda i: delta_at(i) + timed(i).cast("int")
    byte = lambda c: c.bitwiseAND(0xFF)
    drawn = lambda i: F.filter(F.slice(words, first(i) + 1, byte(low(i + 3))), lambda w: (W.mode(w) == W.EXTENSION) & W.has(w, W.MENTAL))
    wide = lambda i: low(i).bitwiseAND(2) != 0
    run = lambda i, w: F.array_repeat(F.when(wide(i), F.shiftright(w, 4).bitwiseAND(15)).otherwise(F.shiftright(w, 5).bitwiseAND(7)), F.when(W.version(w) == 1, F.when(wide(i), w.bitwiseAND(15)).otherwise(w.bitwiseAND(31)) + 1).otherwise(1))
    sym = lambda i: F.shiftleft(F.shiftright(low(i), 9).bitwiseAND(1), 1).bitwiseOR(F.shiftright(low(i), 7).bitwiseAND(1))
    stroke = lambda i: F.struct(
        F.shiftright(low(i), 10).bitwiseAND(3).alias("form"), sym(i).alias("symmetry"), F.shiftright(low(i), 4).bitwiseAND(7).alias("frequency"), F.shiftright(low(i), 2).bitwiseAND(3).alias("speed"),
        byte(low(i + 1)).alias("x"), byte(low(i + 2)).alias("y"), F.when(framed(i), byte(low(i + 4))).alias("frame"), F.when(timed(i), byte(low(delta_at(i)))).alias("delta"), F.flatten(F.transform(drawn(i), lambda w: run(i, w))).alias("directions"),
    )
    return F.when(F.size(words) > 0, F.transform(heads, stroke))


def direction_runs(directions: Column, most: Column | int) -> Column:
    """struct(dir, n) of equal neighbours, longer runs cut at ``most``."""
    m = F.lit(most) if isinstance(most, int) else most
    empty = F.expr("cast(array() as array<struct<dir:int,n:int>>)")
    last = lambda a: F.element_at(a, -1)
    new = lambda d: F.array(F.struct(d.cast("int").alias("dir"), F.lit(1).alias("n")))
    grown = lambda a: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["dir"].alias("dir"), (last(a)["n"] + 1).alias("n"))))
    step = lambda a, d: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["dir"] == d) & (F.try_element_at(a, F.lit(-1))["n"] < m), grown(a)).otherwise(F.concat(a, new(d)))
    return F.aggregate(directions, empty, step)


def runs_back(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["dir"], r["n"])))


# --- diagram


def segment_steps(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Directions from one point to another: diagonal until one axis is done, then straight."""
    dx, dy = (x1 - x0).cast("int"), (y1 - y0).cast("int")
    n = F.greatest(F.abs(dx), F.abs(dy))
    unit = lambda d, k: F.when(k <= F.abs(d), F.signum(d).cast("int")).otherwise(0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: direction_of(unit(dx, k), unit(dy, k)))).otherwise(none())


def _visual(subtype: int, data: Column | int) -> Column:
    return W.extension(bits((W.DIAGRAM, 0), (subtype, 10), (data, 0)))


def diagram_words(points: Column, style: Column | None = None) -> Column:
    """Words of one path of integer points; ``style``: struct(width, colour, dash) or null for none."""
    at = lambda i: F.element_at(points, i)
    pairs = F.when(F.size(points) > 1, F.sequence(F.lit(1), F.size(points) - 1)).otherwise(none())
    steps = F.flatten(F.transform(pairs, lambda i: segment_steps(at(i)["x"], at(i)["y"], at(i + 1)["x"], at(i + 1)["y"])))
    runs = F.transform(direction_runs(steps, 127), lambda r: _visual(2, bits((r["dir"], 7), (r["n"], 0))))
    body = F.concat(F.array(_visual(3, 1), _visual(0, at(F.lit(1))["x"]), _visual(1, at(F.lit(1))["y"])), runs)
    if style is None:
        return F.concat(body, F.array(_visual(3, 0)))
    told = F.array(_visual(3, 2), _visual(0, style["width"]), _visual(1, style["colour"]), _visual(2, bits((style["dash"], 7), (1, 0))))
    return F.concat(body, F.when(style.isNotNull(), told).otherwise(F.array(_visual(3, 0))))


def diagram_points(words: Column) -> Column:
    """The corner-by-corner points of one path's words: each run ends in a point."""
    state = F.expr("named_struct('x', 0, 'y', 0, 'pts', cast(array() as array<struct<x:int,y:int>>))")
    sub = lambda w: F.shiftright(w, 10).bitwiseAND(3)
    data = lambda w: w.bitwiseAND(1023)
    moved = lambda s, w: F.struct((s["x"] + step_of(F.shiftright(data(w), 7))["dx"] * data(w).bitwiseAND(127)).alias("x"), (s["y"] + step_of(F.shiftright(data(w), 7))["dy"] * data(w).bitwiseAND(127)).alias("y"))
    point = lambda s, x, y: F.concat(s["pts"], F.array(F.struct(x.alias("x"), y.alias("y"))))
    keep = lambda x, y, p: F.struct(x.alias("x"), y.alias("y"), p.alias("pts"))
    step = lambda s, w: F.when(sub(w) == 0, keep(data(w), s["y"], s["pts"])).when(sub(w) == 1, keep(s["x"], data(w), point(s, s["x"], data(w)))).when(sub(w) == 2, keep(moved(s, w)["x"], moved(s, w)["y"], point(s, moved(s, w)["x"], moved(s, w)["y"]))).otherwise(s)
    # what follows the end boundary is style
    end = F.coalesce(F.get(F.filter(F.transform(words, lambda w, i: F.when((sub(w) == 3) & (w.bitwiseAND(1) == 0), i).otherwise(-1)), lambda i: i >= 0), F.lit(0)), F.size(words))
    return F.aggregate(F.slice(words, 1, end), state, step, lambda s: s["pts"])


# --- music and voice


def _sound(bit: int, subtype: int, data: Column | int) -> Column:
    return W.extension(bits((bit, 0), (subtype, 10), (data, 0)))


def sound_stroke(bit: int, x: Column, y: Column, directions: Column, controls: list[tuple[int, Column, int]] = (), anchor: Column | None = None) -> Column:
    """One stroke of music or voice: controls that are not null, begin, move, a word for each step, end. ``controls``: tag, value, largest value."""
    out = []
    offset = F.lit(0)
    if anchor is not None:
        a = clamped(anchor, 0, 127)
        offset = F.coalesce(a, F.lit(0))
        out.append(F.when(anchor.isNotNull(), F.array(_sound(bit, 1, a))).otherwise(none()))
    for tag, value, most in controls:
        out.append(F.when(value.isNotNull(), F.array(_sound(bit, 1, bits((tag, 7), (clamped(value, 0, most), 0))))).otherwise(none()))
    at = (x - offset).cast("int")
    fits = at.between(0, 1023) & y.between(0, 1023)
    move = F.when(fits, F.array(_sound(bit, 0, 1), _sound(bit, 1, at), _sound(bit, 2, y))).otherwise(F.raise_error(F.lit("move out of range")).cast("array<int>"))
    return F.concat(*out, move, F.transform(directions, lambda d: _sound(bit, 3, bits((d, 7), (1, 0)))), F.array(_sound(bit, 0, 0)))


def _meta(bit: int, kind: int, value: Column) -> Column:
    return _sound(bit, 0, bits((1, 9), (kind, 7), (clamped(value, 0, 127), 0)))


def music_meta(numerator: Column, denominator: Column, key: Column, tempo: Column) -> Column:
    """Words of those that are not null; a denominator of 8 counts as 7."""
    one = lambda c, w: F.when(c.isNotNull(), F.array(w)).otherwise(none())
    return F.concat(one(numerator, _meta(W.MUSIC, 0, bits((clamped(numerator, 0, 15), 3), (clamped(denominator, 0, 7), 0)))), one(key, _meta(W.MUSIC, 1, key + 64)), one(tempo, _meta(W.MUSIC, 2, F.rint(tempo))))


def voice_meta(step_seconds: Column, levels: Column) -> Column:
    """Language (English), milliseconds of a step and pitch levels: always three words."""
    return F.array(_meta(W.VOICE, 0, F.lit(1)), _meta(W.VOICE, 1, F.rint(step_seconds * 1000.0)), _meta(W.VOICE, 2, levels))


def sound_strokes(bit: int, words: Column) -> Column:
    """Moves of a block with the number of steps after each: struct(x, y, steps). A time word is a coordinate only before a pitch word."""
    at = lambda i: F.get(words, i)
    sub = lambda i: F.shiftright(at(i), 10).bitwiseAND(3)
    is_move = lambda i: (sub(i) == 1) & F.coalesce(sub(i + 1) == 2, F.lit(False))
    index = F.sequence(F.lit(0), F.size(words) - 1)
    moves = F.filter(index, is_move)
    sub_of = lambda w: F.shiftright(w, 10).bitwiseAND(3)
    # steps are the draw words up to the first word that is none
    count = lambda s, w: F.struct((s["n"] + (s["open"] & (sub_of(w) == 3)).cast("int")).alias("n"), (s["open"] & (sub_of(w) == 3)).alias("open"))
    drawn = lambda m: F.aggregate(F.slice(words, m + 3, F.greatest(F.size(words) - m - 2, F.lit(0))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), count, lambda s: s["n"])
    anchor_of = lambda m: F.coalesce(F.get(F.reverse(F.filter(index, lambda k: (k < m) & (k >= m - 7) & (sub(k) == 1) & ~is_move(k) & (F.shiftright(at(k), 7).bitwiseAND(7) == 0))), F.lit(0)), F.lit(-1))
    begin = lambda m: F.coalesce(F.get(F.reverse(F.filter(index, lambda k: (k < m) & (sub(k) == 0) & (at(k).bitwiseAND(1023) == 0))), F.lit(0)), F.lit(-1))
    base = lambda m: F.when(anchor_of(m) > begin(m), at(anchor_of(m)).bitwiseAND(127)).otherwise(0)
    stroke = lambda m: F.struct((at(m).bitwiseAND(1023) + base(m)).alias("x"), at(m + 1).bitwiseAND(1023).alias("y"), drawn(m).alias("steps"))
    return F.when(F.size(words) > 0, F.transform(moves, stroke))


# --- temporal events


def temporal_words(events: Column, quantum: int = 50) -> Column:
    """Words of events sorted by start: struct(start_ms, channel, pitch, program, velocity, duration_ms).

    A clock counts quanta; a program is said when it is not the channel's last. An overshooting clock raises.
    """
    kind = lambda k, data: W.extension(bits((W.MUSIC, 0), (k, 12), (data, 0)))
    chunks = lambda n, most: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / most).cast("int"), F.lit(1)) - 1), lambda i: F.least(F.lit(most), n - i * most))
    state = F.expr(f"named_struct('ms', 0L, 'programs', array_repeat(-1, 16), 'words', {NONE})")

    def step(s: Column, e: Column) -> Column:
        channel, program, pitch = clamped(e["channel"], 0, 15), clamped(e["program"], 0, 127), clamped(e["pitch"], 0, 127)
        late = e["start_ms"] < s["ms"]
        frames = F.rint((e["start_ms"] - s["ms"]) / quantum).cast("int")
        wait = F.when(frames > 0, F.transform(chunks(frames, 4095), lambda c: kind(2, c))).otherwise(none())
        said = F.when(F.get(s["programs"], channel) != program, F.array(kind(3, bits((channel, 7), (program, 0))))).otherwise(none())
        lasting = F.greatest(F.lit(1), F.rint(F.greatest(F.lit(0), e["duration_ms"]) / quantum).cast("int"))
        held = F.transform(chunks(lasting, 31), lambda c: kind(1, bits((c, 7), (clamped(e["velocity"], 0, 127), 0))))
        words = F.concat(s["words"], wait, said, F.array(kind(0, bits((channel, 7), (pitch, 0)))), held)
        programs = F.transform(s["programs"], lambda p, i: F.when(i == channel, program).otherwise(p))
        new = F.struct((s["ms"] + F.greatest(frames, F.lit(0)).cast("long") * quantum).alias("ms"), programs.alias("programs"), words.alias("words"))
        return F.when(late, F.raise_error(F.lit("events must be sorted by start time")).cast("struct<ms:bigint,programs:array<int>,words:array<int>>")).otherwise(new)

    return F.aggregate(F.array_sort(events), state, step, lambda s: s["words"])


def temporal_events(words: Column, quantum: int = 50) -> Column:
    """Events of temporal words: struct(start_ms, channel, pitch, program, velocity, duration_ms)."""
    empty = "cast(array() as array<struct<start_ms:bigint,channel:int,pitch:int,program:int,velocity:int,duration_ms:int>>)"
    state = F.expr(f"named_struct('ms', 0L, 'programs', array_repeat(0, 16), 'out', {empty}, 'open', false)")
    kind = lambda w: F.shiftright(w, 12).bitwiseAND(3)
    high = lambda w: F.shiftright(w, 7).bitwiseAND(31)
    low = lambda w: w.bitwiseAND(127)

    def step(s: Column, w: Column) -> Column:
        keep = lambda **k: F.struct(*[k.get(n, s[n]).alias(n) for n in ("ms", "programs", "out", "open")])
        channel = high(w).bitwiseAND(15)
        note = F.struct(s["ms"].alias("start_ms"), channel.alias("channel"), low(w).alias("pitch"), F.get(s["programs"], channel).alias("program"), F.lit(64).alias("velocity"), F.lit(0).alias("duration_ms"))
        last = F.try_element_at(s["out"], F.lit(-1))
        longer = F.struct(*[last[n].alias(n) for n in ("start_ms", "channel", "pitch", "program")], low(w).alias("velocity"), (last["duration_ms"] + F.greatest(F.lit(1), high(w)) * quantum).alias("duration_ms"))
        more = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(longer))
        return (
            F.when(kind(w) == 2, keep(ms=s["ms"] + w.bitwiseAND(4095).cast("long") * quantum, open=F.lit(False)))
            .when(kind(w) == 3, keep(programs=F.transform(s["programs"], lambda p, i: F.when(i == channel, low(w)).otherwise(p)), open=F.lit(False)))
            .when(kind(w) == 0, keep(out=F.concat(s["out"], F.array(note)), open=F.lit(True)))
            .otherwise(keep(out=F.when(s["open"], more).otherwise(s["out"])))
        )

    fixed = lambda e: F.struct(*[e[n].alias(n) for n in ("start_ms", "channel", "pitch", "program", "velocity")], F.greatest(e["duration_ms"], F.lit(quantum)).alias("duration_ms"))
    return F.aggregate(words, state, step, lambda s: F.transform(s["out"], fixed))
