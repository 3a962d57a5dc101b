"""Row-local parsing and classification functions of the modalities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: keywords of the form classes, in the order of the classes
FORMS = {
    "TUNNEL": ("tunnel", "funnel", "concentric", "radial", "rays", "converging"),
    "SPIRAL": ("spiral", "helical", "rotating", "coil", "vortex", "swirl"),
    "LATTICE": ("lattice", "checkerboard", "grid", "honeycomb", "hexagon", "hexagonal", "zigzag", "fortification", "tiling"),
    "COBWEB": ("cobweb", "filigree", "branch", "branching", "tree", "spiderweb", "web"),
}
FORM_CODES = {name: i for i, name in enumerate(FORMS)}
# fixed values: rotation steps of the symmetry groups D1, D2, D4, D6 on 8 and on 12 directions
ROTATIONS = {
    8: {"D1": (0,), "D2": (0, 4), "D4": (0, 2, 4, 6), "D6": (0, 1, 3, 4, 5, 7)},
    12: {"D1": (0,), "D2": (0, 6), "D4": (0, 3, 6, 9), "D6": (0, 2, 4, 6, 8, 10)},
}
# fixed values: base directions of the form classes on 8 and on 12 directions; a spiral counts on
BASES = {
    8: {"TUNNEL": (0, 0, 4, 4, 0, 0, 4, 4), "LATTICE": (0, 0, 2, 2, 4, 4, 6, 6), "COBWEB": (0, 1, 0, 3, 4, 3, 6, 7)},
    12: {"TUNNEL": (0, 0, 6, 6, 0, 0, 6, 6), "LATTICE": (0, 2, 4, 6, 8, 10, 0, 6), "COBWEB": (0, 1, 11, 2, 6, 7, 5, 9)},
}
# fixed values: phoneme classes
PHONEMES = {
    "vowel": ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW"),
    "stop": ("P", "B", "T", "D", "K", "G"),
    "affricate": ("CH", "JH"),
    "fricative": ("S", "Z", "SH", "ZH", "F", "V", "TH", "DH", "HH"),
    "nasal": ("M", "N", "NG"),
    "liquid": ("L", "R"),
    "glide": ("W", "Y"),
    "silence": ("SIL", "SP", "PAU"),
}
# fixed values: letters to phonemes
LETTERS = {"a": "AH", "b": "B", "c": "K", "d": "D", "e": "EH", "f": "F", "g": "G", "h": "HH", "i": "IH", "j": "JH", "k": "K", "l": "L", "m": "M", "n": "N", "o": "OW", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "u": "UH", "v": "V", "w": "W", "x": "K", "y": "Y", "z": "Z"}
# fixed values: IPA signs to phonemes, and the pairs looked for inside a longer sign
IPA = {
    "p": "P", "b": "B", "t": "T", "d": "D", "k": "K", "g": "G", "ɡ": "G", "m": "M", "n": "N", "ŋ": "NG", "f": "F", "v": "V", "θ": "TH", "ð": "DH", "s": "S", "z": "Z", "ʃ": "SH", "ʒ": "ZH", "h": "HH",
    "ɹ": "R", "r": "R", "l": "L", "ɫ": "L", "j": "Y", "w": "W", "tʃ": "CH", "dʒ": "JH", "i": "IY", "iː": "IY", "ɪ": "IH", "e": "EH", "eɪ": "EY", "ɛ": "EH", "æ": "AE", "ə": "AH", "ɚ": "ER", "ɝ": "ER",
    "ɜ": "ER", "ʌ": "AH", "ɑ": "AA", "ɑː": "AA", "ɒ": "AA", "ɔ": "AO", "ɔː": "AO", "o": "OW", "oʊ": "OW", "ʊ": "UH", "u": "UW", "uː": "UW", "aɪ": "AY", "aʊ": "AW", "ɔɪ": "OY",
}
IPA_PAIRS = ("dʒ", "tʃ", "aɪ", "aʊ", "ɔɪ", "oʊ", "eɪ")
# fixed values: the palette and dashes of drawn paths
COLOURS = ("#000000", "#ffffff", "#ff0000", "#00ff00", "#0000ff", "#ffff00", "#00ffff", "#ff00ff")
DASHES = ("solid", "dash", "dot", "dashdot")
# fixed values: patterns drawn after a phoneme of each class
PATTERNS = {"vowel": (0,), "stop": (0, 6), "affricate": (0, 1), "fricative": (0, 1), "nasal": (0, 7), "liquid": (0, 4), "glide": (0, 4), "silence": (), "other": (0,)}


def ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<int>)")


def squeezed(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def form_class(text: Column) -> Column:
    """struct(form, score): the class with most of its keywords contained; the first of equals, the last class if none is."""
    t = squeezed(text)
    scores = [sum((F.contains(t, F.lit(k)).cast("int") for k in kws[1:]), F.contains(t, F.lit(kws[0])).cast("int")) for kws in FORMS.values()]
    best = F.greatest(*scores)
    chain = F.when(best == 0, "COBWEB")
    for name, s in zip(FORMS, scores):
        chain = chain.when(s == best, name)
    return F.struct(chain.alias("form"), best.alias("score"))


def symmetry(text: Column, form: Column) -> Column:
    t = squeezed(text)
    six = F.lit(False)
    for k in ("hexagon", "honeycomb", "tiling"):
        six = six | F.contains(t, F.lit(k))
    return F.when(six, "D6").when(form == "LATTICE", "D2").otherwise("D4")


def directions_of(symmetry_: Column) -> Column:
    """12 directions for the sixfold group, else 8."""
    return F.when(symmetry_ == "D6", 12).otherwise(8)


def chirality(text: Column) -> Column:
    t = squeezed(text)
    return F.when(F.contains(t, F.lit("counter-clockwise")) | F.contains(t, F.lit("ccw")), -1).otherwise(1)


def base_directions(form: Column, modulus: Column, turn: Column) -> Column:
    spiral = F.transform(F.sequence(F.lit(0), modulus - 1), lambda i: F.pmod(i * turn, modulus))
    chain = F.when(form == "SPIRAL", spiral)
    for m, forms in BASES.items():
        for name, dirs in forms.items():
            chain = chain.when((modulus == m) & (form == name), ints(dirs))
    return chain


def rotated(directions: Column, symmetry_: Column, modulus: Column) -> Column:
    """The directions turned by each step of a symmetry group."""
    steps = F.when(F.lit(False), ints(()))
    for m, groups in ROTATIONS.items():
        for name, s in groups.items():
            steps = steps.when((modulus == m) & (symmetry_ == name), ints(s))
    return F.transform(steps, lambda s: F.transform(directions, lambda d: F.pmod(d + s, modulus)))


def is_symmetric(directions: Column, symmetry_: Column, modulus: Column) -> Column:
    """Whether equal blocks of the directions are the turns of the first one."""
    copies = F.size(rotated(ints((0,)), symmetry_, modulus))
    n = F.size(directions)
    size = F.floor(n / copies).cast("int")
    first = F.slice(directions, 1, F.greatest(size, F.lit(0)))
    fits = F.flatten(rotated(first, symmetry_, modulus)) == directions
    return F.forall(directions, lambda d: (d >= 0) & (d < modulus)) & ((copies == 1) | ((n > 0) & (n % copies == 0) & fits))


def phoneme_class(symbol: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for name, members in PHONEMES.items():
        chain = chain.when(symbol.isin(*members), name)
    return chain.otherwise("other")


def letters_to_phonemes(text: Column) -> Column:
    """A phoneme for each of the letters a to z; texts without any have one neutral vowel."""
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    found = F.filter(F.transform(F.split(F.lower(text), ""), lambda c: F.try_element_at(table, c)), lambda p: p.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("AH")))


def ipa_to_phoneme(sign: Column) -> Column:
    """A phoneme for an IPA sign: as it is, by a pair inside it, by its first known character, else a neutral vowel."""
    token = F.translate(F.lower(F.trim(sign)), "ˈˌ͡", "")
    table = F.create_map(*[F.lit(x) for pair in IPA.items() for x in pair])
    single = F.create_map(*[F.lit(x) for pair in ({k: v for k, v in LETTERS.items()} | {k: v for k, v in IPA.items() if len(k) == 1}).items() for x in pair])
    pair = F.coalesce(*[F.when(F.contains(token, F.lit(p)), IPA[p]) for p in IPA_PAIRS])
    first = F.get(F.filter(F.transform(F.split(token, ""), lambda c: F.try_element_at(single, c)), lambda p: p.isNotNull()), F.lit(0))
    return F.when(F.trim(sign).isin("", "|"), "SP").otherwise(F.coalesce(F.try_element_at(table, token), pair, first, F.lit("AH")))


def phoneme_token(raw: Column) -> Column:
    """struct(symbol, stress) of a raw token: letters and stress digits, upper case; nulls for nothing."""
    clean = F.upper(F.regexp_replace(F.trim(raw), "[^A-Za-z0-2]", ""))
    return F.when(clean != "", F.struct(F.regexp_replace(clean, "[0-2]$", "").alias("symbol"), clean.rlike("[12]$").alias("stress")))


def colour_index(colour: Column) -> Column:
    """Place in the palette; short hex forms are doubled, unknown ones are black."""
    c = F.lower(F.trim(colour))
    long = F.when(c.rlike("^#...$"), F.regexp_replace(c, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")).otherwise(c)
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in COLOURS]), long).cast("int"), F.lit(0)) - 1, F.lit(0))


def style_code(stroke: Column, width: Column, dash: Column) -> Column:
    """struct(width, colour, dash) of a path with any style, else null; widths round half to even into 1 to 10."""
    any_ = stroke.isNotNull() | width.isNotNull() | dash.isNotNull()
    w = F.least(F.greatest(F.rint(F.coalesce(width, F.lit(1.0))).cast("int"), F.lit(1)), F.lit(10))
    d = F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in DASHES]), F.lower(F.trim(dash))).cast("int"), F.lit(0)) - 1, F.lit(0))
    return F.when(any_, F.struct(w.alias("width"), F.coalesce(colour_index(stroke), F.lit(0)).alias("colour"), d.alias("dash")))


def style_of(width: Column, colour: Column, dash: Column) -> Column:
    """A style from its codes, out-of-range ones at the nearest end."""
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), F.least(F.greatest(i, F.lit(0)), F.lit(len(xs) - 1)) + 1)
    return F.struct(F.least(F.greatest(width, F.lit(1)), F.lit(10)).cast("double").alias("stroke_width"), pick(COLOURS, colour).alias("stroke"), pick(DASHES, dash).alias("dash"))


def category_code(value: Column, names: tuple[str, ...]) -> Column:
    """A category by name or number; signs between words count as underscores."""
    name = F.translate(F.upper(F.trim(value)), "-/ ", "___")
    number = value.try_cast("int")
    return F.coalesce(F.when(number.between(0, len(names) - 1), number), F.when(F.array_position(F.array(*[F.lit(n) for n in names]), name) > 0, F.array_position(F.array(*[F.lit(n) for n in names]), name).cast("int") - 1))


def chirality_code(value: Column) -> Column:
    """1 for L, R, +, LEFT and 1, else 0."""
    return F.upper(F.trim(value)).isin("L", "R", "+", "LEFT", "1").cast("int")
