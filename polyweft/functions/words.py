"""The 20-bit word: fields, construction, predicates and the modality of a single word, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_MAX = (1 << 20) - 1
NORMAL, ESCAPE, EXTENSION, RESERVED = 0, 1, 2, 3

# fixed values: type bits of the modalities
DIAGRAM, MUSIC, VOICE, BPE, TOUCH, TASTE, SMELL, MENTAL = 0x8000, 0x4000, 0x2000, 0x1000, 0x0800, 0x0400, 0x0200, 0x0100
IMAGE_FAMILY, IMAGE_ENHANCED, IMAGE_LEGACY = 0x0C00, 0x0400, 0x0800
LABELS = ("text", "diagram", "music", "voice", "image", "bpe", "mental", "touch", "smell", "taste")

Words = Column | str


def _col(w: Words) -> Column:
    return F.col(w) if isinstance(w, str) else w


def mode(w: Words) -> Column:
    return F.shiftright(_col(w), 18).bitwiseAND(3)


def version(w: Words) -> Column:
    return F.shiftright(_col(w), 16).bitwiseAND(3)


def payload(w: Words, bits: int = 16) -> Column:
    return _col(w).bitwiseAND((1 << bits) - 1)


def has(w: Words, bit: int) -> Column:
    return _col(w).bitwiseAND(bit) != 0


def word(mode_: int | Column, version_: int | Column, payload_: int | Column) -> Column:
    as_int = lambda v: F.lit(v) if isinstance(v, int) else v.cast("int")
    return F.shiftleft(as_int(mode_), 18).bitwiseOR(F.shiftleft(as_int(version_), 16)).bitwiseOR(as_int(payload_))


def extension(payload_: int | Column, version_: int | Column = 0) -> Column:
    return word(EXTENSION, version_, payload_)


def in_range(w: Words) -> Column:
    return _col(w).between(0, WORD_MAX)


def is_image_payload(w: Words) -> Column:
    """Payloads that the classifier calls image."""
    return _col(w).bitwiseAND(IMAGE_FAMILY) == IMAGE_ENHANCED


def is_image_family(w: Words, family: int) -> Column:
    """Words of one image profile: extension, version 0 and the family's marker."""
    return (mode(w) == EXTENSION) & (version(w) == 0) & (_col(w).bitwiseAND(IMAGE_FAMILY) == family)


def is_visual(w: Words) -> Column:
    return (mode(w) == EXTENSION) & has(w, DIAGRAM)


def is_diagram_header(w: Words) -> Column:
    """A start boundary outside the image profile; since a boundary's own subtype sets the profile bit, no word is one."""
    return is_visual(w) & (F.shiftright(_col(w), 10).bitwiseAND(3) == 3) & has(w, 1) & ~has(w, 0x0800)


def is_music_range(w: Words) -> Column:
    """The reserved range of musical macros."""
    return _col(w).between(0x30000, 0x3FFFF)


def music_macro(n: Words) -> Column:
    """A macro's word; numbers outside the range raise."""
    n = _col(n)
    return F.when(n.between(0, 0xFFFF), n + 0x30000).otherwise(F.raise_error(F.lit("music macro out of range")).cast("int"))


def is_taste_bit(w: Words) -> Column:
    return (mode(w) == EXTENSION) & has(w, TASTE)


def modality(w: Words) -> Column:
    """The modality of one word by itself; taste is a matter of three words and is never given here."""
    ext = mode(w) == EXTENSION
    sense = lambda bit: has(w, bit) & ~is_image_payload(w)
    return (
        F.when((mode(w) == RESERVED) & has(w, MENTAL), "mental")
        .when(~ext, "text")
        .when(has(w, MUSIC), "music")
        .when(has(w, VOICE), "voice")
        .when(has(w, DIAGRAM), "diagram")
        .when(has(w, BPE), "bpe")
        .when(sense(TOUCH), "touch")
        .when(sense(SMELL), "smell")
        .when(sense(MENTAL), "mental")
        .when(is_image_payload(w), "image")
        .otherwise("text")
    )


def unit_word(strokes: Column, style: Column, mode_: int = NORMAL, version_: int = 0) -> Column:
    """Six 2-bit stroke states, first highest, and four style bits."""
    bits = F.aggregate(strokes, F.lit(0), lambda a, s: F.shiftleft(a, 2).bitwiseOR(s.cast("int").bitwiseAND(3)))
    return word(mode_, version_, F.shiftleft(bits, 4).bitwiseOR(style.cast("int").bitwiseAND(15)))


def bpe_word(token: Words) -> Column:
    """A 12-bit token as a word; larger ones raise."""
    t = _col(token).cast("int")
    return F.when(t.between(0, 0xFFF), extension(t.bitwiseOR(BPE))).otherwise(F.raise_error(F.lit("token out of range")).cast("int"))


def transport_bytes(words: Column) -> Column:
    """Valid words as 4-byte big-endian unsigned integers."""
    kept = F.filter(words, in_range)
    return F.unhex(F.array_join(F.transform(kept, lambda w: F.lpad(F.hex(w.cast("long")), 8, "0")), ""))


def from_transport_bytes(content: Column) -> Column:
    """Words of a big-endian file; a rest of less than four bytes is ignored, words out of range are dropped."""
    n = F.floor(F.octet_length(content) / 4).cast("int")
    read = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substr(content, 1 + 4 * i, F.lit(4))), 16, 10).cast("long"))
    return F.when(n > 0, F.transform(F.filter(read, in_range), lambda w: w.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def json_text(words: Column) -> Column:
    """Valid words as a JSON array, a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.filter(words, in_range), lambda w: w.cast("string")), ", "), F.lit("]"))


def digest(words: Column) -> Column:
    """SHA-256 of the compact JSON of the words."""
    return F.sha2(F.to_json(words), 256)
