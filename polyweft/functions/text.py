"""Text to words and back, as column expressions.

Encoding decomposes canonically; a printable ASCII character, a tab, a line break and six letters without a
decomposition are words of their own, and each longest run of anything else is its UTF-8 bytes, two to an escape
word. Decoding turns runs of escape words back into text and composes. Words are made and read by built-in
expressions; the normal forms alone, which no built-in has, come from an Arrow function, and only for texts that are
not all ASCII.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from polyweft.functions import words as W

# fixed values: characters that are words by themselves; the precomposed letters can only come in when decoding
_OWN_LETTERS = "ßøØæÆœŒ"
MAPPED = r"\x20-\x7E\t\n\r" + _OWN_LETTERS
DECODED_ONLY = "áéíóúàèìòùâêîôûäëïöüñçÁÉÍÓÚÑÇ"


@functools.cache
def _normal(form: str):
    """A normal form of any text, through Arrow; made when first asked for, as it needs a session."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.pandas_udf(run, "string")


def _as(form: str, text: Column) -> Column:
    return F.coalesce(_normal(form)(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)), text)


def nfd(text: Column) -> Column:
    """Canonical decomposition. Text that is all ASCII is its own and stays in the JVM."""
    return _as("NFD", text)


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return _as("NFC", text)


def _pairs(run: Column) -> Column:
    """Escape words of a run's UTF-8 bytes; a last odd byte is paired with zero."""
    code = F.hex(F.encode(run, "UTF-8"))
    count = F.ceil(F.octet_length(run) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.rpad(F.substr(code, 1 + 4 * i, F.lit(4)), 4, "0"), 16, 10).cast("int") + (W.ESCAPE << 18))


def encode(text: Column) -> Column:
    """The words of a text of any alphabet, in one projection without a shuffle: runs with and without words of their own in turn."""
    return encode_normal(nfd(text))


def encode_normal(text: Column) -> Column:
    """The words of a text that is decomposed already."""
    runs = F.regexp_extract_all(text, F.lit(f"([{MAPPED}]+|[^{MAPPED}]+)"))
    return F.flatten(F.transform(runs, lambda u: F.when(u.rlike(f"^[{MAPPED}]"), F.transform(F.split(u, ""), lambda c: F.ascii(c))).otherwise(_pairs(u))))


def encode_escape_only(text: Column) -> Column:
    """The variant in which all bytes are escape words."""
    # the filter leaves an empty text without words; the array gives the decomposed text a name inside the lambda
    return F.when(text.isNotNull(), F.flatten(F.transform(F.filter(F.array(nfd(text)), lambda u: u != ""), _pairs)))


def _is_own(w: Column) -> Column:
    allowed = [9, 10, 13, *range(0x20, 0x7F), *sorted({ord(c) for c in _OWN_LETTERS + DECODED_ONLY})]
    return (W.mode(w) == W.NORMAL) & (W.version(w) == 0) & W.payload(w).isin(allowed)


def decodable(w: Column) -> Column:
    """Words that plain text may hold: known characters and escapes of version 0."""
    return _is_own(w) | ((W.mode(w) == W.ESCAPE) & (W.version(w) == 0))


def decode(words: Column) -> Column:
    """The text of words. Words that are none of ``decodable`` make it null, as does a byte run that is no UTF-8.

    Each word becomes the hex of its bytes; the whole is decoded once, as a run of escapes holds whole characters.
    A zero low byte is dropped. ``words`` must be a stored column: Spark does not plan ``decode`` right over ``encode``, an
    Arrow function over a lambda over another.
    """
    return decoded_with(words, None)


def decoded_with(words: Column, other) -> Column:
    """``decode`` where ``other``, a function of a word, gives the text of words of another kind, and null for the rest."""
    return nfc(as_written(words, other))


def as_written(words: Column, other=None) -> Column:
    """The text of words before it is composed, by built-in expressions alone."""
    own = lambda w: F.hex(F.encode(F.chr(W.payload(w)), "UTF-8"))
    low = lambda w: W.payload(w, 8)
    pair = lambda w: F.concat(F.lpad(F.hex(F.shiftright(W.payload(w), 8).cast("long")), 2, "0"), F.when(low(w) != 0, F.lpad(F.hex(low(w).cast("long")), 2, "0")).otherwise(""))
    # characters above 255 are words too (œ, Œ): chr() covers one byte only
    wide = lambda w: F.when(W.payload(w) == 0x152, "C592").when(W.payload(w) == 0x153, "C593").otherwise(own(w))
    plain = lambda w: F.when(W.mode(w) == W.ESCAPE, pair(w)).otherwise(wide(w))
    told = plain if other is None else lambda w: F.coalesce(F.hex(F.encode(other(w), "UTF-8")), plain(w))
    known = decodable if other is None else lambda w: decodable(w) | other(w).isNotNull()
    content = F.when(F.forall(words, known), F.unhex(F.array_join(F.transform(words, told), "")))
    return F.try_validate_utf8(content.cast("string"))


def split_text(text: Column, size: int = 64) -> Column:
    """Pieces of ``size`` code points; an empty text has one empty piece."""
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ValueError("the size of a piece must be a positive integer")
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, 1 + i * size, F.lit(size)))


def bpe_mark(token: Column) -> Column:
    """How a token stands in a text while words are decoded."""
    mark = "￾"
    return F.concat(F.lit(mark), F.hex(token.cast("long")), F.lit(mark))
