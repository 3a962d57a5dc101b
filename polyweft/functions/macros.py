"""Macro keys in texts: sequences of characters, emoji above all, that are one word each.

At each place of a text the longest key that begins there counts. It becomes a macro word if it is a sequence that
only holds together as a whole (joiners, variation or keycap marks, skin tones, flags); otherwise its first
character is encoded as text and the search goes on at the next one. The keys make a trie, and the trie a regular
expression, a choice at each branch, so that a place costs as many steps as its longest match and the whole
runs in one built-in expression. A word that has a macro's number and no type bit decodes to the macro's key.

A table is a relation (emoji, macro_id, name, primitives) of 65 536 rows at most, as a number has 16 bits; a larger
one raises. Of rows with the same key, and of rows with the same number, the last in the table's order counts.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.functions import text as T
from polyweft.functions import words as W

#: Numbers have 16 bits.
MOST = 1 << 16
# fixed values: what makes a sequence hold together, and the two ranges of skin tones and flag letters
_GLUE = ("‍", "️", "⃣")
_TONES, _FLAGS = ("\U0001f3fb", "\U0001f3ff"), ("\U0001f1e6", "\U0001f1ff")
# type bits of which a macro word has none
_TYPED = W.DIAGRAM | W.MUSIC | W.VOICE | W.BPE | W.TOUCH | W.SMELL | W.MENTAL


def holds_together(key: str) -> bool:
    """Whether a key becomes a macro word."""
    if any(c in key for c in _GLUE) or any(_TONES[0] <= c <= _TONES[1] for c in key):
        return True
    return len(key) > 1 and all(_FLAGS[0] <= c <= _FLAGS[1] for c in key)


def trie(keys: list[str]) -> dict:
    """Nested by character; a key's end is marked by the empty string, with whether it becomes a macro word."""
    root: dict = {}
    for key in keys:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = holds_together(key)
    return root


def _any(node: dict) -> bool:
    """Whether a key that becomes a macro word ends here or further down."""
    return node.get("", False) or any(_any(n) for c, n in node.items() if c)


def _unlike(node: dict) -> bool:
    """Whether a key that does not ends further down."""
    return any(n.get("") is False or _unlike(n) for c, n in node.items() if c)


def _choice(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _rest(node: dict) -> str:
    """What goes on from here to the end of any key."""
    return _choice([re.escape(c) + ("" if "" in n else _rest(n)) for c, n in node.items() if c])


def pattern(node: dict) -> str:
    """Matches the keys below a node that become macro words and are the longest of all keys at their place."""
    further = [re.escape(c) + pattern(n) for c, n in node.items() if c and _any(n)]
    if not node.get(""):
        return _choice(further)
    end = f"(?!{_rest(node)})" if _unlike(node) else ""
    return _choice([*further, end]) if further else end


@dataclass(frozen=True)
class Macros:
    """A table of macros, as the driver holds it."""

    ids: dict[str, int]
    keys: dict[int, str]
    tree: dict = field(repr=False)

    @classmethod
    def of(cls, rows: list[tuple[str, int]]) -> Macros:
        if len(rows) > MOST:
            raise ValueError(f"a table of macros has at most {MOST} rows")
        for key, number in rows:
            if not key or not 0 <= number < MOST:
                raise ValueError("a macro needs a key, and a number of 16 bits")
        ids = dict(rows)
        return cls(ids, {n: k for k, n in rows}, trie(list(ids)))

    @classmethod
    def read(cls, table: DataFrame) -> Macros:
        """Of a relation with emoji and macro_id; one row over the bound is read, to refuse it."""
        return cls.of([(r["emoji"], r["macro_id"]) for r in table.select("emoji", "macro_id").limit(MOST + 1).collect()])

    @property
    def longest_first(self) -> list[str]:
        return sorted(self.ids, key=lambda k: (-len(k), k))

    @property
    def pattern(self) -> str | None:
        return pattern(self.tree) if _any(self.tree) else None


def _each_decomposed(units: pd.Series) -> pd.Series:
    # characters one by one: marks of neighbours are not put in order
    return units.map(lambda us: None if us is None else ["".join(unicodedata.normalize("NFD", c) for c in u) for u in us])


def units(text: Column, macros: Macros) -> Column:
    """A text cut into macro keys and what is between them."""
    if macros.pattern is None:
        return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.array(text))
    first = "".join(re.escape(c) for c in macros.tree)
    key = macros.pattern
    return F.regexp_extract_all(text, F.lit(f"({key}|(?:[^{first}]|(?!{key})(?s:.))+)"))


def _numbers(macros: Macros) -> Column:
    known = [(k, n) for k, n in macros.ids.items() if holds_together(k)]
    if not known:
        return F.create_map().cast("map<string,int>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in known]), F.array(*[F.lit(n) for _, n in known]))


def encode(text: Column, macros: Macros) -> Column:
    """The words of a text with its macros. Null gives null.

    The cut is made on the text as it is; what is between keys is then decomposed, by Arrow, if the text is not all ASCII.
    """
    cut = units(text, macros)
    plain = text.rlike(r"^[\x00-\x7F]*$")
    decomposed = F.coalesce(F.pandas_udf(_each_decomposed, "array<string>")(F.when(~plain, cut)), cut)
    number = lambda u: F.try_element_at(_numbers(macros), u)
    # a decomposed key is looked up by its place in the cut, which normal forms do not change
    return F.when(text.isNotNull(), F.flatten(F.zip_with(cut, decomposed, lambda u, d: F.when(number(u).isNotNull(), F.array(W.extension(number(u)))).otherwise(T.encode_normal(d)))))


def is_macro(word: Column, macros: Macros) -> Column:
    return (W.mode(word) == W.EXTENSION) & (word.bitwiseAND(_TYPED) == 0) & W.payload(word).isin(*macros.keys)


def decode(words: Column, macros: Macros) -> Column:
    """The text of words among which are macros; null where ``text.decode`` has null. ``words`` must be a stored column, see there."""
    if not macros.keys:
        return T.decode(words)
    known = F.map_from_arrays(F.array(*[F.lit(n) for n in macros.keys]), F.array(*[F.lit(k) for k in macros.keys.values()]))
    key = lambda w: F.when(is_macro(w, macros), F.try_element_at(known, W.payload(w)))
    return T.decoded_with(words, key)


def stroke_words(macros: DataFrame, primitives: DataFrame) -> DataFrame:
    """(emoji, words): each macro's primitives as unit words, in the macro's order; a primitive that is missing raises.

    ``macros`` has emoji and primitives, an array of names; ``primitives`` is what ``sources.files.read_primitives`` gives.
    """
    named = macros.select("emoji", F.posexplode("primitives").alias("k", "name"))
    strokes = primitives.select("name", F.transform("strokes", lambda s: F.when(F.size(s) == 6, W.unit_word(s, F.col("style_bits"))).otherwise(F.raise_error(F.lit("a row of strokes has six states")).cast("int"))).alias("own"))
    met = named.join(strokes, "name", "left")
    own = F.coalesce("own", F.raise_error(F.concat(F.lit("no primitive "), F.col("name"))).cast("array<int>"))
    made = met.groupBy("emoji").agg(F.array_sort(F.collect_list(F.struct("k", own.alias("own")))).alias("parts"))
    return made.select("emoji", F.flatten(F.transform("parts", lambda p: p["own"])).alias("words"))
