"""Exact byte-pair encoding of whole texts by backtracking, and decoding by a table of offsets.

Merges are found without running them. An Aho-Corasick automaton over all tokens gives the longest token
that begins at each place of a word. The encoder goes from left to right: a token is kept if it is compatible
with the one before, that is if the merges of their joined text would leave exactly the two; otherwise the
next shorter token that begins there is tried, and when none is left the last kept token is given up and its
end is marked as dead, so that no place is tried twice. Of the compatible sequences there is one only, and it
is what the merges give. Compatibility is found by walking both tokens back to their parts, and is kept in a table.

A word is a run of the vocabulary's own cutting rule; it never crosses ASCII white space. The last symbol of
a word is another symbol than the same one inside. The ids of words and of pieces between white space are kept,
in bounded tables. Printable ASCII and Latin-1 letters are cut here; every other piece is normalised and cut by
the library's own normaliser and rule, so that Unicode versions agree.

Ids are kept as the bytes of little-endian unsigned 32-bit integers. Null and empty texts have no ids, and a
null of ids decodes to the empty text. Rows are independent: repeats come out alike, null ids of documents do
not matter, other columns pass through whatever their names are, and an empty table gives no rows. A text
of one long word takes time in proportion to its length. Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.llm.common import text_of

VOCABULARY = "word_bpe_49k.json"

#: The cutting rule that the short way below is made for: pieces of printable ASCII and precomposed Latin-1 letters, which normalising leaves alone.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
SHORT_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: How byte-level vocabularies write bytes: printable ones of Latin-1 as themselves, the others in order from U+0100.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def _lowered(normalizer: dict | None) -> bool:
    return bool(normalizer) and [x.get("type") for x in normalizer.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]


class Encoder:
    """Tables of one vocabulary file: tokens by number, basic symbols first, then merges in their order."""

    MOST_PIECES, MOST_PAIRS, LONG = 400_000, 1_000_000, 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, suffix = told["model"], told["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE vocabulary with merges alone")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary = model["vocab"]
        made = [a + b for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("two merges make the same token")
        names = sorted(set(vocabulary) - set(made), key=vocabulary.get) + made
        number = {t: k for k, t in enumerate(names)}
        self.basic = len(names) - len(made)
        #: what a symbol at the end of a word is moved by, beyond all others
        self.shift = 1 + max(ord(c) for t in names[: self.basic] for c in t)
        last = lambda t: chr(ord(t[0]) + self.shift) if suffix and len(t) > len(suffix) and t.endswith(suffix) else t
        symbols = [last(t) for t in names[: self.basic]]
        if any(len(s) != 1 for s in symbols):
            raise ValueError("a token of several symbols that no merge makes")
        self.left, self.right = array("i", range(self.basic)), array("i", range(self.basic))
        for a, b in merges:
            self.left.append(number[a])
            self.right.append(number[b])
            symbols.append(symbols[number[a]] + symbols[number[b]])
        self.ends_words = bool(suffix)
        self.merge = {(self.left[k], self.right[k]): k for k in range(self.basic, len(names))}
        self.ids = array("I", (vocabulary[t] for t in names))
        self.length = array("i", map(len, symbols))
        known = {s: k for k, s in enumerate(symbols)}
        #: the longest token that another one begins with; itself for single symbols
        self.shorter = array("i", (next((known[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in known), k) for k, s in enumerate(symbols)))
        self.automaton = ahocorasick.Automaton()
        for k, s in enumerate(symbols):
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()

        self._library = Tokenizer.from_file(path)
        self._short_way = _lowered(told.get("normalizer")) and (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern") == {"Regex": RULE}
        special = {t["content"].encode(): t["id"] for t in told.get("added_tokens", []) if t["content"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told.get("added_tokens", [])):
            raise ValueError("special strings other than literal ones")
        self._special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self._cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + b")") if special else None
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[bytes, bytes] = {}
        self._known_words: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the joined text of two tokens leave these two.

        Both are taken apart again, the later merge first. ``until`` is when a part is merged on; a merge over
        the border that comes before that would have been made. Of equal merges the left one comes first.
        """
        until_a = until_b = len(self.left)
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < until_a and across <= until_b:
                return False
            if max(a, b) < self.basic:
                return True
            if a > b:
                until_a, a = a, self.right[a]
            else:
                until_b, b = b, self.left[b]

    def _fits(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        found = self._pairs.get(pair)
        if found is None:
            if len(self._pairs) >= self.MOST_PAIRS:
                self._pairs.clear()
            found = self._pairs[pair] = self.compatible(a, b)
        return found

    def word(self, symbols: str) -> list[int]:
        """Tokens of one word, whose last symbol is moved by ``shift``.

        If the longest token at each place in turn fits the one before, these are the tokens, and nothing is to be given up.
        """
        kept = [token for _, token in self.automaton.iter_long(symbols)]
        if all(map(self._fits, kept, kept[1:])):
            return kept
        n, length, shorter = len(symbols), self.length, self.shorter
        longest, dead = array("i", bytes(4 * n)), bytearray(n + 1)
        for end, token in self.automaton.iter(symbols):  # ends ascend: the last to begin at a place is its longest
            longest[end + 1 - length[token]] = token
        kept = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not kept or self._fits(kept[-1], token)):
                kept.append(token)
                at = end
                token = longest[at] if at < n else 0
            elif shorter[token] != token:
                token = shorter[token]
            else:
                dead[at] = 1
                token = kept.pop()
                at -= length[token]
        return kept

    def _cut_words(self, piece: str) -> list[str]:
        """Words in the vocabulary's writing of bytes."""
        if self._short_way and SHORT.fullmatch(piece):
            words = SHORT_WORD.findall(piece.lower())
            return words if piece.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(BYTES) for w in words]
        if self._library.normalizer is not None:
            piece = self._library.normalizer.normalize_str(piece)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(piece)]

    def _word_ids(self, word: str) -> bytes:
        found = self._known_words.get(word)
        if found is None:
            tokens = self.word(word[:-1] + chr(ord(word[-1]) + self.shift) if self.ends_words else word)
            ids = array("I", [self.ids[t] for t in tokens])
            if sys.byteorder == "big":
                ids.byteswap()
            found = ids.tobytes()
            if len(word) <= self.LONG:
                if len(self._known_words) >= self.MOST_PIECES:
                    self._known_words.clear()
                self._known_words[word] = found
        return found

    def piece(self, piece: bytes) -> bytes:
        """Ids of a text without ASCII white space and special strings."""
        found = b"".join(map(self._word_ids, self._cut_words(piece.decode("utf-8", "replace"))))
        if len(piece) <= self.LONG:
            if len(self._pieces) >= self.MOST_PIECES:
                self._pieces.clear()
            self._pieces[piece] = found
        return found

    def text(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        if self._cut and self._cut.search(text):
            return b"".join(self._special.get(part) or self.text(part) for part in self._cut.split(text) if part)
        known = self._pieces.get
        out = []
        for p in text.split():
            ids = known(p)
            out.append(self.piece(p) if ids is None else ids)
        return b"".join(out)


class Decoder:
    """All tokens one after another, a space before each, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told.get("decoder"):
            raise ValueError("only vocabularies without a decoding rule, whose tokens are joined by spaces")
        tokens = told["model"]["vocab"] | {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        by_id = {i: (" " + t).encode() for t, i in tokens.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def text(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens; ids that are no token are left out."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        numbers = numbers[numbers < len(self.offsets) - 1]
        starts = self.offsets[numbers]
        lengths = self.offsets[numbers + 1] - starts
        ahead = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum()), dtype=np.int64)
        return self.bytes[at + np.repeat(starts - ahead, lengths)].tobytes()[1:]


#: Rows that are given back at once, so that results do not pile up in a worker.
AT_ONCE = 128


def _parts(batches: Iterator[pd.Series]) -> Iterator[list[bytes]]:
    for rows in batches:
        for at in range(0, len(rows), AT_ONCE):
            yield [r or b"" for r in rows.iloc[at : at + AT_ONCE]]


def encode(text: Column, vocabulary: str) -> Column:
    """Ids of each text as bytes; the vocabulary's tables are made once a task."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary)
        for texts in _parts(batches):
            yield pd.Series([encoder.text(t) for t in texts], dtype=object)

    return run(text.cast("binary"))


def decode(ids: Column, vocabulary: str) -> Column:
    """Texts of ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(vocabulary)
        for rows in _parts(batches):
            yield pd.Series([decoder.text(i).decode("utf-8") for i in rows], dtype=object)

    return run(ids)


def round_trip(text: Column, vocabulary: str) -> Column:
    """struct(ids, decoded): a text's ids and what they decode to, by one worker instead of two in a row."""

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for texts in _parts(batches):
            ids = [encoder.text(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [decoder.text(i).decode("utf-8") for i in ids]}, dtype=object)

    return run(text.cast("binary"))


def n_tokens(ids: Column) -> Column:
    return (F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")


def encoded(docs: DataFrame, vocabulary: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole texts; a column of that name is replaced."""
    return docs.withColumn(into, encode(text_of(text_col), vocabulary))


def decoded(docs: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the texts that the ids stand for."""
    return docs.withColumn(into, decode(F.col(ids_col), vocabulary))
