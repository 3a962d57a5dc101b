"""Ids of a public tokenizer, word by word.

The vocabulary's rule never crosses white space, so a text's ids are those of its words; these repeat, and
are kept per worker. New words are looked up together: a word of letters alone is one unit of the rule and
its last id, and no other, has the mark of a word's end, which cuts the ids of a joined line into words.
Letters followed by signs other than an apostrophe are always cut between the two. What is kept is bounded:
a full table is emptied.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

_LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_LETTERS_THEN_SIGNS = re.compile(rb"(" + _LETTERS + rb")([!-&(-/:-@\[-`{-~]*)")
_END = "</w>"
#: Bytes that begin a combining mark of U+0300 to U+036F; no other marks compose with ASCII letters.
_MARK = re.compile(rb"[\xcc\xcd]")


class WordIds(dict):
    """Words, as UTF-8 bytes, to their ids as little-endian unsigned 32-bit integers."""

    MOST, TOGETHER = 800_000, 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith(_END)]] = True

    def _ids(self, text: bytes) -> bytes:
        return np.array(self._tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        self[word] = found = self._ids(word)
        return found

    def _learn(self, new: Iterable[bytes]) -> None:
        # special strings have letters after signs and are never cut here
        cut = {w: m for w in new if (m := _LETTERS_THEN_SIGNS.fullmatch(w))}
        bases = [w for w in {m[1] for m in cut.values()} if w not in self]
        for at in range(0, len(bases), 4096):
            part = bases[at : at + 4096]
            ids = np.frombuffer(self._ids(b" ".join(part)), "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(part):  # a base that the rule cuts after all
                continue
            starts = [0, *ends[:-1].tolist()]
            self.update((w, ids[s:e].tobytes()) for w, s, e in zip(part, starts, ends.tolist()))
        for w, m in cut.items():
            if m[2]:
                self[w] = self[m[1]] + self[m[2]]

    def texts(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """All ids of each text. The vocabulary lower-cases; strings of special tokens are matched in a text as it is."""
        group: list[list[bytes]] = []

        def out() -> Iterator[bytes]:
            if len(self) > self.MOST:
                self.clear()
            self._learn([w for w in set().union(*group) if w not in self])
            for words in group:
                yield b"".join(map(self.__getitem__, words))
            group.clear()

        for text in texts:
            low = text.lower()
            # J and a caron compose to nothing, j and a caron to one letter: what marks may follow is left to the library
            as_it_is = any(s in low for s in self._special) or _MARK.search(text)
            group.append(text.split() if as_it_is else low.split())
            if len(group) == self.TOGETHER:
                yield from out()
        yield from out()
