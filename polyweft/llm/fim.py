"""Fill-in-the-middle: texts cut at units into prefix, middle and suffix, and put together in another order.

A pandas UDF over Arrow batches cuts each whole text: the units' end offsets are found by one ``finditer``
and kept in a compact array, two look-ups there give the slices, and ``hashlib`` gives the seeds and digests.
A row depends on its id and text alone, so no shuffle is needed and a lost task is simply run again.

Null and empty texts are plain, with no units. A null id counts as the empty text in the seed. Rows that
repeat an id and a text come out alike, each by itself. Ids may be of any type that casts to a string.
Other columns pass through whatever their names are. An empty table gives no rows. A long text needs, while
it is cut, four bytes a unit beside the text and its output.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.llm.common import text_of

UNIT = r"[A-Za-z]+|[^A-Za-z]"
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Recipe:
    """The seed and marks, and which share of the texts stays plain or has its suffix in front, in percent."""

    seed: int = 1
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    suffix_first_percent: int = 20
    unit: str = UNIT

    def __post_init__(self):
        # a mark then never begins within another mark or within text and mark, so that the first one found is the one that was put there
        first = {m[:1] for m in self.marks}
        if len(first) != 1 or len(set(self.marks)) != 3 or any(m.count(m[:1]) != 1 for m in self.marks):
            raise ValueError("marks must differ and share a first character that none of them has again")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def numbers(recipe: Recipe, doc_id: str | None) -> list[int]:
    """Four numbers of 32 bits that the seed and the id fix."""
    digest = hashlib.sha256(f"{recipe.seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(recipe: Recipe, unit: regex.Pattern, doc_id: str | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and output of one text."""
    ends = array("I", (m.end() for m in unit.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = numbers(recipe, doc_id)
    if not text or any(m in text for m in recipe.marks) or h3 % 100 >= 100 - recipe.plain_percent:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, end = (ends[k - 1] if k else 0 for k in (first, last))
    before, middle, after = text[:start], text[start:end], text[end:]
    if h4 % 100 < recipe.suffix_first_percent:
        form, output = "spm", f"{recipe.suffix}{after}{recipe.prefix}{before}{recipe.middle}{middle}"
    else:
        form, output = "psm", f"{recipe.prefix}{before}{recipe.suffix}{after}{recipe.middle}{middle}"
    return n, form, start, end - start, output


def restored(recipe: Recipe, form: str, output: str) -> str:
    """The text, from nothing but the output and its form."""
    if form == "plain":
        return output
    head, second = (recipe.prefix, recipe.suffix) if form == "psm" else (recipe.suffix, recipe.prefix)
    if not output.startswith(head):
        raise ValueError(f"no output of the form {form}")
    one, _, rest = output[len(head) :].partition(second)
    two, _, middle = rest.partition(recipe.middle)
    return one + middle + two if form == "psm" else two + middle + one


def transformed(recipe: Recipe = Recipe(), with_output: bool = True):
    """A function of columns (id as string, text) to a struct of ``RESULT``; without ``with_output`` the output is null and only its digest returns."""

    @F.pandas_udf(RESULT)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(recipe.unit)
        sha = lambda t: hashlib.sha256(t.encode("utf-8")).hexdigest()
        rows = []
        for doc_id, text in zip(ids, texts):
            n, form, before, middle, output = cut(recipe, unit, doc_id, text)
            rows.append((n, form, before, middle, output if with_output else None, sha(output), sha(restored(recipe, form, output))))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64", "form": object, "output": object, "output_sha256": object, "restored_sha256": object})

    return run


def restored_text(form: Column, output: Column, recipe: Recipe = Recipe()) -> Column:
    """The texts back from output and form."""

    @F.pandas_udf("string")
    def run(forms: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(recipe, f, o) for f, o in zip(forms, outputs)], dtype=object)

    return run(form, output)


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text", into: str = "fim", with_output: bool = True) -> DataFrame:
    """``docs`` with the struct column ``into``; a column of that name is replaced."""
    return docs.withColumn(into, transformed(recipe, with_output)(F.col(id_col).cast("string"), text_of(text_col)))
