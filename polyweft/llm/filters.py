"""What filters remove in every order, with exact duplicates found by partition refinement.

Five filters fail a document: A too few words, B too few distinct words, C too many capitals, D any of some signs,
E a text that a smaller id has as well. One scan measures every whole text: a mask of A to D, its code points and
the hashes of its blocks (the first 256 code points, then each block 31 times all before it). These small rows
are split by length, then by one block after another; groups of one row drop out each time. Only the texts of the
rows that are left are compared, as grouping keys, which tasks combine before anything is shuffled. Rows whose id
is not the least of their text fail E. Then masks are counted by part, and every order is read off the 32 counts
of the documents that pass each set of filters.

A group that holds a large share of the rows is never gathered: its key is joined by broadcast, see ``Groups``.
If texts share length and all hashes and still differ, their rows are read again and told apart by the text.

Null texts are empty, a null part is the empty string. A row without id has no smaller id and is none: it fails
E never and makes no other row fail. Rows that repeat an id and a text both stay, as neither id is smaller. Ids
are compared as they are, whatever their type. Of labels that repeat an id the largest holds; rows without a label
count as neither good nor toxic. Other columns, also of clashing names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.llm.common import text_of, written

LETTERS = "ABCDE"
#: Where blocks begin, in code points; the last goes on to the end of any text that Spark holds.
FIRST, FACTOR, LONGEST = 256, 32, 2**31 - 1
STARTS = [0, *(FIRST * FACTOR**k for k in range(5))]
#: So many groups at most are broadcast.
MOST_SENT = 100_000
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


@dataclass(frozen=True)
class Limits:
    least_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    signs: str = "#$%&*|"


def failed(limits: Limits, text: bytes, chars: int) -> int:
    """Bits of A to D of one whole text in UTF-8."""
    words = text.split()  # bytes split at the six ASCII white spaces and nowhere else
    n = len(words)
    return (
        (n < limits.least_words)
        | (100 * len(set(words)) < limits.distinct_percent * n) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPER))) > limits.capital_percent * chars) << 2
        | (len(text.translate(None, limits.signs.encode())) < len(text)) << 3
    )


def masks(text: Column, chars: Column, limits: Limits) -> Column:
    @F.pandas_udf("int")
    def run(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([failed(limits, t, n) for t, n in zip(texts, counts.tolist())], dtype="int32")

    return run(text.cast("binary"), chars)


def block_hashes(text: Column) -> Column:
    """Hashes of the blocks that a text has, in order; the empty text has none."""
    return F.array_compact(F.array(*[F.when(F.length(text) > a, F.xxhash64(F.substring(text, a + 1, b - a))) for a, b in zip(STARTS, [*STARTS[1:], LONGEST])]))


@dataclass(frozen=True)
class Groups:
    """A written table of one row a key; ``n`` is the number of rows of the key."""

    table: DataFrame
    keys: list[str]
    groups: int
    rows: int
    most: int

    @classmethod
    def of(cls, df: DataFrame, name: str, keys: list[str], most: str) -> Groups:
        """``most``: the column whose largest value is wanted."""
        table = written(df, name)
        told = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(most), F.lit(0))).first()
        return cls(table, keys, *told)

    @property
    def few(self) -> bool:
        return self.groups <= MOST_SENT

    def joined(self, rows: DataFrame, how: str) -> DataFrame:
        """``rows`` with what the table has of their key.

        A table of up to ``MOST_SENT`` rows is broadcast. Of a larger one the keys of so many rows that there are at
        most ``MOST_SENT`` of them are, and their rows stay where they are; all others are few rows a key and are shuffled.
        """
        if self.few:
            return rows.join(F.broadcast(self.table), self.keys, how)
        large = F.col("n") > math.ceil(self.rows / MOST_SENT)
        hot, rest = self.table.where(large), self.table.where(~large)
        marked = rows.join(F.broadcast(hot.select(*self.keys, F.lit(True).alias("is_hot"))), self.keys, "left")
        hot_rows = marked.where("is_hot").drop("is_hot").join(F.broadcast(hot), self.keys, how)
        return hot_rows.unionByName(marked.where("is_hot is null").drop("is_hot").join(rest.hint("merge"), self.keys, how))


def refined(rows: DataFrame) -> Groups:
    """Of written rows with ``chars`` and ``blocks``, the groups of at least two rows that agree in both.

    A group of one round is split by the next block of its rows; who is in it is told by its key, so no round writes rows.
    """
    found = None
    level = 0
    while found is None or found.most > level:
        left = rows
        if found:
            left = found.joined(rows.withColumn("head", F.slice("blocks", 1, level)), "left_semi")
            level += 1
        head = F.slice("blocks", 1, level) if level else F.array().cast("array<bigint>")
        counted = left.withColumn("head", head).groupBy("chars", "head").agg(F.count("*").alias("n"), F.max(F.size("blocks")).alias("most"))
        found = Groups.of(counted.where("n > 1"), "groups", ["chars", "head"], "most")
    return replace(found, table=found.table.withColumnRenamed("head", "blocks"), keys=["chars", "blocks"])


def marked(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (bits 0 to 4 for A to E) of every row."""
    text, chars = text_of(text_col), F.length(text_of(text_col)).cast("long")
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), chars.alias("chars"), block_hashes(text).alias("blocks"))
    measured = written(whole.select("doc_id", "part", masks(F.col("text"), F.col("chars"), limits).alias("mask"), "chars", "blocks"), "measured")
    groups = refined(measured.where("doc_id is not null").select("chars", "blocks"))
    texts = whole.where("doc_id is not null")
    if groups.few:  # beyond, most texts may well have a namesake, and are compared without being chosen
        texts = groups.joined(texts, "left_semi")
    compared = written(texts.groupBy("chars", "blocks", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).select("chars", "blocks", "least", "n"), "compared")
    by_key = compared.groupBy("chars", "blocks").agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.sum("n").alias("n")).where("n > 1")
    least = Groups.of(by_key, "least-ids", ["chars", "blocks"], "texts")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * 16
    out = lambda df: df.select("doc_id", "part", (F.col("mask") + later).alias("mask"))
    rows = least.joined(measured, "left")
    if least.most < 2:
        return out(rows)
    # hashes that say the same of different texts: these rows by their texts; Spark splits a large key of this join
    odd = whole.join(least.table.where("texts > 1").select("chars", "blocks"), ["chars", "blocks"], "left_semi")
    odd = written(odd.select("doc_id", "part", masks(F.col("text"), F.col("chars"), limits).alias("mask"), "text"), "same-hashes")
    return out(rows.where("texts is null or texts = 1")).unionByName(out(odd.join(odd.groupBy("text").agg(F.min("doc_id").alias("least")), "text")))


def orders() -> list[dict]:
    """Each step of each order: the filters before it, and with it, as bits."""
    out = []
    for order in itertools.permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            at = LETTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "at": at, "own": 1 << at, "before": before, "after": before | 1 << at})
            before |= 1 << at
    return out


def audited(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id_col: str = "doc_id") -> DataFrame:
    """One row for each part, order of the filters and step."""
    rows = marked(docs, limits, id_col, text_col, part_col)
    told = labels.select(F.col(label_id_col).alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    known = rows.where("doc_id is not null").join(told, "doc_id", "left")
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})  # one key of nulls, if it went through the join
    counts = known.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    # by set of filters, the documents that pass them all
    passing = lambda c: F.expr(f"array({', '.join(f'sum(if(mask & {s} = 0, {c}, 0))' for s in range(32))})").alias(c)
    alone = F.expr(f"array({', '.join(f'sum(if(mask = {1 << k}, n, 0))' for k in range(5))})").alias("alone")
    by_part = counts.groupBy("part").agg(passing("n"), passing("good"), passing("toxic"), alone)
    # a set of k filters comes before a given one in k! (4 - k)! orders
    weight = lambda s: math.factorial(s.bit_count()) * math.factorial(4 - s.bit_count())
    shares = [" + ".join(f"{weight(s)} * (n[{s}] - n[{s | 1 << k}])" for s in range(32) if not s >> k & 1) for k in range(5)]
    by_part = by_part.withColumn("shares", F.expr(f"array({', '.join(shares)})"))
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,at:int,own:int,before:int,after:int>>")
    each = by_part.withColumn("o", F.explode(steps))
    lost = lambda c: F.get(c, F.col("o.before")) - F.get(c, F.col("o.after"))
    failing = F.col("n")[0] - F.get("n", F.col("o.own"))
    return each.select(
        "part", "o.filter_order", "o.step", F.get("n", F.col("o.after")).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        F.get("alone", F.col("o.at")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("o.at")).alias("shapley"),
    )
