"""What the operators share: lookups, the word rule and free names."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.storage import written

__all__ = ["documents", "free_name", "give_back", "keep_memory", "kept_in_worker", "let_go", "looked_up", "met", "remainder", "small_batches", "text_of", "word_count", "written"]

#: The white space that ends a word; every other code point belongs to one.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A lookup table of so many rows at most is broadcast; a larger one is met by a salted join.
MOST_SENT, SALTS = 100_000, 32
#: What a batch of rows for Python may hold, besides Spark's limit of rows: 10000 whole texts can be any size.
BATCH_BYTES = "4m"
#: What a worker that works in steps keeps of freed memory; what is larger by itself than the second goes back at once.
KEPT_BYTES, MAPPED_BYTES = 64 << 20, 4 << 20


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with a written ``table`` of one row a key, null keys among them, though one key may hold most of ``rows``.

    The table's rows are counted: up to ``MOST_SENT`` it is broadcast; beyond, rows of a key are dealt over
    ``SALTS`` join keys, the table being repeated as often, and it is the smaller side by far.
    """
    other, salt, other_salt = free_name(rows, "looked_up_key", "looked_up_salt", "looked_up_other")
    named = table.withColumnRenamed(key, other)
    same = F.col(key).eqNullSafe(F.col(other))
    if table.count() <= MOST_SENT:
        return rows.join(F.broadcast(named), same, how).drop(other)
    salted = rows.withColumn(salt, F.floor(F.rand(1) * SALTS).cast("int"))
    repeated = named.withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, same & (F.col(salt) == F.col(other_salt)), how).drop(other, salt, other_salt)


def met(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with a written ``table`` that may be the larger side; up to ``MOST_SENT`` rows of it are broadcast."""
    return rows.join(F.broadcast(table) if table.count() <= MOST_SENT else table, key, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def remainder(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def kept_in_worker(kind: Callable, *args):
    """``kind(*args)``, made once in a Python worker and met again by its next tasks.

    Functions travel by value, so a module's own globals are new in each task; a module of this name is not.
    What is kept must bound its size itself, as workers live as long as their executor.
    """
    kept = sys.modules.setdefault("_kept_by_polyweft", types.ModuleType("_kept_by_polyweft")).__dict__
    key = f"{kind.__qualname__}{args}"
    if key not in kept:
        kept[key] = kind(*args)
    return kept[key]


def let_go() -> None:
    """Drops what other operators have kept in this worker: their tables would stand beside the memory of this one."""
    kept = sys.modules.get("_kept_by_polyweft")
    for key in [k for k in vars(kept) if not k.startswith("__")] if kept else []:
        delattr(kept, key)
    give_back()


def give_back() -> None:
    """Hands the memory that this process has freed to the system. Texts are too small for the C library to do so itself, and an
    executor's workers, busy or not, would each hold on to that of their largest batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def keep_memory() -> None:
    """From now on this process keeps up to ``KEPT_BYTES`` that it has freed, until ``give_back``. Arrays that come and go in each step
    would otherwise get pages from the system, which clears them, again and again."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
    if option:
        option(-1, KEPT_BYTES)  # M_TRIM_THRESHOLD
        option(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python hold ``BATCH_BYTES`` at most. Rows and results are the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out
