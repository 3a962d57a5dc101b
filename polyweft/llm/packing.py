"""Best-fit packing by minimum bin slack.

A first pass makes pieces, their crc32 and each piece's rank among those of its length within the task, and
writes these small rows. Which lengths share a bin depends on the counts per length alone, a histogram of
``size`` rows at most however many documents there are. The driver packs it: per bin a subset-sum over the
available lengths, kept as the bits of one integer, finds the fullest feasible combination; the combination
leaves the histogram as often as the counts allow. A second pass gives each piece its place: its rank among
all pieces of its length selects a bin of the patterns that hold this length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyweft.llm.common import give_back, kept_in_worker, written
from polyweft.llm.wordids import WordIds

SIZE = 2048
VOCABULARY = "word_bpe_49k.json"
END = b"\0\0\0\0"


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """How often each length stands in the fullest bin that ``counts`` allow; long pieces are preferred among equals.

    ``reach`` has bit s set if some choice of the lengths so far sums to s. A length of count c enters in
    binary portions, so that each takes log c shifts; the way back takes the portions that were needed.
    """
    whole = (1 << (size + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, portion = min(counts[length], size // length), 1
        while left > 0:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & whole
            left -= take
            portion *= 2
        if reach >> size & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


def _patterns(counts: dict[int, int], size: int, seeded: bool) -> list[tuple[dict[int, int], int]]:
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        if seeded:
            seed = max(left)
            rest = {k: v - (k == seed) for k, v in left.items() if k <= size - seed and v > (k == seed)}
            bin_ = fullest(rest, size - seed)
            bin_[seed] = bin_.get(seed, 0) + 1
        else:
            bin_ = fullest(left, size)
        times = min(left[k] // n for k, n in bin_.items())
        out.append((bin_, times))
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def patterns(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Bins of equal content and how many there are of each, in the order they were found.

    Once the fullest of all combinations is taken for each bin, once the fullest that holds the longest piece left,
    which spares the long pieces a bin of their own at the end; what needs fewer bins stays.
    """
    return min((_patterns(counts, size, seeded) for seeded in (False, True)), key=lambda found: sum(times for _, times in found))


def places(packed: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, copies in a bin, first bin, offset in the bin) by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for bin_, times in packed:
        at = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            out.setdefault(length, []).append((ranks.get(length, 0), n, first, at))
            ranks[length] = ranks.get(length, 0) + n * times
            at += n * length
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, rank: the last is the piece's number among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = kept_in_worker(WordIds, vocabulary)
        task = pyspark.TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.texts(t or b"" for t in batch.column(1).to_pylist())):
                ids += END
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, size)):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    rows.append((doc_id, k, start, length, zlib.crc32(part), task, int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int64(), pa.int32(), *[pa.int64()] * 5))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long")


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are the end id alone. Each row is packed, so rows that repeat an id give their pieces
    again, and a null id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    made = written(pieces(docs, id_col, text_col, vocabulary, size), "pieces")
    by_task = written(made.groupBy("length", "task").count(), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # size rows at most
    found = spark.sparkContext.broadcast(places(patterns(counts, size)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # lengths by tasks grow with the input: a merge join of small rows, some 60 bytes for 2048 tokens, on keys that a task bounds
    ranked = made.join(firsts.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                use = np.flatnonzero(length == value)
                table = found.value[int(value)]
                row = table[np.searchsorted(table[:, 0], rank[use], "right") - 1]
                k = rank[use] - row[:, 0]
                sequence[use] = row[:, 2] + k // row[:, 1]
                offset[use] = row[:, 3] + k % row[:, 1] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
