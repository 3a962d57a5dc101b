"""Scoring whole texts with the attention model and with smoothed word counts, both learnt from the corpus.

1. Words of all texts are counted per task and summed by word, those of training texts apart: (word, n, seen),
   written. Its size follows the corpus. Numbers of words and distinct words come from it.
2. Ids of words weighted by their counts give the vocabulary and the transitions (two sums of fixed size).
3. One pass cuts every text into classes and adds up its base score; both are written, for the passes to come. The
   counts of at most ``HOT`` words, those that all texts, held-out ones too, hold more often than a number found from
   a histogram, are sent to the tasks; words beyond them stay with their document, are exploded, joined with the
   counts by word and summed by document. A frequent word is therefore never a join key, whether it was learnt from
   or not.
4. The model: gradients go over the classes of all training texts, where they are, and the parameters of the tasks
   are averaged by weight. ``START_DOCS`` training texts on the driver give the parameters that all tasks begin with.
5. One pass scores the classes of every text.
"""

from __future__ import annotations

import contextlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.llm import lm
from polyweft.llm.common import give_back, keep_memory, small_batches, written

HOT = 131_072
START_DOCS, STEPS, RATE = 600, 500, 0.02
#: Times that the start may see a window, lest a small corpus be learnt by heart.
PASSES, START_WINDOWS = 5, 256
#: One of so many training texts gives gradients: all of them.
SHARE, SHARE_STEP_WINDOWS, SHARE_RATE = 1, 128, 0.003
#: White space is no word, so this cannot be one: the end of a text.
END = b"\n"
#: Distinct words that a task counts before it passes them on.
DISTINCT = 1_000_000


def _texts(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.withColumn("learn", F.coalesce(learn, F.lit(False)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, seen): how often a word stands in the training texts and in all, the end of a text counted as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(taught) + [w for w in other if w not in taught]
            n = list(map(taught.get, words, itertools.repeat(0)))
            seen = list(map(int.__add__, n, map(other.get, words, itertools.repeat(0))))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())], names=["word", "n", "seen"])

        for batch in batches:
            for t, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counter = taught if learn else other
                counter.update((t or b"").lower().split())
                counter[END] += 1
                if len(taught) + len(other) > DISTINCT:
                    yield out()
                    taught.clear()
                    other.clear()
        yield out()

    return texts.select("t", "learn").mapInArrow(run, "word binary, n long, seen long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def pair_counts(counts: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(a, b, n): how often subword id b follows a inside the training words; -1 stands before the first and after the last.

    Each distinct word is cut once; a task sums its pairs before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lm.Subwords(ranks, pattern)
        size = words.n_ids + 1
        keys, sums = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            both = [(w, k) for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w != END]
            ids, begins = words.many([w for w, _ in both])
            word = np.cumsum(begins) - 1
            line = np.full(len(ids) + len(both) + 1, -1, np.int64)
            line[np.arange(len(ids)) + word + 1] = ids
            lengths = np.bincount(word, minlength=len(both)) if len(both) else np.zeros(0, np.int64)
            n = np.repeat(np.array([k for _, k in both], np.float64), lengths + 1)
            key, at = np.unique(np.concatenate((keys, (line[:-1] + 1) * size + line[1:] + 1)), return_inverse=True)
            keys, sums = key, np.bincount(at, np.concatenate((sums, n)), len(key))
        yield pa.RecordBatch.from_arrays([pa.array(keys // size - 1), pa.array(keys % size - 1), pa.array(sums)], names=["a", "b", "n"])

    return counts.where("n > 0").select("word", "n").mapInArrow(run, "a long, b long, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _id_sums(pairs: DataFrame, n_ids: int) -> np.ndarray:
    """Number of each subword id in the training words."""
    out = np.zeros(n_ids)
    for r in pairs.where("b >= 0").groupBy("b").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        out[r["b"]] = r["n"]
    return out


def _move_sums(pairs: DataFrame, cls: np.ndarray) -> np.ndarray:
    """Class transitions inside the training words; in two more rows the classes that begin and end them."""
    size = lm.SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (c.to_numpy() for c in batch.columns)
            ca, cb = cls[np.maximum(a, 0)].astype(np.int64), cls[np.maximum(b, 0)].astype(np.int64)
            at = np.where(a < 0, size * size + cb, np.where(b < 0, (size + 1) * size + ca, ca * size + cb))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    summed = pairs.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # a number that the classes set
    out = np.zeros((size + 2) * size)
    out[summed["at"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(size + 2, size)


class _Words:
    """Words to numbers, and by number their classes as uint16 bytes, their log base shares, the log shares of their rare ids, and what they are:
    neither, COLD (not among ``hot``) or STRANGE (never learnt from). Bounded: a full table is emptied."""

    MOST = 300_000
    COLD, STRANGE = 1, 2

    def __init__(self, words: lm.Subwords, cls: np.ndarray, share: np.ndarray, hot: dict[bytes, float], strange: frozenset[bytes]):
        self._words, self._cls, self._share, self._hot, self._strange = words, cls.astype(np.uint16), share, hot, strange
        self._empty()

    def _empty(self) -> None:
        self._of: dict[bytes, int] = {}
        self._code: list[bytes] = []
        self._base, self._rare, self._kind = np.zeros(self.MOST), np.zeros(self.MOST), np.zeros(self.MOST, np.int8)

    def _learn(self, new: list[bytes]) -> None:
        ids, begins = self._words.many(new)
        starts, n = np.flatnonzero(begins), len(self._code)
        code, edges = self._cls[ids].tobytes(), [*(2 * starts).tolist(), 2 * len(ids)]
        self._code += [code[a:b] for a, b in zip(edges, edges[1:])]
        self._of.update(zip(new, range(n, n + len(new))))
        more = max(0, n + len(new) - len(self._base))
        if more:
            self._base, self._rare, self._kind = (np.concatenate([x, np.zeros(max(more, len(x)), x.dtype)]) for x in (self._base, self._rare, self._kind))
        at = slice(n, n + len(new))
        found = list(map(self._hot.get, new))
        self._base[at] = [f or 0.0 for f in found]
        self._rare[at] = np.add.reduceat(self._share[ids], starts)  # ids of their own have a log share of 0
        self._kind[at] = [self.COLD if f is None else self.STRANGE * (w in self._strange) for w, f in zip(new, found)]

    def coded(self, texts: list[list[bytes]]) -> Iterator[tuple[bytes, float, float, int, list[bytes]]]:
        """Of texts of words: their classes, log base share, log shares of rare ids, number of strange words, and cold words."""
        if len(self._code) > self.MOST:
            self._empty()
        numbers, missed = [list(map(self._of.get, words)) for words in texts], []
        for words, found in zip(texts, numbers):
            i = -1
            with contextlib.suppress(ValueError):  # there are no more
                while True:
                    i = found.index(None, i + 1)
                    missed.append((found, i, words[i]))
        if missed:
            self._learn(list(dict.fromkeys(w for _, _, w in missed)))
            for found, i, w in missed:
                found[i] = self._of[w]
        for words, found in zip(texts, numbers):
            at = np.array(found, np.int64)
            kind = self._kind[at]
            cold = [words[i] for i in np.flatnonzero(kind == self.COLD).tolist()]
            yield b"".join(map(self._code.__getitem__, found)), float(self._base[at].sum()), float(self._rare[at].sum()), int(np.count_nonzero(kind == self.STRANGE)), cold


def _classes(codes: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16) for c in codes.to_pylist()]


def _vocabulary(spark: SparkSession, counts: DataFrame, ranks: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each subword id its class and log share, and the smoothed transitions of classes."""
    pairs = written(pair_counts(counts, ranks, pattern), "pairs")
    cls, share = lm.vocabulary(_id_sums(pairs, lm.Subwords(ranks, pattern).n_ids))
    moves = _move_sums(pairs, cls)
    ends = counts.where((F.col("word") == F.lit(END)) & (F.col("n") > 0)).select("n").first()
    return cls, share, lm.transitions(moves[:-2], moves[-2], moves[-1], float(ends["n"]) if ends else 0.0)


def _coded(texts: DataFrame, cls: np.ndarray, share: np.ndarray, hot: dict[bytes, float], strange: frozenset[bytes], ranks: str, pattern: str) -> DataFrame:
    """(row, doc_id, learn, n_tokens, n_strange, base, rare, cold, code) of every text, cut and looked up once for all that follows.

    ``base`` has the words of ``hot``, ``cold`` the others; ``code`` is the text's classes as uint16.
    """
    sent = texts.sparkSession.sparkContext.broadcast((cls, share, hot, strange))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        cls, share, hot, strange = sent.value
        table = _Words(lm.Subwords(ranks, pattern), cls, share, hot, strange)
        end, end_cold = hot.get(END) or 0.0, [] if END in hot else [END]
        for batch in batches:
            for group in lm.chunked(zip(*(c.to_pylist() for c in batch.columns)), 1_000_000, lambda r: len(r[1] or b"")):
                words_of = [(t or b"").lower().split() for _, t, _ in group]
                code, base, rare, n_strange, cold = zip(*table.coded(words_of))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in group], pa.int64()), pa.array([r[2] for r in group], pa.bool_()), pa.array([len(w) + 1 for w in words_of], pa.int64()),
                        pa.array([n + (END in strange) for n in n_strange], pa.int64()), pa.array([b + end for b in base], pa.float64()), pa.array(rare, pa.float64()),
                        pa.array([c + end_cold for c in cold], pa.list_(pa.binary())), pa.array(code, pa.binary()),
                    ],
                    names=["doc_id", "learn", "n_tokens", "n_strange", "base", "rare", "cold", "code"],
                )
        del table
        give_back()

    rows = texts.select("doc_id", "t", "learn").mapInArrow(run, "doc_id long, learn boolean, n_tokens long, n_strange long, base double, rare double, cold array<binary>, code binary")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "coded")
    sent.unpersist()
    return rows


def _trained(coded: DataFrame, table: np.ndarray) -> dict:
    """Fixed terms and parameters. Every text gives gradients; ``windows`` is the number of windows that did."""
    spark = coded.sparkSession
    begin, fixed = lm.start(table)
    order = F.xxhash64(F.lit(1), "doc_id")
    sample = coded.select(order.alias("o"), "doc_id").orderBy("o", "doc_id").limit(START_DOCS)  # START_DOCS ids
    rows = coded.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").select("code").limit(START_DOCS).collect()
    start = [np.frombuffer(c, np.uint16) for c in sorted(bytes(r["code"]) for r in rows)]
    windows = sum(-(-(len(t) + 1) // lm.SCORED) for t in start)
    params, _ = lm.train(begin, fixed, start, min(STEPS, -(-PASSES * windows // START_WINDOWS)), RATE, START_WINDOWS)
    sent = spark.sparkContext.broadcast((fixed, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        fixed, params = sent.value
        now, weight = params, 0
        for batch in batches:
            own = _classes(batch.column(0))
            n = sum(-(-(len(t) + 1) // lm.SCORED) for t in own)
            for group in lm.chunked(own, 400_000, len):
                steps = max(1, sum(-(-(len(t) + 1) // lm.SCORED) for t in group) // SHARE_STEP_WINDOWS)
                now = lm.train(now, fixed, group, steps, SHARE_RATE, SHARE_STEP_WINDOWS)[0]
            weight += n
        give_back()
        if weight:
            v = (lm.flat(now).astype(np.float64) - lm.flat(params)) * weight
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v) + 1)), pa.array(np.append(v, weight))], names=["at", "v"])

    moved = coded.select("code").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # a row per parameter
    windows = 0
    if len(moved):
        v = np.zeros(int(moved["at"].max()) + 1)
        v[moved["at"].to_numpy()] = moved["v"].to_numpy()
        windows = int(v[-1])
        params = lm.unflat(lm.flat(params) + v[:-1] / v[-1], params)
    sent.unpersist()
    return {"fixed": fixed, "params": params, "windows": windows}


def learnt(texts: DataFrame, counts: DataFrame, ranks: str, pattern: str) -> dict:
    """The model of all ``texts``: classes, shares, fixed terms and parameters."""
    cls, share, table = _vocabulary(texts.sparkSession, counts, ranks, pattern)
    return {"cls": cls, "share": share, **_trained(_coded(texts, cls, share, {}, frozenset(), ranks, pattern), table)}


def _hot(counts: DataFrame) -> dict[bytes, int]:
    """At most HOT words that all texts hold most often, with their training counts: all above the least power step that leaves no more."""
    step = F.floor(F.log2("seen") * 8)
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred steps
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > HOT:
            break
        least = r["step"]
    return {} if least is None else {bytes(r["word"]): r["n"] for r in counts.where(step >= least).collect()}


def scored(docs: DataFrame, learn: Column, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row. ``learn``: on doc_id, which rows teach; null counts as not.

    Null and empty texts are an end alone. Rows that repeat an id are scored each; ids are whole numbers (others raise),
    and a null id stays null. Bytes that are no UTF-8 are words of the base as they are. Without any training text
    the base gives every token the probability 1 and the model its start. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, learn, id_col, text_col)
    counts = written(word_counts(texts), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_all, least = total["n"], total["n"] + 0.5 * (total["v"] + 1) if total["n"] else 0
    hot_counts = _hot(counts)
    hot = {w: float(np.log10((c + 0.5) / least)) if least else 0.0 for w, c in hot_counts.items()}
    strange = frozenset(w for w, c in hot_counts.items() if not c)
    cls, share, table = _vocabulary(spark, counts, ranks, pattern)
    coded = _coded(texts, cls, share, hot, strange, ranks, pattern)
    sent = spark.sparkContext.broadcast(_trained(coded.where("learn"), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        model = sent.value
        for batch in batches:
            for group in lm.chunked(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _classes(batch.column(2))), 400_000, lambda r: len(r[2])):
                row, rare, own = zip(*group)
                score = (lm.text_scores(model["params"], model["fixed"], list(own)) + np.array(rare)) / lm.LOG10
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(score)], names=["row", "score"])
        give_back()

    scores = written(coded.select("row", "rare", "code").mapInArrow(run, "row long, score double"), "scores")
    rows = coded.select("row", "doc_id", "n_tokens", "n_strange", "base", F.size("cold").alias("n_cold")).join(scores, "row")
    words = coded.select("row", F.explode("cold").alias("word"))
    value = F.log10((F.col("n") + 0.5) / F.lit(float(least))) if least else F.lit(0.0)
    summed = words.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum(value).alias("more"), F.count_if(F.col("n") > 0).alias("known"))
    return rows.join(summed, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_tokens") - F.col("n_strange") - F.col("n_cold") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
