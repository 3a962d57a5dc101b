"""Quality as a regularised quadratic discriminant over transformed document statistics.

A class is a normal density of the statistics; its covariance shrinks towards that of both classes and that
towards its diagonal. The score is the logistic of the difference of log densities, from Mahalanobis distances
by Cholesky factors that are made once, and of log priors. Moments of the labelled rows are summed where the
rows are, over all of them; what the driver gets is one row of sums per class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.llm.common import free_name, let_go, remainder, text_of, written

_UPPER, _LOWER, _DIGIT = (np.arange(a, b + 1) for a, b in ((65, 90), (97, 122), (48, 57)))
_SIGNS = np.frombuffer(b"#$%&*", np.uint8)
_OTHER = np.frombuffer(b"\"'()+-/:;<=>?@[\\]^_`{}~", np.uint8)
NAMES = ("log_bytes", "log_words", "log_word_length", "upper", "digit", "signs", "bang", "bar", "stop", "comma", "other", "newline", "beyond_ascii", "distinct_words", "log_line_length", "repeated_lines", "longest_word", "upper_words", "top_word")
#: Shares of the pooled covariance in a class's, and of the diagonal in the pooled; the least variance.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.3, 0.1, 0.01


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics of one text; shares enter by their square roots, sizes by logarithms. Empty texts have zeros."""
    n = len(text)
    if not n:
        return (0.0,) * len(NAMES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.split(b"\n")
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    k = max(1, len(words))
    share = lambda x, of=n: float(np.sqrt(x / of))
    return (
        np.log1p(n), np.log1p(len(words)), np.log(n / k), share(count[_UPPER].sum()), share(count[_DIGIT].sum()), share(count[_SIGNS].sum()), share(count[33]), share(count[124]), share(count[46]),
        share(count[44]), share(count[_OTHER].sum()), share(count[10]), share(count[128:].sum()), len(seen) / k, np.log(n / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(max(map(len, seen), default=0)),
        share(sum(v for w, v in seen.items() if w.isupper()), k), max(seen.values(), default=0) / k,
    )


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        d = [self.offsets[k] - 0.5 * (((z - self.centres[k]) @ self.inverses[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From per class: number, sum and sum of outer products. A class without rows takes the other's place with a prior of half a row."""
    n_vars = len(NAMES)
    total = sum(m[0] for m in moments.values())
    if not total:
        return Discriminant(np.zeros(n_vars), np.ones(n_vars), np.zeros((2, n_vars)), np.stack([np.eye(n_vars)] * 2), np.zeros(2))
    mean = sum(m[1] for m in moments.values()) / total
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / total - mean**2, FLOOR))
    none = (0.0, np.zeros(n_vars), np.zeros((n_vars, n_vars)))
    within, centres, numbers = [], [], []
    for k in (0, 1):
        n, s, ss = moments.get(k, none)
        centre = s / n if n else mean
        cov = ss / n - np.outer(centre, centre) if n else np.zeros((n_vars, n_vars))
        within.append(cov / np.outer(scale, scale))
        centres.append((centre - mean) / scale)
        numbers.append(n)
    pooled = sum(n * c for n, c in zip(numbers, within)) / total
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(n_vars)
    inverses, offsets = [], []
    for n, c in zip(numbers, within):
        lower = np.linalg.cholesky((1 - TO_POOLED) * c + TO_POOLED * pooled + FLOOR * np.eye(n_vars)) if n else np.linalg.cholesky(pooled)
        inverses.append(np.linalg.inv(lower))
        offsets.append(np.log((n + 0.5) / (total + 1)) - np.log(np.diag(lower)).sum())
    return Discriminant(mean, scale, np.array(centres), np.array(inverses), np.array(offsets))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class of ``rows`` (x, label): number, sum, outer products; summed per task, then by position."""
    n_vars = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + n_vars + n_vars * n_vars))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_vars)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                z = x[y == k]
                sums[k] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["label", "v"])

    summed = rows.select("x", F.col("label").cast("int")).mapInArrow(run, "label int, v array<double>").select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.sum("col").alias("v"))
    out = {k: np.zeros(1 + n_vars + n_vars * n_vars) for k in (0, 1)}
    for r in summed.collect():  # two classes of a fixed number of sums
        out[r["label"]][r["pos"]] = r["v"]
    return {k: (v[0], v[1 : 1 + n_vars], v[1 + n_vars :].reshape(n_vars, n_vars)) for k, v in out.items() if v[0]}


def _learnt(x: DataFrame, labels: DataFrame, learn: Column | None, id_col: str, label_col: str) -> Discriminant:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    if learn is not None:
        known = known.where(learn)
    return fit(moments(x.join(known, "doc_id")))


def scored(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches the threshold) of every row.

    ``learn``: which ids may be learnt from. Null and empty texts have statistics of zero and a score like others.
    Rows that repeat an id are scored each; null labels and labels of no document teach nothing, and of several
    labels of an id the largest holds. Without any labelled row every score is 0.5. Ids are whole numbers (others
    raise); a null id is scored and never learnt from. An empty table gives no rows. Statistics are taken from
    whole texts once and written; learning then joins small rows only.
    """
    x = written(measured(docs, id_col, text_col), "statistics")
    model = _learnt(x, labels, learn, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            s = model.score(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return x.mapInArrow(run, "doc_id long, score double, predicted int")


class Rating(NamedTuple):
    """A score of texts in two steps: what is measured in a text, and from rows (doc_id, measure) the function that scores a measure."""

    measure: Callable[[Column], Column]
    learnt: Callable[[DataFrame], Callable[[Column], Column]]


def rating(labels: DataFrame, learn: Column | None = None, label_col: str = "quality") -> Rating:
    """The classifier as a ``Rating``: texts are measured where they are, and only their statistics meet the labels. Null texts count as empty."""

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        found = pd.Series([statistics(t or b"") for t in texts])
        let_go()
        return found

    def learnt(rows: DataFrame) -> Callable[[Column], Column]:
        model = _learnt(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("measure").alias("x")), labels, learn, "doc_id", label_col)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.array(list(x), np.float64).reshape(-1, len(NAMES))))

        return score

    return Rating(lambda text: measure(text.cast("binary")), learnt)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 0


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text reaches the threshold; columns as they were.

    Each row is judged where it stands and by its own text, so rows without an id go as others do, and of rows that
    share an id some may go and some stay. Null texts count as empty. Texts are measured once to learn and once to judge.
    """
    judge = rating(labels, ~held_out(F.col("doc_id")))
    (x,) = free_name(docs, "quality_measure")
    rows = docs.withColumn(x, judge.measure(text_of(text_col)))
    score = judge.learnt(rows.select(F.col(id_col).alias("doc_id"), F.col(x).alias("measure")))
    return rows.where(score(F.col(x)) >= threshold).select(*docs.columns)
