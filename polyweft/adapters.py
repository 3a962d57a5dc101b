"""Batches for models: words as input ids with an attention mask, as a stage of a pipeline."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.functions import text as T


def encode_text(text: Column) -> Column:
    """A text's input ids."""
    return T.encode(text)


def decode_words(words: Column) -> Column:
    """The text of input ids of a stored column; null if they are none."""
    return T.decode(words)


class WordBatches(Transformer):
    """Adds input_ids and attention_mask: the text's words, cut to ``max_length`` and padded to ``pad_to`` with ``pad`` under a mask of 0."""

    def __init__(self, text_col: str = "text", max_length: int | None = None, pad_to: int | None = None, pad: int = 0):
        super().__init__()
        if any(n is not None and n < 1 for n in (max_length, pad_to)):
            raise ValueError("lengths must be positive")
        self.text_col, self.max_length, self.pad_to, self.pad = text_col, max_length, pad_to, pad

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ids = encode_text(F.col(self.text_col))
        made = dataset.withColumn("input_ids", F.slice(ids, 1, self.max_length) if self.max_length else ids)
        ones, more = F.array_repeat(F.lit(1), F.size("input_ids")), F.greatest(F.lit(self.pad_to or 0) - F.size("input_ids"), F.lit(0))
        filled = lambda xs, v: F.concat(xs, F.array_repeat(F.lit(v), more))
        return made.withColumn("attention_mask", filled(ones, 0)).withColumn("input_ids", filled(F.col("input_ids"), self.pad))
