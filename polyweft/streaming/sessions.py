"""Incremental encoding with Structured Streaming: chunks in, words out, sessions compared with their whole text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweft.functions import text as T


def encoded_chunks(chunks: DataFrame) -> DataFrame:
    """(session, idx, text, words) of a batch or streaming frame (session, idx, text): each chunk by itself, without state."""
    return chunks.select("session", "idx", "text", T.encode(F.col("text")).alias("words"))


def decoded_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("session", "idx", T.decode(F.col("words")).alias("text"))


def sessions(encoded: DataFrame) -> DataFrame:
    """(session, chunks, text, text_sha, token_mismatch): a session's chunks in order, against the encoding of the whole.

    Runs as a batch and, in complete or update mode, as a stream. Words differ where a cut falls into a run of
    escapes of odd length or before a combining mark.
    """
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text", "words")))
    joined = encoded.groupBy("session").agg(ordered.alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["text"]), "")
    out = joined.select("session", F.size("c").alias("chunks"), whole.alias("text"), F.flatten(F.transform("c", lambda x: x["words"])).alias("words"))
    return out.select("session", "chunks", "text", F.sha2("text", 256).alias("text_sha"), (F.col("words") != T.encode(F.col("text"))).cast("int").alias("token_mismatch"))


STATE = "next long, words long"


def counted(chunks: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """(session, idx, total) of a stream (session, text): chunks numbered in order of arrival, with the characters so far.

    The state of a session is two numbers and ends ``timeout_ms`` after its last chunk.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0)
        out = []
        for batch in batches:
            for text in batch["text"]:
                total += len(text or "")
                out.append((key[0], n, total))
                n += 1
        state.update((n, total))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["session", "idx", "total"])

    return chunks.groupBy("session").applyInPandasWithState(step, "session string, idx long, total long", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events of a stream (ts, event_type) counted by windows of event time, with a bound for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
