"""All named queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyweft.plans import codec_queries, family_queries, macro_queries, metric_queries, mixed_queries, name_queries, range_queries, raster_queries, stream_queries, stream_session_queries, text_queries

MODULES = (text_queries, stream_queries, codec_queries, metric_queries, stream_session_queries, mixed_queries, range_queries, macro_queries, family_queries, raster_queries, name_queries)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
