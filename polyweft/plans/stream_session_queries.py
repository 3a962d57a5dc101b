"""Queries over chunked sessions and over documents of the modalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.functions import text as T
from polyweft.operators.streams import to_arrays
from polyweft.functions import words as W
from polyweft.plans.common import table, word_stream, WORDS_SQL
from polyweft.sources import files
from polyweft.storage import written
from polyweft.streaming import sessions as S


def _chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("session"), F.posexplode(T.split_text(F.col("text"), size)).alias("idx", "text"))
    return c


def session_finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.sessions(S.encoded_chunks(_chunks(spark, sf_dir, 16)))
    return out.select("session", F.col("chunks").cast("long").alias("chunks"), "text_sha")


def session_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.sessions(S.encoded_chunks(_chunks(spark, sf_dir, 7)))
    return out.select("session", "token_mismatch")


def session_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces decoded one by one, whole again."""
    out = S.decoded_chunks(written(S.encoded_chunks(_chunks(spark, sf_dir, 8)), "chunks"))
    return out.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "").alias("t")).select("session", F.sha2("t", 256).alias("sha"))


def svg_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of parts, sampled, scaled and counted."""
    p = table(spark, sf_dir, "part")
    svg = F.concat(F.lit('<svg><polygon stroke="#00ffff" points="0,0 '), (F.col("p_size") + 10).cast("string"), F.lit(",0 0,"), (F.col("p_partkey") % 40 + 5).cast("string"), F.lit('"/></svg>'))
    pts = files.svg_points(p.select("p_partkey", svg.alias("svg")), "p_partkey", "svg")
    r = lambda c, n: F.rint(c * 1e6).cast("long").alias(n)
    return pts.groupBy("p_partkey").agg(r(F.min("x"), "x0"), r(F.max("x"), "x1"), r(F.min("y"), "y0"), r(F.max("y"), "y1"), F.max("stroke").alias("stroke"))


def gzip_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams smaller as gzip than as they are."""
    a = to_arrays(word_stream(spark, sf_dir).where("word is not null")).select("stream_id", W.transport_bytes(F.col("words")).alias("b"))
    return a.select("stream_id", F.octet_length("b").cast("long").alias("size"), (files.compressed_size(F.col("b")) < F.octet_length("b")).alias("smaller"))


from polyweft.plans.text_queries import _words  # noqa: E402

_CH = lambda n: f"c as (select conv_id || '-' || turn as session, text, unnest(range(0, greatest((length(text) + {n - 1}) // {n}, 1))) as k from conversations), p as (select session, k, substr(text, 1 + k * {n}, {n}) as piece from c)"
ORACLES = {
    "session_finalise": "select conv_id || '-' || turn as session, greatest((length(text) + 15) // 16, 1) as chunks, sha256(text) as text_sha from conversations",
    "session_mismatches": f"with {_CH(7)}, e as (select session, flatten(list({_words('piece')} order by k)) as a from p group by session), w as (select conv_id || '-' || turn as session, {_words('text')} as b from conversations) select session, (a != b)::int as token_mismatch from e join w using (session)",
    "session_decode": "select conv_id || '-' || turn as session, sha256(text) as sha from conversations",
    "svg_draw": """with p as (select p_partkey, (p_size + 10)::double as w, (p_partkey % 40 + 5)::double as h from part)
select p_partkey, 4000000::bigint as x0, cast(round_even((w * (248.0::double / greatest(w, h)) + 4) * 1e6, 0) as bigint) as x1, 4000000::bigint as y0, cast(round_even((h * (248.0::double / greatest(w, h)) + 4) * 1e6, 0) as bigint) as y1, '#00ffff' as stroke from p""",
}
QUERIES = {f.__name__: f for f in (session_finalise, session_mismatches, session_decode, svg_draw, gzip_sizes)}
