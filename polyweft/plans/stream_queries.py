"""Queries over word streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.functions import words as W
from polyweft.operators import streams as S
from polyweft.plans.common import CLASSIFIED_SQL, MODALITY_SQL, WORDS_SQL, word_stream


def word_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_stream(spark, sf_dir)
    return w.where(W.in_range("word")).groupBy(W.mode("word").alias("mode"), W.version("word").alias("version"), W.payload("word").alias("payload")).agg(F.count(F.lit(1)).alias("n"))


def word_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_stream(spark, sf_dir).where(W.in_range("word"))
    n = lambda c, name: F.count_if(c).alias(name)
    return w.groupBy("stream_id").agg(
        n(W.is_image_payload("word"), "image_payload"), n(W.is_image_family("word", W.IMAGE_ENHANCED), "enhanced"), n(W.is_image_family("word", W.IMAGE_LEGACY), "legacy"),
        n(W.is_visual("word"), "visual"), n(W.is_diagram_header("word"), "header"), n(W.is_music_range("word"), "music_range"), n(W.is_taste_bit("word"), "taste_bit"),
    )


def classify_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_stream(spark, sf_dir).where(W.in_range("word")).groupBy("word", W.modality("word").alias("modality")).agg(F.count(F.lit(1)).alias("n"))


def classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.counts(S.dispatched(word_stream(spark, sf_dir)))


def modality_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.ratios(S.counts(S.dispatched(word_stream(spark, sf_dir))))
    return out.select("stream_id", *[F.rint(F.col(f"r_{m}") * 1e9).cast("long").alias(f"r_{m}") for m in W.LABELS])


def iterate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dispatched(word_stream(spark, sf_dir)).where("modality is not null").select("stream_id", "pos", "modality", "word")


def taste_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.blocks(S.dispatched(word_stream(spark, sf_dir))).where("modality = 'taste'")
    return found.groupBy(F.size("words").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def chunk_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(S.dispatched(word_stream(spark, sf_dir))).select("stream_id", "modality", "block", "start", F.array_join(F.transform("words", lambda w: w.cast("string")), ",").alias("words"))


def filter_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.only(S.dispatched(word_stream(spark, sf_dir)), "image").select("stream_id", "pos", "word")


def remove_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without(S.dispatched(word_stream(spark, sf_dir)), "diagram").select("stream_id", "pos", "word")


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_stream(spark, sf_dir)
    bad = w.where("word is null or word > 1048575 or word < 0")
    told = F.when(F.col("word").isNull(), F.concat(F.lit("index "), F.col("pos"), F.lit(": non-int word"))).otherwise(F.concat(F.lit("index "), F.col("pos"), F.lit(": word out of range "), F.col("word")))
    return bad.select("stream_id", "pos", told.alias("error"))


def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validation(word_stream(spark, sf_dir)).select("stream_id", "valid", F.size("errors").cast("long").alias("n_errors"), F.sha2(F.array_join("errors", "|"), 256).alias("errors_sha"))


def stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.texts_safe(S.dispatched(word_stream(spark, sf_dir)))
    return out.select("stream_id", "text", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"), F.col("dropped").cast("long").alias("dropped"))


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(word_stream(spark, sf_dir)).select("stream_id", "total_words", "n_text", "n_taste", "valid", F.size("errors").cast("long").alias("n_errors"))


def mode_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.mode_shares(word_stream(spark, sf_dir).where(W.in_range("word")))
    return out.select("stream_id", *[F.rint(F.col(c) * 1e9).cast("long").alias(c) for c in ("normal", "escape", "extension", "reserved")], "reserved_non_mental")


def prefix_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.checkpoints(S.dispatched(word_stream(spark, sf_dir)), 8)
    return out.select("stream_id", F.col("n").cast("long"), "n_text", "n_image", "n_taste", "transitions", F.rint(F.col("segment_length") * 1e6).cast("long").alias("segment_length"))


def union_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_stream(spark, sf_dir).where(W.in_range("word"))
    c = S.dispatched(w)
    return S.concatenated([S.only(c, "text"), S.only(c, "music")]).select("stream_id", F.col("pos").cast("long"), "word")


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_stream(spark, sf_dir).where(W.in_range("word")).select("stream_id", "pos", W.mode("word").alias("mode"))
    return S.runs(w, "stream_id", "pos", "mode", 3).select("stream_id", F.col("start").cast("long"), "mode", F.col("length").cast("long"))


def runs_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_stream(spark, sf_dir).where(W.in_range("word")).select("stream_id", "pos", W.mode("word").alias("mode"))
    return S.exploded_runs(S.runs(w, "stream_id", "pos", "mode", 3), "mode").groupBy("stream_id", "mode").agg(F.count(F.lit(1)).alias("n"))


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_arrays(word_stream(spark, sf_dir).where("word is not null")).select("stream_id", W.json_text(F.col("words")).alias("json"))


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams as JSON with a string, a fraction and a boolean among the words, and read back."""
    w = word_stream(spark, sf_dir)
    cell = F.when(F.col("pos") % 11 == 3, F.lit('"x"')).when(F.col("pos") % 11 == 5, F.lit("3.5")).when(F.col("pos") % 11 == 7, F.lit("true")).when(F.col("word").isNull(), F.lit("null")).otherwise(F.col("word").cast("string"))
    made = w.withColumn("cell", cell).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cell"))).alias("cells"))
    read = S.from_json(made.select("stream_id", F.concat(F.lit("["), F.array_join(F.transform("cells", lambda c: c["cell"]), ","), F.lit("]")).alias("json")))
    return read.where("word is not null").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pos") + 1) * F.col("word").cast("long")).alias("check"))


def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = S.to_arrays(word_stream(spark, sf_dir).where("word is not null"))
    out = arrays.withColumn("bytes", W.transport_bytes(F.col("words")))
    back = out.withColumn("back", W.from_transport_bytes(F.concat(F.col("bytes"), F.unhex(F.lit("00FF")))))
    return back.select("stream_id", F.lower(F.hex("bytes")).alias("bytes"), F.size("back").cast("long").alias("n_back"))


def stream_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_arrays(word_stream(spark, sf_dir).where(W.in_range("word"))).select("stream_id", W.digest(F.col("words")).alias("sha"))


_LABEL_COUNTS = ", ".join(f"count(*) filter (modality = '{m}') as n_{m}" for m in W.LABELS)
_VALID = "word between 0 and 1048575"
_ISLANDS = """, q as (select *, case when coalesce(modality, '') = lag(coalesce(modality, '')) over (partition by stream_id order by pos) then 0 else 1 end as ch from c),
isl as (select *, sum(ch) over (partition by stream_id order by pos) as island from q),
b as (select stream_id, modality, island, min(pos) as start, string_agg(word::varchar, ',' order by pos) as words, count(*) as length from isl where modality not in ('text', 'bpe') group by all)"""
_OWN = "(word < 128 and (word in (9, 10, 13) or word between 32 and 126) or word in (223, 248, 216, 230, 198, 339, 338, 225, 233, 237, 243, 250, 224, 232, 236, 242, 249, 226, 234, 238, 244, 251, 228, 235, 239, 246, 252, 241, 231, 193, 201, 205, 211, 218, 209, 199))"
_READABLE = f"({_OWN} or (word >> 16) = 4)"
_RUNS = f""", x as (select stream_id, pos, (word >> 18) & 3 as mode from w where {_VALID}),
y as (select *, row_number() over o - 1 as n, case when mode = lag(mode) over o then 0 else 1 end as ch from x window o as (partition by stream_id order by pos)),
z as (select *, sum(ch) over (partition by stream_id order by pos) as run from y),
g as (select stream_id, run, any_value(mode) as mode, min(n) as start, count(*) as total from z group by stream_id, run),
cut as (select stream_id, start + k * 3 as start, mode, least(3, total - k * 3) as length from g, lateral (select unnest(range(0, (total + 2) // 3)) as k))"""

ORACLES = {
    "word_fields": f"with {WORDS_SQL} select (word >> 18) & 3 as mode, (word >> 16) & 3 as version, word & 65535 as payload, count(*) as n from w where {_VALID} group by all",
    "word_predicates": f"""with {WORDS_SQL}, m as (select *, (word >> 18) & 3 = 2 as ext, (word >> 16) & 3 = 0 as v0 from w where {_VALID})
select stream_id, count(*) filter (word & 3072 = 1024) as image_payload, count(*) filter (ext and v0 and word & 3072 = 1024) as enhanced, count(*) filter (ext and v0 and word & 3072 = 2048) as legacy,
count(*) filter (ext and word & 32768 != 0) as visual, count(*) filter (ext and word & 32768 != 0 and (word >> 10) & 3 = 3 and word & 1 != 0 and word & 2048 = 0) as header, count(*) filter (word between 196608 and 262143) as music_range, count(*) filter (ext and word & 1024 != 0) as taste_bit from m group by stream_id""",
    "classify_single": f"with {WORDS_SQL} select word, {MODALITY_SQL} as modality, count(*) as n from w where {_VALID} group by all",
    "classify_counts": f"with {CLASSIFIED_SQL} select stream_id, {_LABEL_COUNTS}, count(modality) as total_words from c group by stream_id",
    "modality_ratios": f"with {CLASSIFIED_SQL} select stream_id, "
    + ", ".join(f"cast(round_even(coalesce(count(*) filter (modality = '{m}') / nullif(count(modality), 0)::double, 0) * 1e9, 0) as bigint) as r_{m}" for m in W.LABELS)
    + " from c group by stream_id",
    "iterate_stream": f"with {CLASSIFIED_SQL} select stream_id, pos, modality, word from c where modality is not null",
    "taste_sequences": f"with {CLASSIFIED_SQL} {_ISLANDS} select length, count(*) as n from b where modality = 'taste' group by length",
    "chunk_islands": f"with {CLASSIFIED_SQL} {_ISLANDS} select stream_id, modality, (row_number() over (partition by stream_id, modality order by start) - 1)::int as block, start, words from b",
    "filter_modality": f"with {CLASSIFIED_SQL} select stream_id, pos, word from c where modality = 'image'",
    "remove_modality": f"with {CLASSIFIED_SQL} select stream_id, pos, word from c where modality != 'diagram'",
    "validation_errors": f"with {WORDS_SQL} select stream_id, pos, case when word is null then 'index ' || pos || ': non-int word' else 'index ' || pos || ': word out of range ' || word end as error from w where word is null or word not between 0 and 1048575",
    "stream_validation": f"""with {CLASSIFIED_SQL}, e as (select stream_id, pos, case when word is null then 'index ' || pos || ': non-int word' when word not between 0 and 1048575 then 'index ' || pos || ': word out of range ' || word end as m from c),
u as (select stream_id, count(*) filter (modality = 'text' and not {_READABLE}) > 0 as unread from c group by stream_id),
l as (select stream_id, list(m order by pos) filter (m is not null) as es from e group by stream_id),
a as (select stream_id, list_concat(coalesce(es, []), case when unread then ['text: malformed words'] else [] end) as errors from l join u using (stream_id))
select stream_id, len(errors) = 0 as valid, len(errors) as n_errors, sha256(array_to_string(errors, '|')) as errors_sha from a""",
    "stream_summary": f"""with {CLASSIFIED_SQL}, u as (select stream_id, count(*) filter (modality = 'text' and not {_READABLE}) > 0 as unread, count(*) filter (modality is null) as bad, count(modality) as total_words, count(*) filter (modality = 'text') as n_text, count(*) filter (modality = 'taste') as n_taste from c group by stream_id)
select stream_id, total_words, n_text, n_taste, bad = 0 and not unread as valid, bad + unread::int as n_errors from u""",
    "mode_shares": f"with {WORDS_SQL}, m as (select stream_id, word, (word >> 18) & 3 as k from w where {_VALID}) select stream_id, "
    + ", ".join(f"cast(round_even(count(*) filter (k = {k}) / count(*)::double * 1e9, 0) as bigint) as {n}" for k, n in enumerate(("normal", "escape", "extension", "reserved")))
    + ", count(*) filter (k = 3 and word & 256 = 0) as reserved_non_mental from m group by stream_id",
    "prefix_checkpoints": f"""with {CLASSIFIED_SQL}, d as (select *, row_number() over o as n, count(*) over (partition by stream_id) as total, case when modality != lag(modality) over o then 1 else 0 end as ch from c where modality is not null window o as (partition by stream_id order by pos)),
k as (select stream_id, n, total, sum((modality = 'text')::int) over o as n_text, sum((modality = 'image')::int) over o as n_image, sum((modality = 'taste')::int) over o as n_taste, sum(ch) over o as transitions from d window o as (partition by stream_id order by pos))
select stream_id, n, n_text, n_image, n_taste, transitions, cast(round_even(n / (transitions + 1)::double * 1e6, 0) as bigint) as segment_length from k where n = total or n * 8 // total != (n - 1) * 8 // total""",
    "union_streams": f"""with {CLASSIFIED_SQL.replace('select stream_id, pos::int as pos, cast(case', 'select * from (select stream_id, pos::int as pos, cast(case', 1).replace('end as int) as word from ev)', 'end as int) as word from ev) where word between 0 and 1048575)', 1)},
k as (select stream_id, 0 as part, pos, word from c where modality = 'text' union all select stream_id, 1, pos, word from c where modality = 'music')
select stream_id, row_number() over (partition by stream_id order by part, pos) - 1 as pos, word from k""",
    "word_runs": f"with {WORDS_SQL} {_RUNS} select stream_id, start, mode, length from cut",
    "runs_back": f"with {WORDS_SQL} {_RUNS} select stream_id, mode, sum(length)::bigint as n from cut group by all",
    "json_sink": f"with {WORDS_SQL} select stream_id, '[' || coalesce(string_agg(case when {_VALID} then word::varchar end, ', ' order by pos), '') || ']' as json from w where word is not null group by stream_id",
    "json_source": f"with {WORDS_SQL} select stream_id, count(*) as n, sum((pos + 1) * word::bigint)::bigint as check from w where {_VALID} and pos % 11 not in (3, 5, 7) group by stream_id",
    "binary_roundtrip": f"with {WORDS_SQL} select stream_id, lower(coalesce(string_agg(lpad(to_hex(word), 8, '0'), '' order by pos) filter ({_VALID}), '')) as bytes, count(*) filter ({_VALID}) as n_back from w where word is not null group by stream_id",
    "stream_hash": f"with {WORDS_SQL} select stream_id, sha256('[' || string_agg(word::varchar, ',' order by pos) || ']') as sha from w where {_VALID} group by stream_id",
}
QUERIES = {
    f.__name__: f
    for f in (
        word_fields, word_predicates, classify_single, classify_counts, modality_ratios, iterate_stream, taste_sequences, chunk_islands, filter_modality, remove_modality, validation_errors,
        stream_validation, stream_text, stream_summary, mode_shares, prefix_checkpoints, union_streams, word_runs, runs_back, json_sink, json_source, binary_roundtrip, stream_hash,
    )
}
