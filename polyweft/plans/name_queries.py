"""Queries written as SQL over named functions, streams as files, odor profiles, and notes as strokes and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.functions import codecs as C
from polyweft.functions import names, odors
from polyweft.operators import metrics as M
from polyweft.operators import streams
from polyweft.plans.common import MODALITY_SQL, WORDS_SQL, table, word_stream
from polyweft.plans.text_queries import _words
from polyweft.sources import bin_files, files
from polyweft.storage import shared_dir


def sql_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names.register(spark)
    return spark.sql("select conv_id, turn, size(encode_words(text)) as n_words, sha2(array_join(encode_words(text), ','), 256) as words_sha from {c}", c=table(spark, sf_dir, "conversations"))


def sql_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names.register(spark)
    return spark.sql("select word_modality(word) as modality, count(*) as n, sum(word_payload(word)) as payloads, max(word_version(word)) as version from {w} group by 1", w=word_stream(spark, sf_dir))


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams written as a file each and read again."""
    spark.dataSource.register(bin_files.WordFiles)
    at = f"{shared_dir(spark)}/polyweft/{spark.sparkContext.applicationId}/word-files-{uuid.uuid4().hex}"
    streams.to_arrays(word_stream(spark, sf_dir)).write.format("word_files").mode("append").save(at)
    back = files.read_words_binary(spark, f"{at}/*.bin")
    return back.groupBy(F.regexp_extract("path", "([^/]*)[.]bin$", 1).alias("stream_id")).agg(F.count("*").alias("n"), F.sum("word").alias("words"), F.sum(F.col("pos") * F.col("word")).alias("weighted"))


_QUALITY = [f"s_suppkey * {7 + 6 * k} % 101" for k in range(5)]
_GROUPS = "case s_suppkey % 5 when 0 then '[\"ester\",\"aromatic\"]' when 1 then '[\"Thiol \",\"amine\",\"x\",\"y\"]' when 2 then '[]' when 3 then '[\"ketone\",\"Ketone\"]' else '[\"wood\"]' end"


def odor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with keys missing, nested, flat, and both at once, as records and their words."""
    quality = "'[' || " + " || ',' || ".join(f"cast({q} as string) || 'e-2'" for q in _QUALITY) + " || ']'"
    molecule = f"'\"molecular_weight\":' || cast(s_suppkey * 13 % 300 as string) || ',\"vapor_pressure_kpa\":' || cast(s_suppkey % 4 as string) || ',\"functional_groups\":' || {_GROUPS}"
    parts = [
        f"'{{\"quality\":' || {quality}", "',\"category\":\"' || element_at(array('floral', 'Spicy-Herbal', '3', 'woody/earthy', 'PUTRID DECAY', '7', 'fruity'), cast(s_suppkey % 7 + 1 as int)) || '\"'", "if(s_suppkey % 3 = 0, '', ',\"complexity\":' || cast(s_suppkey % 130 as string) || 'e-2')",
        "if(s_suppkey % 4 = 0, '', ',\"chirality\":\"' || element_at(array('L', 'D', '+', '1'), cast(s_suppkey % 4 + 1 as int)) || '\"')", f"if(s_suppkey % 6 in (1, 2), ',\"molecular_descriptors\":{{' || {molecule} || '}}', '')", "if(s_suppkey % 6 = 5, ',\"molecular_descriptors\":{}', '')",
        f"if(s_suppkey % 6 = 3, ',' || {molecule}, '')", "if(s_suppkey % 6 = 2, ',\"molecular_weight\":999', '')", "'}'",
    ]
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(" || ".join(parts)).alias("json"))
    s = s.withColumn("p", odors.profile(F.col("json"))).withColumn("r", odors.record(F.col("p")))
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    r = lambda n: F.col(f"r.{n}")
    words = C.augmented_words(*[r(n) for n in ("category", "pleasantness", "intensity", "directions", "tree", "complexity", "chirality")])
    return s.select("s_suppkey", *[r(n).alias(n) for n in ("category", "pleasantness", "intensity", "complexity", "chirality")], told("r.directions").alias("directions"), told("r.tree").alias("tree"), F.size(words).alias("n_words"))


def note_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and rests of the customers' nations as strokes, and the grid again."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.expr("cast(c_custkey % 400 as int)").alias("start_tick"), F.expr("cast(c_custkey % 5 as int)").alias("duration_ticks"), F.expr("case when c_custkey % 7 > 0 then cast(c_custkey % 61 + 30 as int) end").alias("pitch"), F.lit(30).alias("origin"))
    s = M.grid_strokes(c.dropDuplicates(["doc_id", "start_tick", "pitch"]), anchors=True)
    back = M.strokes_grid(s.withColumn("rest", F.col("pitch").isNull()), 30).select("doc_id", "n", "duration_ticks", F.col("pitch").alias("back"))
    return s.join(back, ["doc_id", "n"]).select("doc_id", "n", "x", "y", F.size("directions").alias("steps"), "anchor", "pitch", "duration_ticks", "back")


_Q = "[" + ", ".join(f"({q}) / 100.0::double" for q in _QUALITY) + "]"
_AXIS = lambda ws: f"least(7, greatest(0, round_even((({' + '.join(f'({w}::double) * least(1.0::double, greatest(0.0::double, q[{i + 1}]))' for i, w in enumerate(ws))}) - ({sum(min(0.0, w) for w in ws)!r}::double)) / ({sum(max(0.0, w) for w in ws) - sum(min(0.0, w) for w in ws)!r}::double) * 7.0, 0)))::int"
_LISTED = lambda xs: "[" + ", ".join(map(repr, xs)) + "]"
ORACLES = {
    "sql_encode": f"with c as (select conv_id, turn, {_words('text')} as w from conversations) select conv_id, turn, len(w)::int as n_words, sha256(array_to_string(w, ',')) as words_sha from c",
    "sql_modalities": f"with {WORDS_SQL} select ({MODALITY_SQL}) as modality, count(*) as n, sum(word & 65535)::bigint as payloads, max((word >> 16) & 3)::int as version from w group by 1",
    "word_files": f"""with {WORDS_SQL}, v as (select stream_id, word, row_number() over (partition by stream_id order by pos) - 1 as pos from w where word between 0 and 1048575)
select stream_id::varchar as stream_id, count(*) as n, sum(word)::bigint as words, sum(pos * word)::bigint as weighted from v group by stream_id""",
    "odor_profiles": f"""with s as (select s_suppkey, {_Q} as q, ([0, 2, 3, 3, 7, 7, 1])[s_suppkey % 7 + 1] as category, case when s_suppkey % 3 = 0 then 0.5::double else least(1.0::double, (s_suppkey % 130) / 100.0::double) end as c0,
  case when s_suppkey % 4 = 0 then 0 else ([1, 0, 1, 1])[s_suppkey % 4 + 1] end as chirality, s_suppkey % 6 in (1, 2, 3, 5) as has, s_suppkey % 6 in (1, 2, 3) as full_,
  case when s_suppkey % 6 in (1, 2, 3) then (s_suppkey * 13 % 300)::double else 0 end as weight, case when s_suppkey % 6 in (1, 2, 3) then (s_suppkey % 4)::double else 0 end as vapor,
  case when s_suppkey % 6 in (1, 2, 3) then ([['ester', 'aromatic'], ['thiol', 'amine', 'x', 'y'], [], ['ketone'], ['wood']])[s_suppkey % 5 + 1] else [] end as g from supplier),
a as (select *, {_AXIS(C.PLEASANT_WEIGHTS)} as p, {_AXIS(C.INTENSE_WEIGHTS)} as i, list_sort(list_transform(range(0, 5), lambda k: {{'less': -q[k + 1], 'channel': k}})) as ranked,
  case when has then least(1.0::double, greatest(0.0::double, 0.5::double * c0 + 0.5::double * greatest(0.0::double, least(1.0::double, 0.55::double * (least(6.0::double, len(g)::double) / 6.0::double) + 0.35::double * least(1.0::double, weight / 220.0::double) + case when list_contains(g, 'aromatic') then 0.15::double else 0.0::double end)))) else c0 end as c from s),
b as (select *, least(15, greatest(0, round_even(c / 1.0::double * 15.0::double, 0)))::int as fine, ({_LISTED(odors.BY_SECOND)})[ranked[2].channel + 1] as second, len(g) + list_contains(g, 'aromatic')::int + (weight >= 150)::int as score from a)
select s_suppkey, category, p as pleasantness, i as intensity, fine as complexity, chirality,
  concat_ws(',', case when i >= 5 then 2 when i >= 3 then 1 else 0 end, ({_LISTED(odors.BY_FIRST)})[ranked[1].channel + 1], case when c >= 0.66 then 4 when c <= 0.33 then 0 else second end, case when ranked[2].less - ranked[1].less < 0.08 then second when p >= 5 and c <= 0.45 then 7 when p <= 2 then 5 else 6 end) as directions,
  case when full_ and (weight > 0 or vapor > 0 or len(g) > 0) then concat_ws(',', case when list_has_any(g, {list(C.AVERSIVE)}) then 0 when list_has_any(g, {list(C.PLEASANT)}) or p >= 4 then 1 else 0 end, case when vapor >= 1.6 then 2 else 3 end, case when score <= 2 then 0 when score <= 4 then 1 else 2 end)
  else concat_ws(',', case when p >= 4 then 1 else 0 end, case when i >= 4 then 2 else 3 end, case when fine <= 5 then 0 when fine <= 10 then 1 else 2 end) end as tree, 8 as n_words from b""",
    "note_strokes": """with c as (select distinct c_nationkey as doc_id, (c_custkey % 400)::int as x, case when c_custkey % 7 > 0 then (c_custkey % 61 + 30)::int end as pitch from customer), d as (select doc_id, x, pitch, x % 5 as d from c)
select doc_id, (row_number() over (partition by doc_id order by x, coalesce(pitch, -1)) - 1)::int as n, x, coalesce(pitch - 30, 0)::int as y, greatest(1, d)::int as steps, case when x <= 127 then x end as anchor, pitch, greatest(1, d)::int as duration_ticks, pitch as back from d""",
}
QUERIES = {f.__name__: f for f in (sql_encode, sql_modalities, word_files, odor_profiles, note_strokes)}
