"""Queries over whole streams of several modalities, strokes, traces and model batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.adapters import WordBatches
from polyweft.functions import strokes as K
from polyweft.operators import metrics as M
from polyweft.operators import mixed, streams
from polyweft.plans.common import CLASSIFIED_SQL, table, word_stream
from polyweft.plans.text_queries import _words

_told = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")
_PHONEMES = ("AA", "P", "CH", "S", "N", "L", "W", "SP")
_TRENDS = ("UP", "DOWN", "LEVEL")
_pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def full_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams decoded whole: raw words, blocks of each modality, taste events of the first block. No image of the sample paints."""
    d = mixed.decoded(word_stream(spark, sf_dir))
    n = lambda m: F.size(f"{m}_blocks").alias(m)
    return d.select("stream_id", "word_count", *[n(m) for m in mixed.READERS], F.col("n_image"), F.size("tokens").alias("tokens"))


def built_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as streams of text, tokens, touch, smell and taste, built in that order and decoded again."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    event = F.struct((k % 8).alias("dominant"), (k % 5).alias("secondary"), (k % 7).alias("intensity"), (k % 3).alias("direction"), F.array((k % 200).cast("int")).alias("temporal"), F.array((k % 100).cast("int")).alias("flavor"))
    small = lambda n: (k % n).cast("int")
    b = mixed.Builder().text(F.col("o_orderpriority")).tokens(F.array(small(4096), small(77))).touch(small(4), small(16), F.array(small(8), F.lit(1)), F.array(F.lit(3))).smell(small(8), small(6), small(5), F.array(small(8), F.lit(2))).taste(F.array(event))
    made = o.select(k.alias("stream_id"), b.build().alias("words"))
    d = mixed.decoded(streams.from_arrays(made))
    touch, smell, taste = (F.get(f"{m}_blocks", F.lit(0))["value"] for m in ("touch", "smell", "taste"))
    first = lambda blocks: F.get(blocks, F.lit(0))
    return d.select(
        "stream_id", "text", _told("tokens").alias("tokens"), "valid", "word_count", first(touch)["region"].alias("region"), _told(first(smell)["directions"]).alias("steps"),
        first(taste)["dominant"].alias("dominant"), _told(first(taste)["temporal"]).alias("temporal"),
    )


def anchored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k, size = F.col("p_partkey"), F.col("p_size")
    points = F.array(point(k % 9, size % 7), point(k % 31, size % 11), point(F.lit(5), k % 13))
    s = p.select("p_partkey", F.posexplode(K.anchored_segments(points)).alias("side", "s"))
    return s.select("p_partkey", "side", F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.size("s.directions").alias("steps"))


def timeline_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    s = K.voice_stroke(_pick(_PHONEMES, k), k % 2 == 0, _pick(_TRENDS, k), k % 100, k % 6)
    t = c.select("c_custkey", s.alias("s"))
    return t.select("c_custkey", F.col("s.lane").alias("lane"), _told("s.directions").alias("directions"), K.voice_span(F.col("s"))["start"].alias("start"), K.voice_span(F.col("s"))["duration"].alias("duration"))


def anchored_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    small = lambda n: (k % n).cast("int")
    at = K.anchor(small(16), small(9) - 4, small(7) - 3)
    w = s.select("s_suppkey", K.anchored_touch_words(at, small(4), small(16), F.array(small(8), F.lit(6)), F.array(F.lit(3), small(7))).alias("words"))
    back = w.withColumn("b", K.anchored_touch(F.col("words")))
    return back.select("s_suppkey", _told("words").alias("words"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.stroke.region").alias("region"))


def touch_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    t = p.select("p_partkey", K.contour_trace(k % 3).alias("c"), K.press_trace((k % 8).cast("int"), k % 6).alias("p"))
    return t.select("p_partkey", F.size("c.directions").alias("loop"), F.size(F.filter("c.pressures", lambda v: v == 4)).alias("fours"), _told("p.directions").alias("press"), _told("p.pressures").alias("pressures"))


def receptor_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts by what their receptor carries; the dimension has four rows."""
    dim = spark.createDataFrame([(i, *r) for i, r in enumerate(K.RECEPTORS)], "receptor int, name string, direction boolean, pressure boolean, vibration boolean")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).cast("int").alias("receptor"))
    return c.join(F.broadcast(dim), "receptor").groupBy("name", "direction", "pressure", "vibration").agg(F.count(F.lit(1)).alias("n"))


def time_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return M.time_steps(e.select("user_id", (k % 24 / _pick((1.0, 2.0, 3.0, 4.0), k)).alias("onset"), (k % 5 / _pick((2.0, 6.0, 8.0), k)).alias("duration")), "user_id").select("user_id", F.rint(1 / F.col("step")).cast("long").alias("per_quarter"))


def max_angle_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyweft.functions import codecs as C

    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 14).alias("joint"), "c_custkey", F.expr("c_custkey * 37 % 1801 / 10.0D").alias("angle"))
    back = c.withColumn("angle", C.joint_angle(C.joint_quantum(F.col("angle"))))
    return M.max_error(c, back, "joint", "c_custkey", "angle").select("joint", F.rint(F.col("max_error") * 1e6).cast("long").alias("max_error"))


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = WordBatches(max_length=64, pad_to=64).transform(c)
    return b.select("conv_id", "turn", F.sha2(_told("input_ids"), 256).alias("ids_sha"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), F.size("attention_mask").alias("length"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + "]"
_BLOCKS = ", ".join(f"count(*) filter (modality = '{m}' and opens){' * 0' if m == 'image' else ''} as {m}" for m in mixed.READERS)
_GCD = lambda a, b: f"({b} / gcd({a}, {b}))::int"
ORACLES = {
    "full_decode": f"""with {CLASSIFIED_SQL}, p as (select *, coalesce(modality, '') != coalesce(lag(coalesce(modality, '')) over (partition by stream_id order by pos), '?') as opens from c)
select stream_id, count(*) as word_count, {_BLOCKS}, count(*) filter (modality = 'image') as n_image, count(*) filter (modality = 'bpe')::int as tokens from p group by stream_id""",
    "built_streams": """select o_orderkey as stream_id, o_orderpriority as text, (o_orderkey % 4096) || ',' || (o_orderkey % 77) as tokens, true as valid, length(o_orderpriority) + 2 + 3 + 4 + 4 as word_count,
(o_orderkey % 16)::int as region, (o_orderkey % 8) || ',2' as steps, (o_orderkey % 8)::int as dominant, (o_orderkey % 200)::varchar as temporal from orders""",
    "anchored_segments": """with p as (select p_partkey, [p_partkey % 9, p_partkey % 31, 5] as xs, [p_size % 7, p_size % 11, p_partkey % 13] as ys from part), s as (select *, unnest([0, 1]) as side from p)
select p_partkey, side, xs[side + 1]::int as x, ys[side + 1]::int as y, greatest(abs(xs[side + 2] - xs[side + 1]), abs(ys[side + 2] - ys[side + 1]))::int as steps from s""",
    "timeline_strokes": f"""with c as (select c_custkey, (c_custkey % 8)::int as i, c_custkey % 100 as x0, greatest(1, c_custkey % 6)::int as d from customer),
s as (select c_custkey, x0, ({_list([-1, 1, 0])})[c_custkey % 3 + 1] as lane, case when i = 7 then [] else list_concat(list_transform(range(0, d), lambda x: 0), case when i = 0 then [2, 6] else [] end, ([[0], [0, 6], [0, 1], [0, 1], [0, 7], [0, 4], [0, 4]])[i + 1]) end as ds from c)
select c_custkey, lane, array_to_string(ds, ',') as directions, x0::int as start, greatest(1, len(list_filter(ds, lambda x: x in (0, 1, 7))))::int as duration from s""",
    "anchored_touch": f"""with s as (select s_suppkey, s_suppkey % 16 as r, s_suppkey % 4 as e, s_suppkey % 8 as d, s_suppkey % 7 as p, ({_list([x for x, _ in K.CENTROIDS])})[s_suppkey % 16 + 1] + s_suppkey % 9 - 4 as ax, ({_list([y for _, y in K.CENTROIDS])})[s_suppkey % 16 + 1] + s_suppkey % 7 - 3 as ay from supplier),
a as (select *, least(15, greatest(0, ax))::int as x, least(15, greatest(0, ay))::int as y from s)
select s_suppkey, concat_ws(',', 524288 + 131072 + 2048 + 512 + x * 16 + y, 524288 + 65536 + 2048 + e * 512 + r * 32 + 31, 524288 + 2048 + d * 8 + 3, 524288 + 2048 + 48 + p) as words, x, y, r::int as region from a""",
    "touch_traces": """with p as (select p_partkey, greatest(1, p_partkey % 3)::int as l, p_partkey % 8 as top, greatest(1, p_partkey % 6)::int as n from part),
s as (select *, case when n = 1 then [top::double] else list_transform(range(0, n), lambda i: round_even(top * (i / (n - 1)::double), 0)) end as up, case when n = 1 then [0.0::double] else list_transform(range(0, n), lambda i: round_even(top + (0 - top) * (i / (n - 1)::double), 0)) end as down from p)
select p_partkey, 8 * l as loop, 8 * l as fours, array_to_string(list_concat(list_transform(range(0, n), lambda i: 2), list_transform(range(0, n), lambda i: 6)), ',') as press, array_to_string(list_transform(list_concat(up, down), lambda v: v::int), ',') as pressures from s""",
    "receptor_channels": f"with c as (select c_custkey % 5 as r from customer where c_custkey % 5 < 4) select ({_list([r[0] for r in K.RECEPTORS])})[r + 1] as name, r != 2 as direction, r != 2 as pressure, r = 2 as vibration, count(*) as n from c group by all",
    "time_steps": f"""with e as (select user_id, {_GCD('event_id % 24', '([1, 2, 3, 4])[event_id % 4 + 1]')} as d from events union all select user_id, {_GCD('event_id % 5', '([2, 6, 8])[event_id % 3 + 1]')} from events)
select user_id, max(case when d % 8 = 0 then 8 when d % 4 = 0 then 4 when d % 2 = 0 then 2 else 1 end)::bigint * max(case when d % 3 = 0 then 3 else 1 end)::bigint as per_quarter from e group by user_id""",
    "max_angle_error": "with c as (select c_custkey % 14 as joint, c_custkey * 37 % 1801 / 10.0::double as a from customer) select joint, cast(round_even(max(abs(round_even(a / 180.0::double * 255.0::double, 0) / 255.0::double * 180.0::double - a)) * 1e6, 0) as bigint) as max_error from c group by joint",
    "padded_batches": f"with c as (select conv_id, turn, ({_words('text')})[1:64] as w from conversations) select conv_id, turn, sha256(array_to_string(list_concat(w, list_transform(range(0, 64 - len(w)), lambda i: 0)), ',')) as ids_sha, len(w)::int as used, 64 as length from c",
}
QUERIES = {f.__name__: f for f in (full_decode, built_streams, anchored_segments, timeline_strokes, anchored_touch, touch_traces, receptor_channels, time_steps, max_angle_error, padded_batches)}
