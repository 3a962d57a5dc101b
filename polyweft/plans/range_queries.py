"""Queries over one long stream, cut into ranges, and over regions of images of many tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.functions import words as W
from polyweft.operators import ranges, regions
from polyweft.plans.common import MODALITY_SQL, table

_X, _T = 524288, 65536  # an extension word, and one version more
# four words each: text, escapes, every modality, taste blocks that are whole, go on or are broken, and words that are none
PHRASES = (
    (72, 105, 262144 + 0xC3A9, 32), (_X + 0x8C01, _X + 0x8005, _X + 0x8405, _X + 0x8C00), (_X + 0x4001, _X + 0x4C01, _X + 0x2201, _X + 0x2C01), (_X + 0x1000 + 77, 65, 66, _X + 0x1000 + 4095),
    (_X + 0x0409, _X + _T + 0x0412, _X + 2 * _T + 0x0401, _X + 2 * _T + 0x0402), (_X + 2 * _T + 0x0407, _X + 3 * _T + 0x0401, _X + 2 * _T + 0x0400, _X + 3 * _T + 0x0433), (_X + 3 * _T + 0x0407, _X + 0x0409, _X + _T + 0x0412, _X + 2 * _T + 0x0402),
    (_X + 0x0409, _X + _T + 0x0412, _X + 3 * _T + 0x0407, _X + 2 * _T + 0x0402), (_X + 0x0400, _X + 0x0600, _X + 0x0540, _X + 0x0500), (_X + _T + 0x081F, _X + 0x0803, _X + 2 * _T + 0x0C02, _X + 0x0812), (_X + 0x0211, _X + 0x0252, _X + 0x0289, _X + 0x0201),
    (786432 + 0x0100, 786432 + 0x0180, _X + 0x0120, 786432 + 0x0010), (10, None, 223, 9), (1048576 + 5, _X + 0x0409, None, _X + _T + 0x0412), (_X + 2 * _T + 0x0402, _X + 2 * _T + 0x0403, _X + 2 * _T + 0x0404, _X + 2 * _T + 0x0405),
)
_DEAL = "(({0} div 4) * 7919 + ({0} div 28) * 104729) % 1000003 % " + str(len(PHRASES))


def long_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream: phrases that a number of the event deals, positions without gaps."""
    e = table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("stream_id"), "event_id")
    phrase = F.get(F.array(*[F.array(*[F.lit(w).cast("int") for w in p]) for p in PHRASES]), F.expr(_DEAL.format("event_id")).cast("int"))
    rows = e.select("stream_id", "event_id", F.get(phrase, (F.col("event_id") % 4).cast("int")).alias("word"))
    return ranges.numbered(rows, "event_id").select("stream_id", "pos", "word")


def long_stream_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.dispatched(long_stream(spark, sf_dir)).select("pos", "word", "modality")


def long_stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ranges.blocks(ranges.dispatched(long_stream(spark, sf_dir)))
    return b.select("modality", "block", "start", F.size("words").alias("n"), W.digest(F.col("words")).alias("words_sha"))


def _mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 16 by 16 vectors, each 8 by 8 pixels; positive values are on."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    x, y = F.expr("vec_id % 16 * 8 + k % 8"), F.expr("vec_id div 16 % 16 * 8 + k div 8")
    return e.select(F.expr("vec_id div 256").alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), (F.col("v") > 0).alias("on"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each image with their pixels, box and its outline."""
    b = regions.boxes(regions.labelled(_mosaics(spark, sf_dir)))
    corners = F.array_join(F.transform("outline", lambda p: F.concat_ws(" ", p["x"].cast("int"), p["y"].cast("int"))), ",")
    return b.select("image_id", "label", "n", "left", "top", "right", "bottom", corners.alias("corners"))


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.labelled(_mosaics(spark, sf_dir))


def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outline as the text of its points, in half pixels."""
    o = regions.polylines(regions.outlines(_mosaics(spark, sf_dir)))
    half = lambda c: (c * 2).cast("int")
    told = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", half(p["x"]), half(p["y"]))), ",")
    return o.select("image_id", half(F.col("outline.x")).alias("x"), half(F.col("outline.y")).alias("y"), "closed", F.size("points").alias("n"), told.alias("points"))


_WORDS = "[" + ", ".join("[" + ", ".join("null" if w is None else str(w) for w in p) + "]" for p in PHRASES) + "]"
_LONG = f"""
w as (select row_number() over (order by event_id) - 1 as pos, ({_WORDS})[(({_DEAL.format('event_id').replace('div', '//')}) + 1)::int][(event_id % 4 + 1)::int]::int as word from events),
f as (select *, coalesce(word between 0 and 1048575 and (word >> 18) & 3 = 2 and word & 1024 != 0, false) as t, (word >> 16) & 3 as v from w),
s as (select *, t and v = 0 and coalesce(lead(t and v = 1) over o, false) and coalesce(lead(t and v = 2, 2) over o, false) as st, t and v in (2, 3) as more from f window o as (order by pos)),
i as (select *, st or coalesce(lag(st) over o, false) or coalesce(lag(st, 2) over o, false) as inb from s window o as (order by pos)),
r as (select *, sum(case when not more or inb then 1 else 0 end) over (order by pos) as run from i),
c as (select pos, word, case when word is null or word not between 0 and 1048575 then null when inb or (more and first_value(inb) over (partition by run order by pos)) then 'taste' else ({MODALITY_SQL}) end as modality from r)
"""
_PX = "px as (select vec_id // 256 as image_id, (vec_id % 16 * 8 + k % 8)::int as x, (vec_id // 16 % 16 * 8 + k // 8)::int as y, v > 0 as o from (select vec_id, unnest(embedding) as v, unnest(range(0, 64)) as k from embeddings))"
_LABELS = f"""{_PX}, p as (select image_id, x, y, y::bigint * 4294967296 + x as spot from px where o),
e as (select a.image_id, a.spot as a, b.spot as b from p a join p b on a.image_id = b.image_id and (b.y = a.y and b.x = a.x + 1) union all select a.image_id, b.spot, a.spot from p a join p b on a.image_id = b.image_id and (b.y = a.y and b.x = a.x + 1)
  union all select a.image_id, a.spot, b.spot from p a join p b on a.image_id = b.image_id and (b.x = a.x and b.y = a.y + 1) union all select a.image_id, b.spot, a.spot from p a join p b on a.image_id = b.image_id and (b.x = a.x and b.y = a.y + 1)),
reach as (select image_id, spot, spot as root from p union select r.image_id, e.b, r.root from reach r join e on e.image_id = r.image_id and e.a = r.spot where e.b > r.root),
l as (select image_id, spot, min(root) as label from reach group by all), l2 as (select p.image_id, p.x, p.y, l.label from p join l using (image_id, spot))"""
_SIDES = "[" + ", ".join("[" + ", ".join(f"[{a}, {b}]" for a, b in regions.SIDES.get(k, ())) + "]" for k in range(16)) + "]"
_MIDDLE = lambda s: f"((2 * y + ([{', '.join(str(m[1]) for m in regions.MIDDLES)}])[{s} + 1])::bigint * 4294967296 + 2 * x + ([{', '.join(str(m[0]) for m in regions.MIDDLES)}])[{s} + 1])"
_OUTLINES = f"""{_PX}, cells as (select image_id, x - dx as x, y - dy as y, sum(bit)::int as kind from px, (values (0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8)) c(dx, dy, bit) where o group by all),
size as (select image_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from px group by all),
s as (select c.image_id, c.x, c.y, unnest(({_SIDES})[kind + 1]) as s from cells c join size using (image_id) where x >= x0 and y >= y0 and x < x1 and y < y1),
n as (select image_id, {_MIDDLE('s[1]')} as a, {_MIDDLE('s[2]')} as b from s),
h as (select image_id, a from n anti join (select image_id, b as a from n) q using (image_id, a)),
walk as (select image_id, a as first, a as spot, 0 as step, true as open from h union all select image_id, a, a, 0, false from n anti join h using (image_id, a)
  union all select w.image_id, w.first, n.b, w.step + 1, w.open from walk w join n on n.image_id = w.image_id and n.a = w.spot where (w.open or n.b >= w.first) and (w.step = 0 or w.spot <> w.first)),
back as (select image_id, first from walk where not open and step > 0 and spot = first)"""
ORACLES = {
    "long_stream_dispatch": f"with {_LONG} select pos, word, modality from c",
    "long_stream_blocks": f"""with {_LONG}, k as (select *, coalesce(modality, '') as m, sum(case when coalesce(modality, '') is distinct from coalesce(pm, '') or pos = 0 then 1 else 0 end) over (order by pos) as island from (select *, lag(modality) over (order by pos) as pm from c)),
b as (select m as modality, min(pos) as start, count(*)::int as n, sha256('[' || string_agg(word::varchar, ',' order by pos) || ']') as words_sha from k where m not in ('text', 'bpe', '') group by m, island)
select modality, row_number() over (partition by modality order by start) - 1 as block, start, n, words_sha from b""",
    "region_labels": f"with recursive {_LABELS} select image_id, x, y, label from l2",
    "region_boxes": f"""with recursive {_LABELS}, b as (select image_id, label, count(*) as n, min(x) as "left", min(y) as top, max(x) as "right", max(y) as bottom from l2 group by all)
select image_id, label, n, "left", top, "right", bottom, concat("left", ' ', top, ',', "right", ' ', top, ',', "right", ' ', bottom, ',', "left", ' ', bottom, ',', "left", ' ', top) as corners from b""",
    "region_outlines": f"""with recursive {_OUTLINES}, r as (select w.* from walk w where open union all select w.* from walk w join back using (image_id, first) where not w.open)
select image_id, (first % 4294967296)::int as x, (first // 4294967296)::int as y, not open as closed, count(*)::int as n, string_agg((spot % 4294967296)::int || ' ' || (spot // 4294967296)::int, ',' order by step) as points from r group by image_id, first, open""",
}
QUERIES = {f.__name__: f for f in (long_stream_dispatch, long_stream_blocks, region_labels, region_boxes, region_outlines)}
