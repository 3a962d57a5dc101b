"""Queries over image streams of several layouts, whole and broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.functions import words as W
from polyweft.operators import families as M
from polyweft.operators import images as I
from polyweft.plans.codec_queries import _PIX, _Q, _SQ, _TREE, _pixels

_X = 524288
_BROKEN = {  # what is put behind a stream, by the image's number modulo 8, and the error it makes
    2: ([_X + W.IMAGE_LEGACY + 6 * 64 + 1], "a step above the root"), 3: ([_X + W.IMAGE_LEGACY + 7 * 64 + 1], "several families"), 6: ([_X + W.IMAGE_LEGACY + 5 * 64 + 1], "it ends before a colour"),
    7: ([_X + W.IMAGE_ENHANCED + 7 * 64], "it ends in the header"),
}
_ENHANCED = (1, 3, 7)


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By number: legacy and enhanced streams, some with words that make them wrong, one of text alone, and one with text between."""
    pixels = _pixels(spark, sf_dir)
    k = F.col("image_id") % 8
    enhanced = I.encoded(pixels.where(k.isin(*_ENHANCED)), 2500.0).select("image_id", "words", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    both = M.legacy_encoded(pixels.where(~k.isin(*_ENHANCED)), 2500.0).unionByName(enhanced)
    ints = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<int>")
    more = ints([])
    for n, (ws, _) in _BROKEN.items():
        more = F.when(k == n, ints(ws)).otherwise(more)
    words = F.when(k == 4, ints([72, 105, _X + (1 << 16) + W.IMAGE_LEGACY])).when(k == 5, F.concat(ints([72, 105]), "words", ints([10]))).otherwise(F.concat("words", more))
    return both.select("image_id", words.alias("words"), "width", "height")


def image_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and error of each stream, and its pixels as sums that depend on their places."""
    d = M.decoded(_streams(spark, sf_dir))
    at = F.col("x") + 8 * F.col("y") + 1
    return d.groupBy("image_id", "family", "error").agg(F.count("x").alias("pixels"), *[F.coalesce(F.sum(F.col(n) * at), F.lit(0)).alias(n) for n in I.CHANNELS])


def base_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of the base layout: their number of paintings and colours, and the sum of the colours' values."""
    e = M.base_encoded(_pixels(spark, sf_dir), 2500.0).select("image_id", F.explode("words").alias("w"))
    datum, code = W.has("w", 1 << 13), F.shiftright("w", 10).bitwiseAND(7)
    n = lambda k: F.count_if(~datum & (code == k))
    return e.groupBy("image_id").agg(n(I.PAINT).alias("paints"), n(I.SET_COLOUR).alias("colours"), n(I.BACKTRACK).alias("steps_back"), F.count_if(~datum & (code < 4)).alias("steps"), F.sum(F.when(datum, F.col("w").bitwiseAND(1023)).otherwise(0)).alias("value"))


_SPREAD = lambda v: f"((({v}) << 5) | (({v}) << 2) | (({v}) >> 1))"
_ROUND = lambda v: f"round_even({v}, 0)::int"
_NODES = """lv as (select *, unnest(range(0, 4)) as level from sq), nd as (select image_id, level, x >> (3 - level)::int as nx, y >> (3 - level)::int as ny, count(*)::double as n, sum(r) as sr, sum(g) as sg, sum(b) as sb, sum(r * r) as qr, sum(g * g) as qg, sum(b * b) as qb, sum(lr) as lr, sum(lg) as lg, sum(lb) as lb from lv group by all),
ps as (select *, array_to_string(list_transform(range(1, level + 1), lambda k: ((ny >> (level - k)::int) & 1) * 2 + ((nx >> (level - k)::int) & 1)), '') as path from nd where level = 3 or (0.0::double + (qr / n - pow(sr / n, 2)) + (qg / n - pow(sg / n, 2)) + (qb / n - pow(sb / n, 2))) / 3 <= 2500),
lf as (select * from ps a where not exists (select 1 from ps p where p.image_id = a.image_id and length(p.path) < length(a.path) and starts_with(a.path, p.path)))"""
_PAINTED = "{c} as (select p.image_id, p.x, p.y, {v} from {sq} p join {lf} l on l.image_id = p.image_id and starts_with(concat((p.y >> 2) * 2 + (p.x >> 2), ((p.y >> 1) & 1) * 2 + ((p.x >> 1) & 1), (p.y & 1) * 2 + (p.x & 1)), l.path))"
_LEVELS = "sq as (select image_id, x, y, {0} from pix)".format(", ".join([f"{_SPREAD(f'{c} >> 5')} as {c}, {c} >> 5 as l{c}" for c in "rgb"]))
_CASES = " ".join(f"when {n} then '{e}'" for n, (_, e) in _BROKEN.items())
_TRUNC = ", ".join(f"(({c} >> 5) << 5) as {c}, 0 as l{c}" for c in "rgb")
ORACLES = {
    "image_families": f"""with {_PIX}, {_LEVELS}, {_NODES}, {_PAINTED.format(c='lp', sq='pix', lf='lf', v=', '.join(f"{_SPREAD(_ROUND(f'l.l{c} / l.n'))} as {c}" for c in 'rgb'))},
legacy as (select image_id, count(*) as pixels, {', '.join(f'sum({c} * (x + 8 * y + 1))::bigint as {c}' for c in 'rgb')} from lp group by image_id),
e as (with {_SQ('')}, {_TREE}, {_PAINTED.format(c='ep', sq='pix', lf='lf', v=', '.join(f"{_Q(f'l.{c}')} as {c}" for c in 'rgb'))} select image_id, count(*) as pixels, {', '.join(f'sum({c} * (x + 8 * y + 1))::bigint as {c}' for c in 'rgb')} from ep group by image_id),
k as (select i.image_id, i.image_id % 8 as k, case i.image_id % 8 {_CASES} when 4 then 'no image family' end as error, case when i.image_id % 8 in (3, 4) then null when i.image_id % 8 in (1, 7) then 'enhanced' else 'legacy' end as family from legacy i)
select image_id, family, error, case when error is null then l.pixels else 0 end as pixels, {', '.join(f"case when error is not null then 0 when k = 1 then e.{c} else l.{c} end as {c}" for c in 'rgb')} from k join legacy l using (image_id) join e using (image_id)""",
    "base_layout": f"""with {_PIX}, sq as (select image_id, x, y, {_TRUNC} from pix), {_NODES},
o as (select image_id, path, {', '.join(f"(({_ROUND(f's{c} / n')}) >> 5) << 5 as {c}" for c in 'rgb')}, lag(path) over w as before from lf window w as (partition by image_id order by path)),
s as (select *, coalesce((r, g, b) is not distinct from (lag(r) over w, lag(g) over w, lag(b) over w), false) as same, case when before is null then 0 else list_max(list_transform(range(0, 4), lambda k: case when k <= length(before) and k <= length(path) and before[:k] = path[:k] then k else 0 end)) end as shared from o window w as (partition by image_id order by path))
select image_id, count(*) as paints, count(*) filter (not same or before is null) as colours, sum(length(path) - shared)::bigint as steps_back, sum(length(path) - shared)::bigint as steps, sum(case when same and before is not null then 0 else r + g + b end)::bigint as value from s group by image_id""",
}
QUERIES = {f.__name__: f for f in (image_families, base_layout)}
