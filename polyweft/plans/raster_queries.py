"""Queries over pen strokes, their pixels, and thresholds of grey images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.operators import rasters as R
from polyweft.plans.codec_queries import _PIX, _pixels
from polyweft.plans.common import table

# three polylines a part: their points leave the grid on every side, repeat, and lie half way between places
_LINES = (
    (("p_partkey % 90 - 12.5D", "p_size * 2.0D"), ("p_partkey * 7 % 131 - 30.0D", "p_size * 5 % 97 - 16.5D"), ("p_partkey * 7 % 131 - 30.0D", "p_size * 5 % 97 - 16.5D"), ("p_partkey % 11 + 0.5D", "80.0D")),
    (("5.0D", "p_partkey % 3 + 5.0D"), ("5.4D", "p_partkey % 3 + 5.3D")),
    (("p_size % 2 * 9.0D", "0.0D"), ("p_size + 1.5D", "p_partkey % 64 * 1.0D"), ("-3.0D", "200.0D")),
)


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    lines = F.array(*[F.array(*[point(x, y) for x, y in line]) for line in _LINES])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drawing_id"), R.pen_strokes(lines).alias("steps"))


def pen_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _strokes(spark, sf_dir).select("drawing_id", F.posexplode("steps").alias("pos", "s"))
    return s.select("drawing_id", "pos", "s.dx", "s.dy", "s.pen")


def pen_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drawn(_strokes(spark, sf_dir)).groupBy("drawing_id").agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"), F.sum(F.col("x") * F.col("y")).alias("xy"))


def image_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's threshold, its dark pixels, and those of the image at 12 by 12 pixels."""
    g = _pixels(spark, sf_dir).select("image_id", "x", "y", R.grey(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    dark = lambda p, name: R.binarised(p).groupBy("image_id").agg(F.count_if("on").alias(name), F.count("*").alias(f"{name}_of"))
    return R.thresholds(g).join(dark(g, "dark"), "image_id").join(dark(R.resized(g, 12), "dark12"), "image_id").join(dark(R.resized(g, 3), "dark3"), "image_id")


_POINTS = "[" + ", ".join("[" + ", ".join("{'x': " + x.replace("D", "::double") + ", 'y': " + y.replace("D", "::double") + "}" for x, y in line) + "]" for line in _LINES) + "]"
_AT = lambda v: f"greatest(0, least(63, round_even({v}, 0)))::int"
_STEPS = f"""pl as (select p_partkey as drawing_id, unnest(range(1, 4)) as line, {_POINTS} as ls from part), pt as (select drawing_id, line, unnest(range(1, len(ls[line]) + 1)) as i, ls[line] as l from pl),
q as (select drawing_id, line, i, {_AT('l[i].x')} as x, {_AT('l[i].y')} as y from pt),
u as (select * from q window w as (partition by drawing_id, line order by i) qualify lag(x) over w is null or lag(x) over w <> x or lag(y) over w <> y),
m as (select *, lag(x) over w as px, lag(y) over w as py, row_number() over w as k, count(*) over (partition by drawing_id, line) as n from u window w as (partition by drawing_id, line order by i)),
g as (select *, dense_rank() over (partition by drawing_id order by line) as nth from m where n > 1),
st as (select drawing_id, line, 0 as k, 0 as dx, 0 as dy, false as pen from g where k = 1 and nth > 1 union all select drawing_id, line, k, case when k = 1 then x else x - px end, case when k = 1 then y else y - py end, k > 1 from g),
so as (select drawing_id, (row_number() over (partition by drawing_id order by line, k) - 1)::int as pos, dx::int as dx, dy::int as dy, pen from st)"""
_SCALE = "round_even(({0}) * (255.0::double / 63), 0)::int"
_DRAWN = f"""mv as (select *, count(*) filter (not pen and (dx <> 0 or dy <> 0)) over (partition by drawing_id order by pos) as move from so),
ab as (select *, sum(case when pen or dx <> 0 or dy <> 0 then dx else 0 end) over w as x, sum(case when pen or dx <> 0 or dy <> 0 then dy else 0 end) over w as y from mv where move > 0 window w as (partition by drawing_id, move order by pos)),
ln as (select distinct drawing_id, {_SCALE.format('x - dx')} as x0, {_SCALE.format('y - dy')} as y0, {_SCALE.format('x')} as x1, {_SCALE.format('y')} as y1 from ab where pen),
wk as (select drawing_id, x0, y0, x1, y1, unnest(range(0, greatest(abs(x1 - x0), abs(y1 - y0)) + 1)) as k, greatest(abs(x1 - x0), abs(y1 - y0)) as n, least(abs(x1 - x0), abs(y1 - y0)) as m, sign(x1 - x0) as sx, sign(y1 - y0) as sy from ln),
px as (select distinct drawing_id, case when abs(x1 - x0) >= abs(y1 - y0) then x0 + sx * k else x0 + sx * ((2 * k * m + n) // (2 * n)) end as x, case when abs(x1 - x0) >= abs(y1 - y0) then y0 + sy * ((2 * k * m + n) // (2 * n)) else y0 + sy * k end as y from wk)"""
_GREY = "gr as (select image_id, x, y, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 as v from pix)"
_OTSU = lambda src: f"""(select image_id, arg_max(v, (b, -v)) as t from (select image_id, v, case when w1 < w then (s1 * w - s * w1)::double * (s1 * w - s * w1)::double / (w1::double * (w - w1)::double) else 0.0::double end as b
from (select image_id, v, sum(n) over o as w1, sum(n * v) over o as s1, sum(n) over p as w, sum(n * v) over p as s from (select image_id, v, count(*) as n from {src} group by all) window o as (partition by image_id order by v), p as (partition by image_id))) group by image_id)"""  # noqa: E731
_DARK = lambda src, name: f"(select g.image_id, count(*) filter (v < t) as {name}, count(*) as {name}_of from {src} g join {_OTSU(src)} o using (image_id) group by all)"
ORACLES = {
    "pen_strokes": f"with {_STEPS} select drawing_id, pos, dx, dy, pen from so",
    "pen_pixels": f"with {_STEPS}, {_DRAWN} select drawing_id, count(*) as pixels, sum(x)::bigint as xs, sum(y)::bigint as ys, sum(x * y)::bigint as xy from px where x between 0 and 255 and y between 0 and 255 group by drawing_id",
    "image_thresholds": f"""with {_PIX}, {_GREY}, ids as (select distinct image_id from gr),
g12 as (select i.image_id, a.x, b.x as y, g.v from ids i, (select unnest(range(0, 12)) as x) a, (select unnest(range(0, 12)) as x) b join gr g on true where g.image_id = i.image_id and g.x = (2 * a.x + 1) * 8 // 24 and g.y = (2 * b.x + 1) * 8 // 24 and not exists (select 1 from gr h where h.image_id = i.image_id and h.x * 12 // 8 = a.x and h.y * 12 // 8 = b.x)
  union all select image_id, x * 12 // 8, y * 12 // 8, round_even(avg(v), 0)::int from gr group by all), g3 as (select image_id, x * 3 // 8 as x, y * 3 // 8 as y, round_even(avg(v), 0)::int as v from gr group by all)
select o.image_id, t::int as threshold, dark, dark_of, dark12, dark12_of, dark3, dark3_of from {_OTSU('gr')} o join {_DARK('gr', 'dark')} using (image_id) join {_DARK('g12', 'dark12')} using (image_id) join {_DARK('g3', 'dark3')} using (image_id)""",
}
QUERIES = {f.__name__: f for f in (pen_strokes, pen_pixels, image_thresholds)}
