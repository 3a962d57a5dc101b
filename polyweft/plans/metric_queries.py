"""Queries over metrics, windows, rankings, sets and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyweft.operators import metrics as M
from polyweft.plans.common import table

_U = lambda c, k=1e6: F.rint(F.col(c) * k).cast("long").alias(c)


def distribution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return M.distribution(counts, "user_id", "n", "event_type").select("user_id", "coverage", "first", _U("entropy"), _U("evenness"), *map(M.ratio, M.RATIOS))


def demo_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published word counts of the demonstration stream."""
    counts = {"text": 75, "diagram": 125, "music": 50, "voice": 27, "image": 498, "bpe": 3, "mental": 39, "touch": 30, "smell": 17, "taste": 18}
    rows = spark.createDataFrame(list(counts.items()), "label string, n long")
    return M.distribution(rows, None, "n", "label").select(_U("entropy"), M.ratio("hhi"), M.ratio("effective"))


def transport_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    parts = [F.col("c_acctbal") / 10000, F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") / 25.0), F.lit(0.5)]
    return c.select("c_custkey", M.transport_score(parts).alias("score")).select("c_custkey", _U("score"))


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(M.percentile("value", 0.5).alias("p50"), M.percentile("value", 0.95).alias("p95"), F.avg("value").alias("mean"))
    return e.select("event_type", _U("p50"), _U("p95"))


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return M.latest(e, "user_id", "event_id", 8)


def metric_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    named = lambda name, value, known: F.when(known, F.struct(F.lit(name).alias("k"), value.alias("v")))
    key = F.col("s_suppkey")
    m = F.map_from_entries(F.filter(F.array(named("a", key, key % 2 == 0), named("b", -key, key % 3 == 0), named("c", key * 1000, key % 5 != 0)), lambda x: x.isNotNull()))
    return s.select("s_suppkey", M.first_known(m, "a", "b", "c").alias("value"))


def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.sum("p_size") / F.count(F.lit(1))).alias("size"), F.max("p_retailprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n"))
    return M.unpivoted(p, ["p_brand"], 4)


def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.bool_and(F.col("value") > 0.5).alias("all_ok"), (F.count_distinct(F.col("event_id") % 7) > 6).alias("many"))
    return e


def point_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("k"), (F.col("p_partkey") % 97).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("k"), (F.col("s_suppkey") * 7 % 101).cast("double").alias("x"), (F.col("s_nationkey") * 2).cast("double").alias("y"))
    return M.nearest_mean(a, b, "k").select("k", _U("mean_distance"))


def descriptor_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = [F.col("c_custkey") % 16, F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") % 16), F.col("c_custkey") % 20, F.col("c_custkey") % 8]
    b = [F.col("c_nationkey") % 16, F.lit(7), F.lit(3), F.lit(2)]
    d = M.descriptor_distance(a, b)
    return c.select("c_custkey", d.alias("d"), M.blended(F.lit(0.9), d).alias("j")).select("c_custkey", _U("d"), _U("j"))


def pitch_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("f0"))
    return M.trends(e, "user_id", "event_id", "f0").select("user_id", F.col("bucket").cast("long").alias("bucket"), "trend")


def energy_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("e"))
    return M.contour(e, "user_id", "event_id", "e")


def tie_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tie = F.element_at(F.array(F.lit("start"), F.lit("continue"), F.lit("stop"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    notes = e.select((F.col("user_id") % 5).alias("doc_id"), F.col("event_type").alias("part"), F.lit("1").alias("voice"), (F.col("event_id") % 3).alias("pitch"), F.col("event_id").alias("onset"), (F.col("event_id") % 9 + 1).alias("duration"), tie.alias("tie"))
    return M.merged_ties(notes)


def note_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("doc_id"), (F.col("event_id") / 8.0).alias("onset"), (F.col("event_id") % 3 / 8.0).alias("duration"), (F.col("event_id") % 61 + 20).alias("pitch"))
    return M.grid_notes(e, 0.25)


def path_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    move = F.col("event_id") % 10 == 0
    steps = e.select("user_id", "event_id", F.when(move, F.col("event_id") % 50).alias("mx"), F.when(move, F.col("event_id") % 30).alias("my"), F.when(~move, F.col("event_id") % 3 - 1).alias("dx"), F.when(~move, F.col("event_id") % 5 - 2).alias("dy"))
    return M.path_points(steps, "user_id", "event_id", "mx", "my", "dx", "dy").where("segment > 0").select("user_id", "event_id", "x", "y")


def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.rint(F.col("value") / 40).cast("long").alias("x"))
    kept = e.withColumn("before", F.lag("x").over(w)).where("before is null or before != x")
    return kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("n >= 2").select("user_id", "event_id", "x")


def box_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points scaled into a canvas of 256 with a border of 4, both axes by the same factor."""
    w = Window.partitionBy("k")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("k"), (F.col("p_partkey") % 101).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    span = F.greatest(F.max("x").over(w) - F.min("x").over(w), F.max("y").over(w) - F.min("y").over(w), F.lit(1e-9))
    scaled = lambda c: F.rint(((F.col(c) - F.min(c).over(w)) * (248.0 / span) + 4) * 1e6).cast("long").alias(c)
    return p.select("p_partkey", scaled("x"), scaled("y"))


def sniff_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.least(F.row_number().over(w) - 1, F.lit(3)).alias("phase"))


def aligned_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phoneme places with alignment segments by position, as far as the shorter goes."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    v = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.row_number().over(w).alias("i"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.row_number().over(v).alias("i"))
    return a.join(b, ["k", "i"]).select("k", "i", "c_custkey", "s_suppkey")


def top_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest sums; the limit is the feature."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


def sorted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's events in six-key order."""
    w = Window.partitionBy("user_id").orderBy((F.col("event_id") % 97), "event_type", (F.col("event_id") % 128), (F.col("event_id") % 5), "value", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference and subset of small token sets."""
    p = table(spark, sf_dir, "part")
    a = F.array(F.col("p_size") % 4, F.col("p_size") % 6, F.col("p_size") % 6)
    b = F.array(F.lit(1), F.lit(2), F.lit(3))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return p.select("p_partkey", text(F.array_distinct(F.concat(a, b))).alias("both"), F.arrays_overlap(a, b).alias("meets"), text(F.array_except(a, b)).alias("rest"), (F.size(F.array_except(a, b)) == 0).alias("within"))


def mode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at every level of a two-part key, as a quadtree's levels are counted."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("fine"), F.floor(F.col("p_size") / 10).alias("coarse"))
    return p.rollup("coarse", "fine").agg(F.count(F.lit(1)).alias("n"))


def cyclic_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with trends handed out in turn."""
    names = F.array(F.lit("UP"), F.lit("LEVEL"), F.lit("DOWN"))
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("i", F.row_number().over(w) - 1)
    return s.select("s_suppkey", F.element_at(names, F.pmod("i", F.lit(3)) + 1).alias("trend"), F.col("i").alias("start"))


_R = lambda e, n, k="1e6": f"cast(round_even(({e}) * {k}, 0) as bigint) as {n}"
# a / b in millionths, half to even, of whole numbers
_Q = lambda a, b, n: f"((1000000::hugeint * ({a})) // ({b}) + case when 2 * ((1000000::hugeint * ({a})) % ({b})) > ({b}) or 2 * ((1000000::hugeint * ({a})) % ({b})) = ({b}) and (1000000::hugeint * ({a})) // ({b}) % 2 = 1 then 1 else 0 end)::bigint as {n}"
ORACLES = {
    "distribution_metrics": f"""with c as (select user_id, event_type, count(*)::hugeint as n from events group by all), g as (select user_id, count(*) as coverage, sum(n) as total, sum(n * n) as squares, min(n) as least, list(n order by n desc, event_type nulls last) as ns, (list(event_type order by n desc, event_type nulls last))[1] as first from c group by user_id),
d as (select user_id, coverage, first, total, squares, least, ns[1] as a, coalesce(ns[2], 0)::hugeint as b, list_reduce(list_prepend(0.0::double, list_transform(ns, lambda n: (n::double / total::double) * log2(n::double / total::double))), lambda x, y: x - y) as entropy from g)
select user_id, coverage, first, {_R('entropy', 'entropy')}, {_R('case when coverage > 1 then entropy / log2(coverage) else 0 end', 'evenness')}, {_Q('squares', 'total * total', 'hhi')}, {_Q('total * total', 'squares', 'effective')}, {_Q('a', 'least', 'spread')}, {_Q('a + b', 'total', 'pair_share')}, {_Q('b', 'a', 'pair_balance')}, {_Q('a - b', 'total', 'pair_gap')}, {_Q('(a + b) * b', 'total * a', 'bimodality')} from d""",
    "demo_distribution": "select 2173322::bigint as entropy, 354181::bigint as hhi, 2823414::bigint as effective",
    "transport_scores": f"with c as (select c_custkey, list_filter([c_acctbal / 10000, case when c_custkey % 3 != 0 then c_nationkey / 25.0::double end, 0.5::double], lambda x: x is not null) as ps from customer) select c_custkey, {_R('100 * list_sum(list_transform(ps, lambda x: greatest(0.0::double, least(1.0::double, x)))) / len(ps)', 'score')} from c",
    "value_percentiles": f"select event_type, {_R('quantile_cont(value, 0.5::double)', 'p50')}, {_R('quantile_cont(value, 0.95::double)', 'p95')} from events group by event_type",
    "latest_runs": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) <= 8",
    "metric_fallback": "select s_suppkey, case when s_suppkey % 2 = 0 then s_suppkey when s_suppkey % 3 = 0 then -s_suppkey when s_suppkey % 5 != 0 then s_suppkey * 1000 end as value from supplier",
    "metric_unpivot": "with p as (select p_brand, round_even(sum(p_size) / count(*)::double, 4) as size, round_even(max(p_retailprice), 4) as price, count(*)::double as n from part group by p_brand) select p_brand, metric, value from p unpivot (value for metric in (size, price, n))",
    "batch_rollup": "select event_type, count(*) as n, count(distinct user_id) as users, bool_and(value > 0.5) as all_ok, count(distinct event_id % 7) > 6 as many from events group by event_type",
    "point_distance": f"""with a as (select p_partkey, p_partkey % 20 as k, (p_partkey % 97)::double as x, p_size::double as y from part), b as (select s_suppkey % 20 as k, (s_suppkey * 7 % 101)::double as x, (s_nationkey * 2)::double as y from supplier),
d as (select a.k, a.p_partkey, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from a join b on a.k = b.k group by all) select k, {_R('avg(d)', 'mean_distance')} from d group by k""",
    "descriptor_distances": f"""with c as (select c_custkey, abs(c_custkey % 16 / 15.0::double - c_nationkey % 16 / 15.0::double) + abs(coalesce(case when c_custkey % 3 != 0 then c_nationkey % 16 / 15.0::double end, 0) - 7 / 15.0::double) + abs(least(1.0::double, c_custkey % 20 / 15.0::double) - 3 / 15.0::double) + abs(c_custkey % 8 / 7.0::double - 2 / 7.0::double) as s from customer)
select c_custkey, {_R('s / 4', 'd')}, {_R('least(1.0::double, 0.9::double + 0.35::double * (s / 4))', 'j')} from c""",
    "pitch_trends": "with k as (select user_id, event_id, value, (row_number() over (partition by user_id order by event_id) - 1) // 5 as bucket from events where event_id % 7 != 0 and value is not null), g as (select user_id, bucket, arg_max(value, event_id) - arg_min(value, event_id) as slope, count(*) as n from k group by all) select user_id, bucket, case when slope > 5 then 'UP' when slope < -5 then 'DOWN' else 'LEVEL' end as trend from g where n > 1",
    "energy_contour": "with e as (select user_id, event_id, floor(value * 100)::bigint as e from events), s as (select *, min(e) over (partition by user_id) as lo, max(e) over (partition by user_id) as hi from e), l as (select user_id, event_id, (case when hi > lo then round_even((e - lo)::double / (hi - lo) * 7, 0) else 0 end)::int as level from s), d as (select *, level - lag(level) over (partition by user_id order by event_id) as c from l) select user_id, event_id, level, case when c is null or c = 0 then 0 when c > 0 then 1 else 7 end as dir from d",
    "tie_merge": """with n as (select user_id % 5 as doc_id, event_type as part, '1' as voice, event_id % 3 as pitch, event_id as onset, event_id % 9 + 1 as duration, (['start', 'continue', 'stop', null])[(event_id % 4 + 1)::int] as tie from events),
j as (select *, coalesce(lag(tie) over w in ('start', 'continue') and tie in ('continue', 'stop'), false) as joins from n window w as (partition by doc_id, part, voice, pitch order by onset)), c as (select *, sum((not joins)::int) over (partition by doc_id, part, voice, pitch order by onset) as chain from j)
select doc_id, part, voice, pitch, min(onset) as onset, sum(duration)::bigint as duration from c group by doc_id, part, voice, pitch, chain""",
    "note_grid": "with e as (select user_id % 5 as doc_id, event_id / 8.0::double as onset, event_id % 3 / 8.0::double as duration, event_id % 61 + 20 as pitch from events) select doc_id, round_even(onset / 0.25::double, 0)::int as start_tick, greatest(1, round_even(duration / 0.25::double, 0)::int) as duration_ticks, pitch, pitch - min(pitch) over (partition by doc_id) as row from e",
    "path_integration": """with s as (select user_id, event_id, case when event_id % 10 = 0 then event_id % 50 end as mx, case when event_id % 10 = 0 then event_id % 30 end as my, case when event_id % 10 != 0 then event_id % 3 - 1 else 0 end as dx, case when event_id % 10 != 0 then event_id % 5 - 2 else 0 end as dy from events),
m as (select *, count(mx) over (partition by user_id order by event_id) as seg from s) select user_id, event_id, (max(mx) over w + sum(dx) over w)::bigint as x, (max(my) over w + sum(dy) over w)::bigint as y from m where seg > 0 window w as (partition by user_id, seg order by event_id)""",
    "consecutive_dedupe": "with e as (select user_id, event_id, round_even(value / 40, 0)::bigint as x from events), k as (select *, lag(x) over (partition by user_id order by event_id) as b from e), f as (select user_id, event_id, x, count(*) over (partition by user_id) as n from k where b is null or b != x) select user_id, event_id, x from f where n >= 2",
    "box_normalise": "with p as (select p_partkey, p_partkey % 10 as k, (p_partkey % 101)::double as x, p_size::double as y from part), s as (select *, min(x) over w as lx, min(y) over w as ly, greatest(max(x) over w - min(x) over w, max(y) over w - min(y) over w, 1e-9::double) as span from p window w as (partition by k)) select p_partkey, cast(round_even(((x - lx) * (248.0::double / span) + 4) * 1e6, 0) as bigint) as x, cast(round_even(((y - ly) * (248.0::double / span) + 4) * 1e6, 0) as bigint) as y from s",
    "sniff_phases": "select user_id, event_id, least(row_number() over (partition by user_id order by event_id) - 1, 3)::int as phase from events",
    "aligned_zip": "with a as (select c_nationkey as k, c_custkey, row_number() over (partition by c_nationkey order by c_custkey)::int as i from customer), b as (select s_nationkey as k, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey)::int as i from supplier) select k, i, c_custkey, s_suppkey from a join b using (k, i)",
    "top_hotspots": "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 10",
    "sorted_events": "select user_id, event_id, row_number() over (partition by user_id order by event_id % 97, event_type, event_id % 128, event_id % 5, value, event_id)::int as place from events",
    "set_operations": "with p as (select p_partkey, [p_size % 4, p_size % 6, p_size % 6] as a, [1, 2, 3] as b from part), u as (select *, list_concat(a, b) as ab, list_filter(list_filter(a, lambda x: not list_contains(b, x)), lambda x, i: true) as r from p) select p_partkey, array_to_string(list_filter(ab, lambda x, i: list_position(ab, x) = i), ',') as both, list_has_any(a, b) as meets, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') as rest, len(r) = 0 as within from u",
    "mode_rollup": "select (p_size // 10)::bigint as coarse, p_size as fine, count(*) as n from part group by rollup ((p_size // 10)::bigint, p_size)",
    "cyclic_trends": "with s as (select s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey)::int - 1 as i from supplier) select s_suppkey, (['UP', 'LEVEL', 'DOWN'])[i % 3 + 1] as trend, i::int as start from s",
}
QUERIES = {
    f.__name__: f
    for f in (
        distribution_metrics, demo_distribution, transport_scores, value_percentiles, latest_runs, metric_fallback, metric_unpivot, batch_rollup, point_distance, descriptor_distances, pitch_trends, energy_contour, tie_merge,
        note_grid, path_integration, consecutive_dedupe, box_normalise, sniff_phases, aligned_zip, top_hotspots, sorted_events, set_operations, mode_rollup, cyclic_trends,
    )
}
