"""Queries over the modality codecs; records are made of the columns of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyweft.functions import codecs as C
from polyweft.functions import words as W
from polyweft.operators import images as I
from polyweft.plans.common import table


def _text(words) -> F.Column:
    return F.array_join(F.transform(words, lambda w: w.cast("string")), ",")


def _int(expr: str) -> F.Column:
    return F.expr(f"cast({expr} as int)")


# --- taste

_FLAVOR = "if(p_size % 2 = 0, array(cast(p_size * 3 % 256 as int)), cast(array() as array<int>))"


def _taste(spark, sf_dir) -> DataFrame:
    event = F.struct(_int("p_size % 8").alias("dominant"), _int("p_partkey % 8").alias("secondary"), _int("p_size div 3 % 8").alias("intensity"), _int("p_partkey % 5").alias("direction"), F.array(_int("p_partkey % 256"), _int("p_partkey * 7 % 256")).alias("temporal"), F.expr(_FLAVOR).alias("flavor"))
    return table(spark, sf_dir, "part").select("p_partkey", C.taste_words(event).alias("words"))


def taste_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taste(spark, sf_dir).select("p_partkey", _text("words").alias("words"))


def taste_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _taste(spark, sf_dir).select("p_partkey", F.explode(C.taste_events(F.concat(F.array(F.lit(65)), "words", "words"))).alias("e"))
    return e.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e.dominant") * 8 + F.col("e.secondary")).alias("quality"), F.sum(F.col("e.intensity") * 8 + F.col("e.direction")).alias("force"), F.max(_text("e.temporal")).alias("temporal"), F.max(_text("e.flavor")).alias("flavor"))


# --- smell


def smell_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("d", F.expr("transform(sequence(1, 1 + s_suppkey % 7), i -> cast((s_suppkey + i) % 8 as int))"))
    return s.select("s_suppkey", _text(C.smell_words(_int("s_suppkey % 8"), _int("s_nationkey % 8"), _int("s_suppkey div 8 % 8"), F.col("d"), F.lit(9))).alias("words"))


def smell_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("d", F.expr("transform(sequence(1, 1 + s_suppkey % 7), i -> cast((s_suppkey + i) % 8 as int))"))
    w = s.select("s_suppkey", C.smell_words(_int("s_suppkey % 8"), _int("s_nationkey % 8"), _int("s_suppkey div 8 % 8"), F.col("d"), F.lit(9)).alias("w"))
    e = w.select("s_suppkey", F.get(C.smell_strokes(F.col("w")), F.lit(0)).alias("e"))
    return e.select("s_suppkey", F.col("e.category").alias("category"), F.col("e.pleasantness").alias("pleasantness"), F.col("e.intensity").alias("intensity"), _text("e.directions").alias("directions"))


def augmented_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    tree = F.array(_int("s_suppkey % 4"), _int("s_nationkey % 4"), _int("s_suppkey div 4 % 4"))
    return s.select("s_suppkey", _text(C.augmented_words(_int("s_suppkey % 8"), F.lit(3), F.lit(4), F.array(F.lit(2), _int("s_suppkey % 8")), tree, _int("s_suppkey % 16"), _int("s_suppkey % 2"))).alias("words"))


def odor_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of a vector as twelve profiles of five and one of four."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 5))).alias("part"), "embedding")
    e = e.select("vec_id", "part", F.transform(F.slice("embedding", 5 * F.col("part") + 1, 5), lambda v: F.abs(v.cast("double"))).alias("q"))
    p = C.odor_place(F.col("q"))
    q = lambda i: F.get("q", F.lit(i))
    p3 = C.odor_place3(q(0), q(1), q(2))
    return e.select("vec_id", "part", p["pleasantness"].alias("pleasantness"), p["intensity"].alias("intensity"), p3["pleasantness"].alias("pleasantness3"), p3["intensity"].alias("intensity3"))


def odor_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    walk = C.odor_walk(_int("s_suppkey % 8"), _int("s_nationkey % 8"), C.sniff_pattern(_int("s_suppkey % 8")))
    return s.select("s_suppkey", F.element_at(walk, -1)["p"].alias("p"), F.element_at(walk, -1)["i"].alias("i"), F.size(walk).cast("long").alias("n"))


def nearest_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.direction_of(_int("c_custkey % 5 - 2"), _int("c_nationkey % 5 - 2")).alias("direction"))


def adaptation_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sniff"))
    return c.select("c_custkey", "sniff", C.adapted(_int("c_custkey % 8"), F.col("sniff"), _int("n % 16"), _int("c_custkey div 8 % 16")).alias("intensity"))


def molecular_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Ester", " thiol", "aromatic", "ketone", "wax", "amine ")
    at = lambda k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.expr(f"(s_suppkey * {k}) % 6") + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(at(1), at(5), at(7)).alias("g"), F.expr("cast(s_suppkey * 13 % 300 as double)").alias("w"), F.expr("s_suppkey % 4 * 0.5D").alias("v"))
    ops = C.tree_operations(F.col("w"), F.col("v"), F.col("g"), F.lit(2.0))
    return s.select("s_suppkey", _text(ops).alias("tree"), F.rint(C.complexity_hint(F.col("w"), F.col("g")) * 1e6).cast("long").alias("hint"))


# --- touch


def touch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", _text(C.touch_words(_int("c_custkey % 4"), _int("c_nationkey % 16"), F.expr("transform(sequence(1, 3), i -> cast((c_custkey + i) % 8 as int))"), F.array(_int("c_custkey % 8"), _int("c_nationkey % 8")))).alias("words"))


def touch_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    one = lambda r: C.touch_words(_int(r), _int("c_nationkey % 16"), F.expr("transform(sequence(1, 3), i -> cast((c_custkey + i) % 8 as int))"), F.array(_int("c_custkey % 8")))
    w = c.select("c_custkey", F.concat(one("c_custkey % 4"), one("(c_custkey + 1) % 4")).alias("w"))
    s = w.select("c_custkey", F.posexplode(C.touch_strokes(F.col("w"))).alias("k", "s"))
    return s.select("c_custkey", "k", F.col("s.receptor").alias("receptor"), F.col("s.region").alias("region"), _text("s.directions").alias("directions"), _text("s.pressures").alias("pressures"))


def touch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    contact = F.struct(_int("c_custkey % 4096").alias("delta_ms"), _int("c_custkey % 4").alias("receptor"), _int("c_nationkey % 16").alias("region"), F.array(_int("c_custkey % 8")).alias("directions"), F.array(F.lit(5)).alias("pressures"))
    f = c.select("c_custkey", C.timed_frame(_int("c_custkey % 16"), F.array(contact, contact)).alias("w"))
    return f.select("c_custkey", _text("w").alias("words"), C.time_delta_back(F.slice("w", 2, 2)).alias("delta"))


def vibration_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", _text(C.vibration_words(_int("c_nationkey % 16"), _int("c_custkey % 16"), _int("c_custkey div 16 % 16"), _int("c_custkey % 4"))).alias("words"))


def proprio_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("angle", F.expr("c_custkey * 37 % 1801 / 10.0D"))
    words = C.joint_words(_int("c_custkey % 14"), F.col("angle"), _int("c_custkey % 16"))
    error = F.abs(C.joint_angle(C.joint_quantum(F.col("angle"))) - F.col("angle"))
    return c.select("c_custkey", _text(words).alias("words"), F.rint(error * 1e6).cast("long").alias("error"))


def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions joined with their coordinates; the dimension has 16 rows."""
    rows = [(i, n, *xyz) for i, (n, xyz) in enumerate(C.REGIONS.items())]
    dim = spark.createDataFrame(rows, "region int, name string, x int, y int, z int")
    c = table(spark, sf_dir, "customer").select("c_custkey", _int("c_nationkey % 16").alias("region"))
    return c.join(F.broadcast(dim), "region").groupBy("name", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


# --- mental


def mental_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("m", F.when(F.col("p_partkey") % 2 == 0, 12).otherwise(8)).withColumn("d", F.expr("concat(array_repeat(cast(p_partkey % 8 as int), cast(p_size as int)), array(1, 1, 2))"))
    frame = F.when(F.col("p_partkey") % 3 == 0, _int("p_size"))
    words = C.mental_words(_int("p_partkey % 4"), _int("p_size % 4"), _int("p_partkey % 8"), F.lit(1), F.col("m"), _int("p_partkey % 256"), F.lit(128), F.col("d"), frame, _int("p_size % 256"))
    return p.select("p_partkey", _text(words).alias("words"))


def mental_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("m", F.when(F.col("p_partkey") % 2 == 0, 12).otherwise(8)).withColumn("d", F.expr("concat(array_repeat(cast(p_partkey % 8 as int), cast(p_size as int)), array(1, 1, 2))"))
    frame = F.when(F.col("p_partkey") % 3 == 0, _int("p_size"))
    words = C.mental_words(_int("p_partkey % 4"), _int("p_size % 4"), _int("p_partkey % 8"), F.lit(1), F.col("m"), _int("p_partkey % 256"), F.lit(128), F.col("d"), frame, _int("p_size % 256"))
    s = p.select("p_partkey", words.alias("w")).select("p_partkey", F.explode(C.mental_strokes(F.concat(F.array(F.lit(65)), "w"))).alias("s"))
    return s.select("p_partkey", *[F.col(f"s.{c}").alias(c) for c in ("form", "symmetry", "frequency", "speed", "x", "y", "frame", "delta")], _text("s.directions").alias("directions"))


def odor_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    tree = F.array(_int("s_suppkey % 4"), _int("s_nationkey % 4"), _int("s_suppkey div 4 % 4"))
    record = C.augmented_words(_int("s_suppkey % 8"), F.lit(3), F.lit(4), F.array(F.lit(2), _int("s_suppkey % 8")), tree, _int("s_suppkey % 16"), _int("s_suppkey % 2"))
    w = C.episode_words(_int("s_suppkey % 3"), _int("s_suppkey % 16"), _int("s_nationkey % 16"), F.array(record, record))
    e = s.select("s_suppkey", "s_nationkey", w.alias("w")).select("s_suppkey", C.episode(F.col("w")).alias("e"), C.odor_signature(_int("s_suppkey % 8"), F.lit(3), F.lit(4), F.array(F.lit(2)), tree, _int("s_suppkey % 16"), _int("s_suppkey % 2")).alias("signature"))
    r = F.get("e.records", F.lit(1))
    return e.select("s_suppkey", *[F.col(f"e.{c}").alias(c) for c in ("level", "sniffs", "half_life", "floor")], _text(r["tree"]).alias("tree"), r["complexity"].alias("complexity"), r["chirality"].alias("chirality"), "signature")


# --- diagram


def _points(spark, sf_dir) -> DataFrame:
    """Paths of four points for each part."""
    xy = lambda k: F.struct(_int(f"(p_partkey * {k} + p_size) % 200").alias("x"), _int(f"(p_partkey + p_size * {k}) % 200").alias("y"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array(xy(1), xy(3), xy(3), xy(7)).alias("pts"))


def dir_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    a, b = F.get("pts", F.lit(0)), F.get("pts", F.lit(1))
    return p.select("p_partkey", F.explode(C.segment_steps(a["x"], a["y"], b["x"], b["y"])).alias("d")).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("sum"), F.min("d").alias("least"), F.max("d").alias("most"))


def diagram_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of paths, and the points they draw: corners of diagonals are points too, so ends are compared."""
    p = _points(spark, sf_dir).withColumn("w", C.diagram_words(F.col("pts"), F.struct(F.lit(3).alias("width"), F.lit(6).alias("colour"), F.lit(1).alias("dash"))))
    ends = C.diagram_points(F.col("w"))
    last = F.element_at(ends, -1)
    return p.select("p_partkey", F.get("w", F.lit(1)).alias("move_x"), F.get("w", F.lit(2)).alias("move_y"), last["x"].alias("x"), last["y"].alias("y"), F.aggregate(F.filter("w", lambda w: F.shiftright(w, 10).bitwiseAND(3) == 2), F.lit(0), lambda a, w: a + w.bitwiseAND(127)).alias("drawn"), F.element_at("w", -2).alias("colour"))


# --- music and voice


def music_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    stroke = C.sound_stroke(W.MUSIC, _int("p_partkey % 120"), _int("p_size % 60"), F.expr("array_repeat(0, cast(1 + p_size % 4 as int))"), anchor=F.when(F.col("p_partkey") % 2 == 0, _int("p_partkey % 120")))
    return p.select("p_partkey", _text(F.concat(C.music_meta(_int("p_size % 16"), F.lit(8), _int("p_size % 13 - 6"), F.col("p_size") + 60.5), stroke)).alias("words"))


def voice_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    controls = [(1, _int("p_size % 20"), 15), (2, F.when(F.col("p_partkey") % 3 == 0, F.lit(4)), 15), (4, _int("p_size % 9"), 7)]
    stroke = C.sound_stroke(W.VOICE, _int("p_partkey % 500"), F.lit(1), F.array(F.lit(0), F.lit(6)), controls)
    return p.select("p_partkey", _text(F.concat(C.voice_meta(F.lit(0.02), F.lit(3)), stroke)).alias("words"))


def sound_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    stroke = lambda x, a: C.sound_stroke(W.MUSIC, _int(x), _int("p_size % 60"), F.expr("array_repeat(0, cast(1 + p_size % 4 as int))"), anchor=a)
    w = F.concat(C.music_meta(F.lit(3), F.lit(4), F.lit(0), F.lit(90.0)), stroke("p_partkey % 100 + 7", _int("p_partkey % 100")), stroke("p_partkey % 100 + 8", F.lit(None).cast("int")))
    s = p.select("p_partkey", w.alias("w")).select("p_partkey", F.posexplode(C.sound_strokes(W.MUSIC, F.col("w"))).alias("k", "s"))
    return s.select("p_partkey", "k", F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.col("s.steps").cast("long").alias("steps"))


# --- temporal events: streams on a grid of 50 ms, so that clocks never overshoot


def _temporal(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order))
    one = F.struct(F.expr("k * 150L + k % 3 * 50L").alias("start_ms"), _int("user_id % 16").alias("channel"), _int("event_id % 128").alias("pitch"), _int("k div 4 % 3").alias("program"), _int("event_id % 100").alias("velocity"), _int("50 * (event_id % 40)").alias("duration_ms"))
    return e.groupBy("user_id").agg(C.temporal_words(F.collect_list(one)).alias("words"))


def temporal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.size(F.filter("words", lambda w: F.shiftright(w, 12).bitwiseAND(3) == k)).cast("long")
    wait = F.aggregate(F.filter("words", lambda w: F.shiftright(w, 12).bitwiseAND(3) == 2), F.lit(0), lambda a, w: a + w.bitwiseAND(4095)).cast("long")
    return _temporal(spark, sf_dir).select("user_id", kind(0).alias("notes"), kind(1).alias("durations"), kind(3).alias("programs"), wait.alias("frames"))


def temporal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _temporal(spark, sf_dir).select("user_id", F.explode(C.temporal_events(F.col("words"))).alias("e"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("e.start_ms").alias("starts"), F.sum("e.pitch").alias("pitches"), F.sum("e.program").alias("programs"), F.sum("e.velocity").alias("velocities"), F.sum("e.duration_ms").alias("durations"))


# --- images: an embedding is an 8 by 8 image


def _pixels(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "v"))
    level = F.floor(F.abs(F.col("v").cast("double")) * 300).cast("int") % 256
    return e.select("image_id", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), level.alias("r"), (255 - level).alias("g"), (level % 64).alias("b"))


def quantise_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return p.groupBy("image_id").agg(F.sum(I.quantised(F.col("r"))).alias("r"), F.sum(I.quantised(F.col("g"), 2)).alias("g"), F.sum(I.truncated(F.col("b"))).alias("b"), F.sum(I.thresholded(F.col("r"))).alias("dark"))


def quadtree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _pixels(spark, sf_dir).select("image_id", "x", "y", *[I.quantised(F.col(c)).alias(c) for c in "rgb"])
    return I.leaves(I.padded(q), 2500.0).select("image_id", "path", "r", "g", "b")


def quadtree_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.encoded(_pixels(spark, sf_dir), 2500.0)
    n = lambda k: F.size(F.filter("words", lambda w: (w.bitwiseAND(0x200) == 0) & (F.shiftright(w, 6).bitwiseAND(7) == k))).cast("long")
    return e.select("image_id", n(4).alias("paints"), n(6).alias("backtracks"), (n(0) + n(1) + n(2) + n(3)).alias("descents"), _text(F.slice("words", 1, 10)).alias("header"))


def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images split down to pixels come back as they were quantised."""
    p = _pixels(spark, sf_dir)
    back = I.decoded(I.encoded(p, 0.0)).where("error is null")
    placed = lambda c: F.sum(F.col(c) * (1 + F.col("x") + 8 * F.col("y"))).alias(c)
    return back.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *[placed(c) for c in "rgb"])


def image_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    q = p.select("image_id", "x", "y", *[I.quantised(F.col(c), 2).alias(c) for c in "rgb"])
    return I.psnr(p, q).select("image_id", F.rint(F.col("psnr") * 1e6).cast("long").alias("psnr"))


def image_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as they are, with a step back too many, with a second header, with a word of another family."""
    e = I.encoded(_pixels(spark, sf_dir), 2500.0)
    more = F.when(F.col("image_id") % 4 == 1, F.array(F.lit(524288 + 0x0400 + 384 + 1))).when(F.col("image_id") % 4 == 2, F.array(F.lit(524288 + 0x0400 + 448))).when(F.col("image_id") % 4 == 3, F.array(F.lit(524288 + 0x0800 + 256)))
    return I.grammar(e.select("image_id", F.concat("words", F.coalesce(more, F.expr("cast(array() as array<int>)"))).alias("words")))


def _w(version: int, payload: str) -> str:
    return f"({524288 + version * 65536} + ({payload}))::int::varchar"


def _list(*parts: str) -> str:
    return "concat_ws(',', " + ", ".join(parts) + ")"


_SMELL_D = "list_transform(range(1, 2 + s_suppkey % 7), lambda i: (s_suppkey + i) % 8)"
_SMELL_STEPS = f"array_to_string(list_transform({_SMELL_D}, lambda d, i: 524288 + 512 + 128 + d * 8 + least(i - 1, 3)), ',')"
_UNIT = lambda e: f"greatest(0.0::double, least(1.0::double, {e}))"
_AX = lambda ws: "least(7, greatest(0, round_even((" + " + ".join(f"({w})::double * {_UNIT(f'q[{i + 1}]')}" for i, w in enumerate(ws)) + f" - ({sum(min(0.0, w) for w in ws)!r})::double) / ({sum(max(0.0, w) for w in ws) - sum(min(0.0, w) for w in ws)!r})::double * 7.0, 0)))::int"
_DIR = lambda dx, dy: "case " + " ".join(f"when sign({dx}) = {x} and sign({dy}) = {y} then {i}" for i, (x, y) in enumerate(C.STEPS)) + " end"
_G = "(['Ester', ' thiol', 'aromatic', 'ketone', 'wax', 'amine '])[((s_suppkey * {k}) % 6 + 1)::int]"
_PIX = "px as (select vec_id as image_id, k % 8 as x, k // 8 as y, floor(abs(v::double) * 300)::int % 256 as r from (select vec_id, unnest(embedding) as v, unnest(range(0, 64)) as k from embeddings)), pix as (select image_id, x, y, r, 255 - r as g, r % 64 as b from px)"
_Q = lambda c, d=3: f"round_even(round_even({c} / 255.0::double * {2**d - 1}, 0) / {2**d - 1}.0::double * 255, 0)::int"
_TREE = """lv as (select *, unnest(range(0, 4)) as level from sq), nd as (select image_id, level, x >> (3 - level)::int as nx, y >> (3 - level)::int as ny, count(*)::double as n, sum(r) as sr, sum(g) as sg, sum(b) as sb, sum(r * r) as qr, sum(g * g) as qg, sum(b * b) as qb from lv group by all),
ps as (select *, array_to_string(list_transform(range(1, level + 1), lambda k: ((ny >> (level - k)::int) & 1) * 2 + ((nx >> (level - k)::int) & 1)), '') as path from nd where level = 3 or (0.0::double + (qr / n - pow(sr / n, 2)) + (qg / n - pow(sg / n, 2)) + (qb / n - pow(sb / n, 2))) / 3 <= 2500),
lf as (select image_id, path, round_even(sr / n, 0)::int as r, round_even(sg / n, 0)::int as g, round_even(sb / n, 0)::int as b from ps a where not exists (select 1 from ps p where p.image_id = a.image_id and length(p.path) < length(a.path) and starts_with(a.path, p.path)))"""
_SQ = lambda where: f"sq as (select i.image_id, gx.x, gy.y, coalesce(q.r, 0) as r, coalesce(q.g, 0) as g, coalesce(q.b, 0) as b from (select distinct image_id from pix) i, (select unnest(range(0, 8)) as x) gx, (select unnest(range(0, 8)) as y) gy left join (select image_id, x, y, {_Q('r')} as r, {_Q('g')} as g, {_Q('b')} as b from pix {where}) q on q.image_id = i.image_id and q.x = gx.x and q.y = gy.y)"
_EV = "ev as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from events), t as (select user_id, k * 150 + k % 3 * 50 as start_ms, k, event_id % 128 as pitch, k // 4 % 3 as program, event_id % 100 as velocity, 50 * (event_id % 40) as duration_ms from ev)"
_M12 = "(case when p_partkey % 2 = 0 then 12 else 8 end)"

ORACLES = {
    "taste_pack": "select p_partkey, " + _list(_w(0, "1024 + p_size % 8 * 8 + p_partkey % 8"), _w(1, "1024 + p_size // 3 % 8 * 8 + p_partkey % 5"), _w(2, "1024 + p_partkey % 256"), _w(2, "1024 + p_partkey * 7 % 256"), f"case when p_size % 2 = 0 then {_w(3, '1024 + p_size * 3 % 256')} end") + " as words from part",
    "taste_unpack": "select p_partkey, 2::bigint as n, (2 * (p_size % 8 * 8 + p_partkey % 8))::bigint as quality, (2 * (p_size // 3 % 8 * 8 + p_partkey % 5))::bigint as force, (p_partkey % 256)::varchar || ',' || (p_partkey * 7 % 256)::varchar as temporal, case when p_size % 2 = 0 then (p_size * 3 % 256)::varchar else '' end as flavor from part",
    "smell_pack": "select s_suppkey, " + _list(_w(0, "512 + 192 + 9"), _w(0, "512 + s_suppkey % 8 * 8 + s_nationkey % 8"), _w(0, "512 + 64 + s_suppkey // 8 % 8 * 8 + 1 + s_suppkey % 7"), _SMELL_STEPS) + " as words from supplier",
    "smell_unpack": f"select s_suppkey, (s_suppkey % 8)::int as category, s_nationkey % 8 as pleasantness, (s_suppkey // 8 % 8)::int as intensity, array_to_string({_SMELL_D}, ',') as directions from supplier",
    "augmented_pack": "select s_suppkey, " + _list(_w(0, "512 + s_suppkey % 8 * 8 + 3"), _w(0, "512 + 64 + 34"), _w(0, "512 + 128 + 16"), _w(0, "512 + 128 + s_suppkey % 8 * 8 + 1"), _w(0, "512 + 192 + s_suppkey % 4 + s_nationkey % 4 * 4 + s_suppkey // 4 % 4 * 16"), _w(0, "512 + 192 + s_suppkey % 2 * 16 + s_suppkey % 16")) + " as words from supplier",
    "odor_projection": f"""with x as (select vec_id, unnest(range(0, (len(embedding) - 1) // 5 + 1)) as part, embedding from embeddings), e as (select vec_id, part, list_transform(embedding[5 * part + 1:5 * part + 5], lambda v: abs(v::double)) as q from x) select vec_id, part, {_AX(C.PLEASANT_WEIGHTS)} as pleasantness, {_AX(C.INTENSE_WEIGHTS)} as intensity,
least(7, greatest(0, round_even(({_UNIT('q[1]')} - 0.15::double * {_UNIT('q[3]')}) * 7.0, 0)))::int as pleasantness3, least(7, greatest(0, round_even(({_UNIT('q[2]')} + 0.1::double * {_UNIT('q[3]')}) * 7.0, 0)))::int as intensity3 from e""",
    "odor_walks": "with s as (select s_suppkey, (s_suppkey % 8)::int as p0, s_nationkey % 8 as i0, case when s_suppkey % 8 >= 5 then [2, 1, 0, 6] when s_suppkey % 8 <= 2 then [2, 3, 4, 6] else [2, 2, 4, 6] end as d from supplier)"
    + "".join(f", s{k} as (select s_suppkey, d, least(7, greatest(0, p{k - 1} + ({[x for x, _ in C.STEPS]})[d[{k}] + 1])) as p{k}, least(7, greatest(0, i{k - 1} - ({[y for _, y in C.STEPS]})[d[{k}] + 1])) as i{k} from s{k - 1 if k > 1 else ''})" for k in range(1, 5))
    + " select s_suppkey, p4 as p, i4 as i, 5::bigint as n from s4",
    "nearest_directions": f"select c_custkey, {_DIR('c_custkey % 5 - 2', 'c_nationkey % 5 - 2')} as direction from customer",
    "adaptation_decay": """with c as (select c_custkey, (c_custkey % 8)::int as i0, c_nationkey % 16 as hl, c_custkey // 8 % 16 as fl, unnest([0, 1, 2, 3, 4]) as sniff from customer), f as (select *, least(7, round_even(fl / 15.0::double * 7.0, 0)) as low from c)
select c_custkey, sniff, case when sniff = 0 then i0 else least(7, greatest(0, round_even(low + greatest(0.0, i0 - low) * pow(0.5::double, sniff::double / greatest(1, hl)), 0)))::int end as intensity from f""",
    "molecular_bridge": f"""with s as (select s_suppkey, list_distinct(list_transform([{_G.format(k=1)}, {_G.format(k=5)}, {_G.format(k=7)}], lambda g: lower(trim(g)))) as g, (s_suppkey * 13 % 300)::double as w, s_suppkey % 4 * 0.5::double as v from supplier),
k as (select *, len(g) + list_contains(g, 'aromatic')::int + (w >= 150)::int as score from s)
select s_suppkey, concat_ws(',', case when list_has_any(g, {list(C.AVERSIVE)}) then 0 when list_has_any(g, {list(C.PLEASANT)}) then 1 else 0 end, case when v >= 1.6 then 2 else 3 end, case when score <= 2 then 0 when score <= 4 then 1 else 2 end) as tree,
cast(round_even(greatest(0.0::double, least(1.0::double, 0.55::double * (least(6.0::double, len(g)::double) / 6.0::double) + 0.35::double * least(1.0::double, w / 220.0::double) + case when list_contains(g, 'aromatic') then 0.15::double else 0.0::double end)) * 1e6, 0) as bigint) as hint from k""",
    "touch_pack": "select c_custkey, " + _list(_w(1, "2048 + c_custkey % 4 * 512 + c_nationkey % 16 * 32 + 31"), _w(0, "2048 + (c_custkey + 1) % 8 * 8 + c_custkey % 8"), _w(0, "2048 + (c_custkey + 2) % 8 * 8 + c_nationkey % 8"), _w(0, "2048 + (c_custkey + 3) % 8 * 8")) + " as words from customer",
    "touch_unpack": "with c as (select *, unnest([0, 1]) as k from customer) select c_custkey, k, ((c_custkey + k) % 4)::int as receptor, c_nationkey % 16 as region, concat_ws(',', (c_custkey + 1) % 8, (c_custkey + 2) % 8, (c_custkey + 3) % 8) as directions, (c_custkey % 8) || ',0,0' as pressures from c",
    "touch_frames": "select c_custkey, " + _list(_w(2, "2048 + 256 + 32 + c_custkey % 16"), *[_w(2, "2048 + 768 + (c_custkey % 4096 >> 6)"), _w(2, "2048 + 1024 + (c_custkey % 4096 & 63)"), _w(1, "2048 + c_custkey % 4 * 512 + c_nationkey % 16 * 32 + 31"), _w(0, "2048 + c_custkey % 8 * 8 + 5")] * 2) + " as words, (c_custkey % 4096)::int as delta from customer",
    "vibration_pack": "select c_custkey, " + _list(_w(3, "2048 + 512 + c_custkey % 16 * 16 + c_custkey // 16 % 16"), _w(3, "2048 + 768 + c_custkey % 4 * 16 + c_nationkey % 16")) + " as words from customer",
    "proprio_quantise": "with c as (select c_custkey, c_custkey * 37 % 1801 / 10.0::double as angle from customer), q as (select *, round_even(angle / 180.0::double * 255.0::double, 0)::int as q from c) select c_custkey, " + _list(_w(2, "2048 + 1280 + 192 + c_custkey % 14"), _w(2, "2048 + 1280 + 192 + (q >> 2)"), _w(2, "2048 + 1280 + 192 + (q & 3) * 16 + c_custkey % 16")) + " as words, cast(round_even(abs(q / 255.0::double * 180.0::double - angle) * 1e6, 0) as bigint) as error from q",
    "region_lookup": "with d(region, name, x, y, z) as (values " + ", ".join(f"({i}, '{n}', {x}, {y}, {z})" for i, (n, (x, y, z)) in enumerate(C.REGIONS.items())) + ") select name, x, y, z, count(*) as n from customer join d on region = c_nationkey % 16 group by all",
    "mental_pack": f"""with p as (select *, {_M12} as m, (p_partkey % 8)::int as d0, case when {_M12} = 12 then 16 else 32 end as most from part),
r as (select *, case when d0 = 1 then [[1, p_size + 2], [2, 1]] else [[d0, p_size], [1, 2], [2, 1]] end as raw from p),
c as (select *, flatten(list_transform(raw, lambda a: list_transform(range(0, (a[2] + most - 1) // most), lambda k: [a[1], least(most, a[2] - k * most)]))) as runs from r)
select p_partkey, concat_ws(',', 786432 + 256 + p_partkey % 4 * 1024 + (p_size % 4 >> 1) * 512 + (p_size % 4 & 1) * 128 + p_partkey % 8 * 16 + 4 + case when m = 12 then 2 else 0 end, 851968 + (256 | (p_partkey % 256)), 917504 + 256 + 128, 983040 + (256 | len(runs)),
case when p_partkey % 3 = 0 then 983040 + 256 + 2048 + p_size end, 983040 + 256 + 512 + p_size % 256, array_to_string(list_transform(runs, lambda u: 589824 + 256 + case when m = 12 then u[1] * 16 else u[1] * 32 end + u[2] - 1), ',')) as words from c""",
    "mental_unpack": "select p_partkey, (p_partkey % 4)::int as form, p_size % 4 as symmetry, (p_partkey % 8)::int as frequency, 1 as speed, (p_partkey % 256)::int as x, 128 as y, case when p_partkey % 3 = 0 then p_size end as frame, p_size % 256 as delta, array_to_string(list_concat(list_transform(range(0, p_size), lambda i: p_partkey % 8), [1, 1, 2]), ',') as directions from part",
    "odor_episodes": "select s_suppkey, (s_suppkey % 3)::int as level, 2 as sniffs, (s_suppkey % 16)::int as half_life, s_nationkey % 16 as floor, concat_ws(',', s_suppkey % 4, s_nationkey % 4, s_suppkey // 4 % 4) as tree, (s_suppkey % 16)::int as complexity, (s_suppkey % 2)::int as chirality, concat_ws(',', s_suppkey % 8, 3, 4, 2, s_suppkey % 4, s_nationkey % 4, s_suppkey // 4 % 4, s_suppkey % 16, s_suppkey % 2) as signature from supplier",
    "dir_steps": f"""with p as (select p_partkey, (p_partkey + p_size) % 200 as x0, (p_partkey + p_size) % 200 as y0, (p_partkey * 3 + p_size) % 200 as x1, (p_partkey + p_size * 3) % 200 as y1 from part), s as (select *, x1 - x0 as dx, y1 - y0 as dy, unnest(range(1, greatest(abs(x1 - x0), abs(y1 - y0)) + 1)) as k from p),
u as (select p_partkey, case when k <= abs(dx) then sign(dx) else 0 end as ux, case when k <= abs(dy) then sign(dy) else 0 end as uy from s), d as (select p_partkey, {_DIR('ux', 'uy')} as d from u) select p_partkey, count(*) as n, sum(d)::bigint as sum, min(d) as least, max(d) as most from d group by p_partkey""",
    "diagram_pack": "select p_partkey, (524288 + 32768 + (p_partkey + p_size) % 200)::int as move_x, (524288 + 32768 + 1024 + (p_partkey + p_size) % 200)::int as move_y, ((p_partkey * 7 + p_size) % 200)::int as x, ((p_partkey + p_size * 7) % 200)::int as y, (greatest(abs((p_partkey * 3 + p_size) % 200 - (p_partkey + p_size) % 200), abs((p_partkey + p_size * 3) % 200 - (p_partkey + p_size) % 200)) + greatest(abs((p_partkey * 7 + p_size) % 200 - (p_partkey * 3 + p_size) % 200), abs((p_partkey + p_size * 7) % 200 - (p_partkey + p_size * 3) % 200)) + 1)::int as drawn, 524288 + 32768 + 1024 + 6 as colour from part",
    "music_pack": "select p_partkey, concat_ws(',', 524288 + 16384 + 512 + (p_size % 16 * 8 + 7), 524288 + 16384 + 512 + 128 + p_size % 13 - 6 + 64, 524288 + 16384 + 512 + 256 + least(127, round_even(p_size + 60.5::double, 0)::int), case when p_partkey % 2 = 0 then 524288 + 16384 + 1024 + p_partkey % 120 end, 524288 + 16384 + 1, 524288 + 16384 + 1024 + case when p_partkey % 2 = 0 then 0 else p_partkey % 120 end, 524288 + 16384 + 2048 + p_size % 60, array_to_string(list_transform(range(0, 1 + p_size % 4), lambda i: 524288 + 16384 + 3072 + 1), ','), 524288 + 16384) as words from part",
    "voice_pack": "select p_partkey, concat_ws(',', 524288 + 8192 + 512 + 1, 524288 + 8192 + 512 + 128 + 20, 524288 + 8192 + 512 + 256 + 3, 524288 + 8192 + 1024 + 128 + least(15, p_size % 20), case when p_partkey % 3 = 0 then 524288 + 8192 + 1024 + 256 + 4 end, 524288 + 8192 + 1024 + 512 + least(7, p_size % 9), 524288 + 8192 + 1, 524288 + 8192 + 1024 + p_partkey % 500, 524288 + 8192 + 2048 + 1, 524288 + 8192 + 3072 + 1, 524288 + 8192 + 3072 + 6 * 128 + 1, 524288 + 8192) as words from part",
    "sound_unpack": "with p as (select *, unnest([0, 1]) as k from part) select p_partkey, k, (p_partkey % 100 + 7 + k)::int as x, p_size % 60 as y, (1 + p_size % 4)::bigint as steps from p",
    "temporal_encode": f"""with {_EV}, g as (select *, lag(program) over (partition by user_id order by start_ms) as was, start_ms - coalesce(lag(start_ms) over (partition by user_id order by start_ms), 0) as delta from t)
select user_id, count(*) as notes, sum((greatest(1, duration_ms // 50) + 30) // 31)::bigint as durations, count(*) filter (was is distinct from program) as programs, sum(delta // 50)::bigint as frames from g group by user_id""",
    "temporal_decode": f"with {_EV} select user_id, count(*) as n, sum(start_ms)::bigint as starts, sum(pitch)::bigint as pitches, sum(program)::bigint as programs, sum(velocity)::bigint as velocities, sum(greatest(50, duration_ms))::bigint as durations from t group by user_id",
    "quantise_rgb": f"with {_PIX} select image_id, sum({_Q('r')})::bigint as r, sum({_Q('g', 2)})::bigint as g, sum((b >> 5) << 5)::bigint as b, sum((r < 128)::int)::bigint as dark from pix group by image_id",
    "quadtree_leaves": f"with {_PIX}, {_SQ('')}, {_TREE} select image_id, path, r, g, b from lf",
    "quadtree_words": f"""with {_PIX}, {_SQ('')}, {_TREE}, o as (select *, lag(path) over (partition by image_id order by path) as was from lf),
s as (select image_id, path, was, coalesce(len(list_filter(range(1, least(length(path), length(was)) + 1), lambda k: path[1:k] = was[1:k])), 0) as shared from o)
select image_id, count(*) as paints, sum(length(path) - shared)::bigint as backtracks, sum(length(path) - shared)::bigint as descents, concat_ws(',', 524288 + 1024 + 448, 524288 + 1536, 524288 + 1536 + 64 + 8, 524288 + 1536 + 128, 524288 + 1536 + 192 + 8, 524288 + 1536 + 256, 524288 + 1536 + 320 + 8, 524288 + 1536 + 384 + 3, 524288 + 1536 + 448 + (25000 & 63), 524288 + 1024 + 449) as header from s group by image_id""",
    "image_roundtrip": f"with {_PIX} select image_id, count(*) as n, {', '.join(f'sum({_Q(c)} * (1 + x + 8 * y))::bigint as {c}' for c in 'rgb')} from pix group by image_id",
    "image_psnr": f"with {_PIX}, m as (select image_id, avg((0.0::double + pow((r - {_Q('r', 2)})::double, 2) + pow((g - {_Q('g', 2)})::double, 2) + pow((b - {_Q('b', 2)})::double, 2)) / 3) as mse from pix group by image_id) select image_id, cast(round_even(case when mse = 0 then 99.0 else 10 * log10(65025.0::double / mse) end * 1e6, 0) as bigint) as psnr from m",
    "image_grammar": "select vec_id as image_id, vec_id % 4 != 1 as balanced, vec_id % 4 != 1 as no_underflow, 1 + (vec_id % 4 = 2)::bigint as headers, 1 + (vec_id % 4 = 3)::bigint as families from embeddings",
}
QUERIES = {
    f.__name__: f
    for f in (
        taste_pack, taste_unpack, smell_pack, smell_unpack, augmented_pack, odor_projection, odor_walks, nearest_directions, adaptation_decay, molecular_bridge, touch_pack, touch_unpack, touch_frames, vibration_pack, proprio_quantise,
        region_lookup, mental_pack, mental_unpack, odor_episodes, dir_steps, diagram_pack, music_pack, voice_pack, sound_unpack, temporal_encode, temporal_decode, quantise_rgb, quadtree_leaves, quadtree_words, image_roundtrip, image_psnr, image_grammar,
    )
}
