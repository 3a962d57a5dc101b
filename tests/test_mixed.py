"""Whole streams of several modalities with malformed blocks, the builder's errors, batches and readers of files."""

import json

import pytest
from pyspark.sql import functions as F

from polyweft.adapters import WordBatches
from polyweft.functions import strokes as K
from polyweft.functions import words as W
from polyweft.operators import images as I
from polyweft.operators import metrics as M
from polyweft.operators import mixed, streams
from polyweft.sources import files
from polyweft.storage import written


def test_images_of_a_stream_paint_or_vanish(spark):
    pixels = spark.createDataFrame([(1, x, y, 255, 0, 36 * (x + y)) for x in range(3) for y in range(2)], "image_id long, x int, y int, r int, g int, b int")
    words = I.encoded(pixels, 0.0).first().words
    rows = [(1, [65, *words, 66]), (2, [65, *words[:-1], 66]), (3, [])]
    df = spark.createDataFrame(rows, "stream_id long, words array<int>")
    got = {r.stream_id: r for r in mixed.decoded(streams.from_arrays(df)).collect()}
    assert set(got) == {1, 2} and got[1].text == got[2].text == "AB" and got[1].valid
    (block,) = got[1].image_blocks
    assert (block.value.width, block.value.height) == (3, 2) and block.value.pixels[:3] == [255, 0, 0]
    assert got[2].image_blocks == [] and got[2].n_image == len(words) - 1


def test_decoded_streams_keep_going(spark):
    rows = [(1, 0, 72), (1, 1, None), (1, 2, 1 << 20), (1, 3, 0x10041), (1, 4, 105), (1, 5, 0x84000)]
    r = mixed.decoded(spark.createDataFrame(rows, "stream_id long, pos int, word int")).first()
    assert (r.text, r.word_count, r.valid) == ("Hi", 6, False) and len(r.errors) == 3 and len(r.music_blocks) == 1


def test_builder(spark):
    df = spark.createDataFrame([("ő", [1, 2]), (None, None)], "t string, k array<int>")
    b = mixed.Builder().text(F.col("t")).tokens(F.col("k"))
    got = [r.w for r in df.select(b.build().alias("w")).collect()]
    assert got[0][0] == ord("o") and got[0][-2:] == [0x81001, 0x81002] and got[1] == [] and len(b.words(F.array(F.lit(7)))._parts) == 3
    with pytest.raises(Exception, match="out of range"):
        df.select(mixed.Builder().words(F.array(F.lit(1 << 20))).build()).collect()


def test_a_stream_of_all_modalities(spark):
    """Built in one expression, stored, and read back block by block."""
    pixels = spark.createDataFrame([(1, x, y, 255 * (x % 2), 40 * y, 7) for x in range(4) for y in range(4)], "image_id long, x int, y int, r int, g int, b int")
    sound, steps = "array<struct<x:int,y:int,directions:array<int>,anchor:int>>", "array<struct<form:int,symmetry:int,frequency:int,speed:int,x:int,y:int,directions:array<int>,frame:int,delta:int>>"
    tunes, lines = [(4, 60, [0, 0], None), (130, 62, [0], 100)], [(4, 1, [0, 0, 1], 4)]
    forms = [(2, 1, 3, 1, 10, 200, [0, 0, 0, 7, 1], 9, 12)]
    event = [(1, 2, 3, 4, [9, 8], [7])]
    df = spark.createDataFrame([(1, "Café 🙂", [100, 300], [(2.0, 2.0), (9.0, 2.0), (9.0, 5.0)], tunes, lines, forms, event), (2, None, None, None, None, None, None, None)],
        f"id long, t string, k array<int>, line array<struct<x:double,y:double>>, tunes {sound}, lines {sound}, forms {steps}, events array<struct<dominant:int,secondary:int,intensity:int,direction:int,temporal:array<int>,flavor:array<int>>>")
    df = df.join(I.encoded(pixels, 0.0).withColumnRenamed("image_id", "id"), "id", "left")
    c = F.col
    b = mixed.Builder().text(c("t")).drawing(c("line")).music(c("tunes"), F.lit(4), F.lit(4), F.lit(0), F.lit(120.0)).voice(c("lines"), F.lit(0.05), F.lit(8)).image(c("words")).tokens(c("k")).mental(c("forms"))
    has = c("t").isNotNull()
    ints = lambda *xs: F.when(has, F.array(*[F.lit(x) for x in xs]))
    b = b.touch(F.when(has, 1), F.when(has, 3), ints(0, 1), ints(2, 3)).smell(F.when(has, 2), F.when(has, 5), F.when(has, 4), ints(1, 0, 6)).taste(c("events"))
    made = written(df.select(c("id").alias("stream_id"), b.build().alias("words")), "all-modalities")
    assert {r.stream_id: len(r.words) for r in made.collect()}[2] == 0
    r = mixed.decoded(streams.from_arrays(made)).first()
    assert (r.stream_id, r.text, r.tokens, r.valid) == (1, "Café 🙂", [100, 300], True)
    assert all(r[f"n_{m}"] > 0 for m in W.LABELS) and all(len(r[f"{m}_blocks"]) == 1 for m in mixed.READERS)
    assert [(s.x, s.y, s.steps) for s in r.music_blocks[0].value] == [(4, 60, 2), (130, 62, 1)]
    assert [(s.x, s.y, s.steps) for s in r.voice_blocks[0].value] == [(4, 1, 3)]
    (m,) = r.mental_blocks[0].value
    assert (m.form, m.symmetry, m.frequency, m.speed, m.x, m.y, m.directions, m.frame, m.delta) == forms[0]
    assert (r.image_blocks[0].value.width, r.image_blocks[0].value.height) == (4, 4)
    assert r.touch_blocks[0].value[0].pressures == [2, 3] and r.smell_blocks[0].value[0].directions == [1, 0, 6] and r.taste_blocks[0].value[0].temporal == [9, 8]
    with pytest.raises(Exception, match="no image"):
        df.where("id = 1").select(mixed.Builder().image(F.array(F.lit(65))).build()).collect()


def test_batches_and_series(spark):
    df = spark.createDataFrame([("abc",), ("",)], "text string")
    got = [(r.input_ids, r.attention_mask) for r in WordBatches(max_length=2, pad_to=3, pad=9).transform(df).collect()]
    assert got == [([97, 98, 9], [1, 1, 0]), ([9, 9, 9], [0, 0, 0])]
    with pytest.raises(ValueError):
        WordBatches(max_length=0)
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "k int, i int, v double")
    with pytest.raises(Exception, match="differ in length"):
        M.max_error(a, a.where("i = 0"), "k", "i", "v").collect()
    none = K.anchored_touch(F.array(F.lit(65)))
    assert a.limit(1).select(none.alias("x")).first().x is None


def test_nearest_points_equal_all_pairs(spark):
    a = [(i % 2, float(i * 37 % 101), float(i * 53 % 97)) for i in range(120)] + [(0, 5.0, 5.0)] * 3 + [(0, 9000.0, -400.0), (7, 1.0, 1.0)]
    b = [(i % 2, float(i * 31 % 89), float(i * 17 % 61)) for i in range(15)]
    frame = lambda rows: spark.createDataFrame(rows, "k int, x double, y double")
    got = {r.k: r.mean_distance for r in M.nearest_mean(frame(a), frame(b), "k").collect()}
    near = lambda k, x, y: min(((x - p) ** 2 + (y - q) ** 2) ** 0.5 for j, p, q in b if j == k)
    want = {k: sum(near(*p) for p in a if p[0] == k) / sum(p[0] == k for p in a) for k in (0, 1)}
    assert got == pytest.approx(want)


def test_nearest_points_over_wide_extents(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, x double, y double")
    far = frame([(1, 0.0, 0.0), (1, 3e9, 4e9), (1, 1.0, 0.0)])
    assert M.nearest_mean(far, frame([(1, 0.0, 0.0)]), "k").first().mean_distance == pytest.approx((5e9 + 1) / 3)
    assert M.nearest_mean(far.limit(0), frame([(1, 0.0, 0.0)]), "k").count() == 0
    with pytest.raises(ValueError, match="finite"):
        M.nearest_mean(frame([(1, float("inf"), 0.0)]), frame([(1, 0.0, 0.0)]), "k")


def test_command_line(spark, tmp_path, capsys):
    from polyweft.__main__ import main

    def run(*args):
        code = main(list(args))
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("info") == (0, {"labels": list(W.LABELS), "word_max": W.WORD_MAX})
    code, told = run("demo")
    assert code == 0 and told["valid"] and told["n_text"] == told["total_words"] == 12
    (tmp_path / "good.json").write_text("[72, 105, 528461]")
    (tmp_path / "bad.json").write_text("[72, 1048576]")
    (tmp_path / "none.json").write_text("[]")
    code, told = run("validate", str(tmp_path / "good.json"))
    assert code == 0 and told["valid"] and told["n_bpe"] == 1
    code, told = run("validate", str(tmp_path / "bad.json"))
    assert code == 1 and not told["valid"] and "out of range" in told["errors"][0]
    assert run("validate", str(tmp_path / "none.json"))[0] == 1
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_readers_of_scenarios_telemetry_and_words(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps([{"scenario": "b", "text": "x"}, {"scenario": "a", "profile": "heavy", "iterations": 3}]))
    rows = files.read_scenarios(spark, str(tmp_path / "s")).orderBy("scenario").collect()
    assert [(r.scenario, r.profile, r.iterations) for r in rows] == [("a", "heavy", 3), ("b", "baseline", 1)]
    assert files.read_scenarios(spark, str(tmp_path / "s"), profile="heavy", limit=1).count() == 1
    lines = [{"event_index": i, "phase": p, "run_id": "r", "scenario": "s"} for i, p in enumerate(["start", "scenario_complete", "scenario_complete"])]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    assert [r.progress for r in files.read_telemetry(spark, str(tmp_path / "t.jsonl")).orderBy("event_index").collect()] == [0.5, 1.0]
    df = spark.createDataFrame([(1, [65, 66]), (2, [])], "stream_id long, words array<int>")
    files.write_words_json(df, str(tmp_path / "j"))
    files.write_words_binary(df, str(tmp_path / "b"))
    assert {r.stream_id: r.words for r in spark.read.json(str(tmp_path / "j")).collect()} == {1: "[65, 66]", 2: "[]"}
    back = spark.read.parquet(str(tmp_path / "b")).select("stream_id", W.from_transport_bytes(F.col("bytes")).alias("w")).collect()
    assert {r.stream_id: r.w for r in back} == {1: [65, 66], 2: []}
