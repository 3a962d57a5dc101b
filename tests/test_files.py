"""Readers and writers over small files, good and malformed, and sessions as streams."""

import json
import wave

import numpy as np
from pyspark.sql import functions as F

from polyweft.sources import files
from polyweft.streaming import sessions as S


def test_binary_and_json(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes.fromhex("000000410010000000000042AA"))
    assert [(r.pos, r.word) for r in files.read_words_binary(spark, str(tmp_path / "a.bin")).orderBy("pos").collect()] == [(0, 65), (1, 66)]
    (tmp_path / "a.json").write_text('[65, "x", 66]')
    assert sorted((r.pos, r.word) for r in files.read_words_json(spark, str(tmp_path / "a.json")).collect()) == [(0, 65), (2, 66)]


def test_taste_fixtures(spark, tmp_path):
    event = {"dominant_quality": 1, "secondary_quality": 2, "intensity": 3, "intensity_direction": 4, "temporal_payload": [9], "flavor_payload": []}
    (tmp_path / "t.json").write_text(json.dumps({"events": [event]}))
    (tmp_path / "u.json").write_text(json.dumps([event]))
    for name in "tu":
        assert files.read_taste_events(spark, str(tmp_path / f"{name}.json")).first().temporal_payload == [9]
    (tmp_path / "m.json").write_text(json.dumps({"expanded_corpus": {"encoded_words_by_record": {"b": [2], "a": [1, 3]}}}))
    rows = files.read_taste_manifest(spark, str(tmp_path / "m.json"), "expanded").orderBy("record_id", "pos").collect()
    assert [r.word for r in rows] == [1, 3, 2]


def test_svg(spark):
    good = '<svg xmlns="http://www.w3.org/2000/svg"><g stroke="red"><rect x="0" y="0" width="10" height="5"/><path d="M0 0 L10 10 h5 z"/><circle cx="5" cy="5" r="3" transform="translate(1,1)"/></g></svg>'
    df = spark.createDataFrame([(1, good), (2, "<svg"), (3, None)], "k long, svg string")
    pts = files.svg_points(df, "k", "svg")
    assert {r.k for r in pts.collect()} == {1} and pts.select("path").distinct().count() == 3
    box = pts.agg(F.min("x"), F.max("x")).first()
    assert abs(box[0] - 4) < 1e-6 and abs(box[1] - 252) < 1e-6
    text = files.svg_text(pts, "k").first().svg
    assert text.count("<polyline") == 3 and 'stroke="red"' in text


def test_musicxml(spark, tmp_path):
    note = "<note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>4</duration></note>"
    (tmp_path / "s.musicxml").write_text(f'<score-partwise><part id="P1"><measure><attributes><divisions>2</divisions></attributes>{note}<note><rest/><duration>2</duration></note></measure></part></score-partwise>')
    (tmp_path / "bad.musicxml").write_text("<score")
    rows = files.read_musicxml(spark, str(tmp_path / "*.musicxml")).orderBy("idx").collect()
    assert [(r.onset, r.duration, r.pitch, r.is_rest) for r in rows] == [(0, 2, 61, False), (2, 1, 60, True)]
    xml = files.musicxml_text(spark.createDataFrame([("d", "P1", 0, 61, 2), ("d", "P1", 0, 64, 1)], "k string, part string, onset int, pitch int, duration int"), "k").first().xml
    assert xml.count("<note>") == 2 and xml.count("<chord/>") == 1


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.sin(np.arange(8000) / 5) * np.linspace(0, 30000, 8000)).astype("<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"nothing")
    rows = files.read_wav_energy(spark, str(tmp_path / "*.wav")).orderBy("frame").collect()
    assert len(rows) >= 60 and rows[-1].rms > rows[0].rms


def test_alignment(spark):
    text = json.dumps([{"start": 0.5, "end": 0.2, "phone": "ah1"}, {"begin": 1, "stop": 1, "label": "B"}, {"t0": 2, "t1": 3, "symbol": "sil"}])
    rows = files.alignment_segments(spark.createDataFrame([(1, text), (2, "x")], "k long, a string"), "k", "a").orderBy("idx").collect()
    assert [(r.label, r.start, r.stop) for r in rows] == [("AH1", 0.2, 0.5), ("B", 1.0, 1.001)]


def test_sessions_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("s", 0, "Caf"), ("s", 1, "é"), ("t", 0, "日本")], "session string, idx long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session string, idx long, text string").parquet(str(tmp_path / "in"))
    q = S.sessions(S.encoded_chunks(source)).writeStream.format("memory").queryName("sess").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.session: (r.text, r.token_mismatch) for r in spark.table("sess").collect()}
    assert got["t"] == ("日本", 0) and got["s"][0] == "Café"
    # a state with a timeout asks for batches for ever: one is enough
    n = S.counted(source.select("session", "text")).writeStream.format("memory").queryName("cnt").outputMode("append").trigger(once=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert n.awaitTermination(90)
    assert sorted((r.session, r.idx) for r in spark.table("cnt").collect()) == [("s", 0), ("s", 1), ("t", 0)]
