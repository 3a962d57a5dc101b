"""Files of streams and of the modalities' documents, read where they lie and written as they were.

Every reader gives rows with a fixed schema, an unreadable document no row or a row with its error, never a failure.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import wave
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from math import atan2, cos, pi, sin, sqrt, tan

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyweft.functions import words as W
from polyweft.operators import streams as S


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(path).select("path", "content")


# --- word streams


def read_words_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, word) of files of 4-byte big-endian words."""
    return _binary(spark, path).select("path", F.posexplode(W.from_transport_bytes(F.col("content"))).alias("pos", "word"))


def read_words_json(spark: SparkSession, path: str, valid: bool = True) -> DataFrame:
    """(stream_id, pos, word) of JSON arrays, a file each; stream_id is the path.

    ``valid`` false keeps elements that are no words, for ``streams.validation``: integers as they are, all else as null.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("stream_id"), F.col("value").alias("json"))
    rows = S.from_json(whole)
    if valid:
        return rows.where("word is not null").select("stream_id", "pos", "word")
    return rows.select("stream_id", "pos", F.coalesce("word", F.when((F.col("kind") == "BIGINT") & F.col("n").between(-(2**31), 2**31 - 1), F.col("n")).cast("int")).alias("word"))


def write_words_json(streams: DataFrame, path: str) -> None:
    """One JSON array a line, with its stream."""
    streams.select("stream_id", W.json_text(F.col("words")).alias("words")).write.mode("overwrite").json(path)


def write_words_binary(streams: DataFrame, path: str) -> None:
    """The bytes of each stream as a Parquet column; ``transport_files`` gives plain files of few streams."""
    streams.select("stream_id", W.transport_bytes(F.col("words")).alias("bytes")).write.mode("overwrite").parquet(path)


def compressed_size(content: Column) -> Column:
    """The length of the content as gzip of level 9, through Arrow."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else len(gzip.compress(bytes(b), 9, mtime=0)))

    return F.pandas_udf(run, "long")(content)


# --- fixtures of taste, scenarios, telemetry

TASTE = "dominant_quality int, secondary_quality int, intensity int, intensity_direction int, temporal_payload array<int>, flavor_payload array<int>"


def read_taste_events(spark: SparkSession, path: str) -> DataFrame:
    """Event rows of a JSON document: an object with events, or a bare list."""
    raw = spark.read.text(path, wholetext=True).select("value")
    parsed = raw.select(F.coalesce(F.from_json("value", f"struct<events:array<struct<{TASTE}>>>")["events"], F.from_json("value", f"array<struct<{TASTE}>>")).alias("events"))
    return parsed.select(F.posexplode("events").alias("pos", "e")).select("pos", "e.*")


def read_taste_manifest(spark: SparkSession, path: str, corpus: str = "minimum_closure") -> DataFrame:
    """(record_id, pos, word) of a manifest's corpus, under its short or long name, by record id."""
    short = corpus.removesuffix("_corpus")
    part = "struct<encoded_words_by_record:map<string,array<int>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{short}:{part},{short}_corpus:{part}>").alias("m"))
    records = raw.select(F.explode(F.coalesce(F.col(f"m.{short}"), F.col(f"m.{short}_corpus"))["encoded_words_by_record"]).alias("record_id", "words"))
    return records.select("record_id", F.posexplode("words").alias("pos", "word"))


SCENARIO = "scenario string, category string, profile string, kind string, dataset_or_fixture string, iterations int, warmup_iterations int, text string, bpe_tokens array<int>, image_size int, svg string"


def read_scenarios(spark: SparkSession, folder: str, profile: str | None = None, limit: int | None = None) -> DataFrame:
    """Scenario rows of a folder of JSON documents with defaults filled, of one profile, the first ones by name."""
    rows = spark.read.schema(SCENARIO).json(folder, multiLine=True).withColumns({"profile": F.coalesce("profile", F.lit("baseline")), "iterations": F.coalesce("iterations", F.lit(1)), "warmup_iterations": F.coalesce("warmup_iterations", F.lit(0))})
    rows = rows.where(F.col("profile") == profile) if profile else rows
    return rows.orderBy("scenario").limit(limit) if limit else rows


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Completed scenarios of an event log with their progress; malformed lines are dropped."""
    log = spark.read.schema("event_index long, event_type string, phase string, run_id string, scenario string, throughput_tokens_per_sec double").option("mode", "DROPMALFORMED").json(path)
    done = log.where("phase = 'scenario_complete'")
    from pyspark.sql import Window

    w = Window.partitionBy("run_id")
    return done.withColumn("progress", F.row_number().over(w.orderBy("event_index")) / F.count(F.lit(1)).over(w))


# --- drawings


def _matrix(text: str | None) -> list[float]:
    m = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = [float(x) for x in re.findall(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", args)]
        if name == "matrix" and len(v) == 6:
            n = v
        elif name == "translate":
            n = [1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0]
        elif name == "scale":
            n = [v[0], 0, 0, v[1] if len(v) > 1 else v[0], 0, 0]
        elif name == "rotate":
            a = v[0] * pi / 180
            n = [cos(a), sin(a), -sin(a), cos(a), 0, 0]
            if len(v) > 2:  # about a point
                n[4:] = [v[1] - n[0] * v[1] - n[2] * v[2], v[2] - n[1] * v[1] - n[3] * v[2]]
        elif name in ("skewX", "skewY") and v:
            n = [1, 0, tan(v[0] * pi / 180), 1, 0, 0] if name == "skewX" else [1, tan(v[0] * pi / 180), 0, 1, 0, 0]
        else:
            continue
        m = [m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5]]
    return m


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in re.findall(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", text or "")]


def _curve(points: list[tuple[float, float]], step: float) -> list[tuple[float, float]]:
    """A Bezier curve of any degree by points at most ``step`` apart."""
    length = sum(sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) for a, b in zip(points, points[1:]))
    n = max(1, int(np.ceil(length / step)))
    out = []
    for i in range(n + 1):
        level, t = points, i / n
        while len(level) > 1:
            level = [((1 - t) * a[0] + t * b[0], (1 - t) * a[1] + t * b[1]) for a, b in zip(level, level[1:])]
        out.append(level[0])
    return out


def arc(a: tuple[float, float], b: tuple[float, float], rx: float, ry: float, turn: float, large: bool, sweep: bool, step: float) -> list[tuple[float, float]]:
    """Points of an elliptical arc from ``a`` to ``b``, at most ``step`` apart; ``turn`` in degrees.

    The centre follows from both ends. Radii that are too short to reach are scaled up; one of no length makes a line.
    """
    rx, ry, phi = abs(rx), abs(ry), turn * pi / 180
    if not rx or not ry or a == b:
        return [a, b] if a != b else [a]
    # half the chord in the ellipse's own axes, as a circle of radius 1 sees it
    hx, hy = (a[0] - b[0]) / 2, (a[1] - b[1]) / 2
    ux, uy = (cos(phi) * hx + sin(phi) * hy) / rx, (-sin(phi) * hx + cos(phi) * hy) / ry
    reach = ux * ux + uy * uy
    if reach > 1:
        rx, ry, ux, uy, reach = rx * sqrt(reach), ry * sqrt(reach), ux / sqrt(reach), uy / sqrt(reach), 1.0
    off = sqrt(max(0.0, 1 / reach - 1)) * (1 if large != sweep else -1)
    cx, cy = off * uy, -off * ux  # the centre in that circle, seen from the chord's middle
    begin, end = atan2(uy - cy, ux - cx), atan2(-uy - cy, -ux - cx)
    turned = (end - begin) % (2 * pi)
    if not sweep:
        turned -= 2 * pi
    n = max(1, int(np.ceil(abs(turned) * max(rx, ry) / step)))
    place = lambda t: (rx * (cos(t) + cx), ry * (sin(t) + cy))
    middle = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    points = [place(begin + turned * i / n) for i in range(n + 1)]
    points = [(cos(phi) * x - sin(phi) * y + middle[0], sin(phi) * x + cos(phi) * y + middle[1]) for x, y in points]
    return [a, *points[1:-1], b]


_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
_ARC = re.compile(r"[\s,]*".join([f"({_NUMBER})"] * 3 + ["([01])"] * 2 + [f"({_NUMBER})"] * 2))  # flags may stand without a space


def _path(d: str, step: float) -> list[list[tuple[float, float]]]:
    lines: list[list[tuple[float, float]]] = []
    at, begin = (0.0, 0.0), (0.0, 0.0)
    handle = {"C": None, "Q": None}  # the last control point, if the command before was a curve of its kind
    need = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    for op, args in re.findall(r"([MmLlHhVvCcSsQqTtAaZz])((?:[eE](?=[-+0-9])|[^A-Za-z])*)", d):
        up, rel = op.upper(), op.islower()
        v = [float(x) for row in _ARC.findall(args) for x in row] if up == "A" else _numbers(args)
        k = need[up]
        for i in range(0, max(1, len(v)), k or 1):
            a = v[i : i + k]
            if len(a) < k:
                break
            kind = {"C": "C", "S": "C", "Q": "Q", "T": "Q"}.get(up)
            pts = [(a[j] + at[0] * rel, a[j + 1] + at[1] * rel) for j in range(0, k - 1, 2)] if k > 1 and up != "A" else []
            if up in "ST":  # the control point that mirrors the last one
                last = handle[kind] or at
                pts.insert(0, (2 * at[0] - last[0], 2 * at[1] - last[1]))
            if up == "M" and i == 0:
                begin = pts[0]
                lines.append([begin])
            elif up == "Z":
                pts = [begin]
            elif up == "H":
                pts = [(a[0] + at[0] * rel, at[1])]
            elif up == "V":
                pts = [(at[0], a[0] + at[1] * rel)]
            elif up == "A":
                pts = [(a[5] + at[0] * rel, a[6] + at[1] * rel)]
                lines[-1] += arc(at, pts[0], *a[:3], bool(a[3]), bool(a[4]), step)[1:]
            if up != "A" and not (up == "M" and i == 0):
                lines[-1] += _curve([at, *pts], step)[1:]
            handle = {c: pts[-2] if c == kind else None for c in handle}
            at = pts[-1]
    return lines


def _shape(tag: str, e: dict[str, str], step: float) -> list[list[tuple[float, float]]]:
    f = lambda k: float(_numbers(e.get(k, "0"))[0] if _numbers(e.get(k, "0")) else 0)
    if tag == "line":
        return [_curve([(f("x1"), f("y1")), (f("x2"), f("y2"))], step)]
    if tag in ("polyline", "polygon", "rect"):
        v = _numbers(e.get("points"))
        pts = list(zip(v[::2], v[1::2])) if tag != "rect" else [(f("x"), f("y")), (f("x") + f("width"), f("y")), (f("x") + f("width"), f("y") + f("height")), (f("x"), f("y") + f("height"))]
        if tag != "polyline" and pts:
            pts.append(pts[0])
        return [[pts[0], *(p for a, b in zip(pts, pts[1:]) for p in _curve([a, b], step)[1:])]] if pts else []
    if tag in ("circle", "ellipse"):
        rx, ry = (f("r"), f("r")) if tag == "circle" else (f("rx"), f("ry"))
        n = max(8, int(np.ceil(2 * pi * max(rx, ry) / step)))
        return [[(f("cx") + rx * cos(2 * pi * i / n), f("cy") + ry * sin(2 * pi * i / n)) for i in range(n + 1)]]
    return _path(e.get("d", ""), step) if tag == "path" else []


def svg_polylines(text: str, step: float = 2.0, canvas: int = 256, border: int = 4) -> list[dict]:
    """Polylines of a drawing scaled into the canvas: points, stroke, width, fill. An element's transform is applied to what its ancestors' nearest one is, and once more for its own."""
    found = []

    def walk(node: ET.Element, given: dict[str, str]) -> None:
        own = dict(node.attrib)
        own |= {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in own.get("style", "").split(";")) if v}
        now = given | {k: own[k] for k in ("stroke", "stroke-width", "fill", "transform") if k in own}
        m = _matrix(now.get("transform"))
        twice = _matrix(own.get("transform")) if "transform" in own else None
        for line in _shape(node.tag.rpartition("}")[2], own, step):
            for t in (m, twice):
                if t:
                    line = [(t[0] * x + t[2] * y + t[4], t[1] * x + t[3] * y + t[5]) for x, y in line]
            if len(line) > 1:
                found.append({"points": line, "stroke": now.get("stroke"), "width": _numbers(now["stroke-width"])[0] if _numbers(now.get("stroke-width")) else None, "fill": now.get("fill")})
        for child in node:
            walk(child, now)

    walk(ET.fromstring(text), {})
    if found:
        xs, ys = zip(*(p for f in found for p in f["points"]))
        scale = (canvas - 2 * border) / max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
        for f in found:
            f["points"] = [((x - min(xs)) * scale + border, (y - min(ys)) * scale + border) for x, y in f["points"]]
            f["width"] = f["width"] * scale if f["width"] is not None else None
    return found


def svg_points(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, pt, x, y, stroke, width, fill) of drawings in a text column; malformed ones give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[column]):
                try:
                    lines = svg_polylines(text or "")
                except (ET.ParseError, ValueError, IndexError):
                    continue
                rows += [(k, i, j, x, y, f["stroke"], f["width"], f["fill"]) for i, f in enumerate(lines) for j, (x, y) in enumerate(f["points"])]
            yield pd.DataFrame(rows, columns=[key, "path", "pt", "x", "y", "stroke", "width", "fill"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, column).mapInPandas(run, f"{key} {kind}, path int, pt int, x double, y double, stroke string, width double, fill string")


def svg_text(points: DataFrame, key: str, canvas: int = 256) -> DataFrame:
    """(key, svg): drawings of paths of two points or more."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pt", "x", "y"))), lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string")))
    lines = points.groupBy(key, "path").agg(F.array_join(ordered, " ").alias("pts"), F.count(F.lit(1)).alias("n"), F.first("stroke", True).alias("stroke"), F.first("width", True).alias("width"), F.first("fill", True).alias("fill")).where("n >= 2")
    element = F.format_string('<polyline points="%s" stroke="%s" stroke-width="%s" fill="%s"/>', "pts", F.coalesce("stroke", F.lit("black")), F.coalesce(F.col("width").cast("string"), F.lit("1")), F.coalesce("fill", F.lit("none")))
    body = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", element.alias("e")))), lambda p: p["e"]), "").alias("body"))
    return body.select(key, F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{canvas}" height="{canvas}">'), "body", F.lit("</svg>")).alias("svg"))


# --- scores and recordings

# fixed values: semitones of the note names
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
NOTES = "path string, part string, idx int, onset int, duration int, pitch int, is_rest boolean"


def _notes(content: bytes) -> list[tuple]:
    root = ET.fromstring(content)
    out = []
    for part in root.iter():
        if part.tag.rpartition("}")[2] != "part":
            continue
        divisions, tick, i = 1, 0, 0
        for e in part.iter():
            tag = e.tag.rpartition("}")[2]
            if tag == "divisions":
                divisions = int(e.text or 1) or 1
            if tag != "note":
                continue
            get = lambda n: next((x.text for x in e.iter() if x.tag.rpartition("}")[2] == n), None)  # noqa: E731,B023
            quarters = max(1, round(int(get("duration") or divisions) / divisions))
            rest = any(x.tag.rpartition("}")[2] == "rest" for x in e)
            pitch = 60 if rest or not get("step") else (int(get("octave") or 4) + 1) * 12 + SEMITONES.get(get("step"), 0) + int(get("alter") or 0)
            out.append((part.get("id"), i, tick, quarters, pitch, rest))
            tick += quarters
            i += 1
    return out


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, idx, onset, duration, pitch, is_rest) in quarters, notes one after the other; malformed scores give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, c in zip(batch["path"], batch["content"]):
                try:
                    rows += [(p, *n) for n in _notes(bytes(c))]
                except (ET.ParseError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in NOTES.split(", ")])

    return _binary(spark, path).mapInPandas(run, NOTES)


def musicxml_text(notes: DataFrame, key: str) -> DataFrame:
    """(key, xml): a score of each key's notes (part, onset, pitch, duration); notes of one onset are a chord of the longest duration."""
    chords = notes.groupBy(key, "part", "onset").agg(F.sort_array(F.collect_set("pitch")).alias("pitches"), F.max("duration").alias("duration"))
    names = F.array(*[F.lit(n) for n in ("C", "C", "D", "D", "E", "F", "F", "G", "G", "A", "A", "B")])
    sharp = F.array(*[F.lit(v) for v in (0, 1, 0, 1, 0, 0, 1, 0, 1, 0, 1, 0)])
    note = lambda p, i: F.concat(
        F.lit("<note>"), F.when(i > 0, "<chord/>").otherwise(""), F.lit("<pitch><step>"), F.get(names, p % 12), F.lit("</step><alter>"), F.get(sharp, p % 12).cast("string"), F.lit("</alter><octave>"),
        (F.floor(p / 12) - 1).cast("string"), F.lit("</octave></pitch><duration>"), F.col("duration").cast("string"), F.lit("</duration></note>"),
    )
    drawn = chords.withColumn("x", F.array_join(F.transform("pitches", note), ""))
    parts = drawn.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("onset", "x"))), lambda n: n["x"]), "").alias("m"))
    part = F.concat(F.lit('<part id="'), F.coalesce("part", F.lit("P1")), F.lit('"><measure number="1"><attributes><divisions>1</divisions></attributes>'), "m", F.lit("</measure></part>"))
    return parts.groupBy(key).agg(F.concat(F.lit('<score-partwise version="3.1">'), F.array_join(F.sort_array(F.collect_list(part)), ""), F.lit("</score-partwise>")).alias("xml"))


def _frames(content: bytes) -> list[float]:
    with wave.open(io.BytesIO(content)) as f:
        width, channels = f.getsampwidth(), f.getnchannels()
        raw = np.frombuffer(f.readframes(f.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
    raw = raw - 128 if width == 1 else raw
    mono = raw.reshape(-1, channels).mean(1)
    mono = mono / (np.abs(mono).max() or 1.0)
    size = max(128, len(mono) // 64)
    return [float(np.sqrt((mono[i : i + size] ** 2).mean())) for i in range(0, len(mono), size)]


def read_wav_energy(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, rms) of recordings, mono and at full scale; unreadable ones give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, c in zip(batch["path"], batch["content"]):
                try:
                    rows += [(p, i, r) for i, r in enumerate(_frames(bytes(c)))]
                except (wave.Error, EOFError, KeyError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "frame", "rms"])

    return _binary(spark, path).mapInPandas(run, "path string, frame int, rms double")


def alignment_segments(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, idx, label, start, end) of alignment JSON under several key names: swapped times put right, at least 1 ms, silences dropped."""
    fields = "start double, begin double, t0 double, `end` double, stop double, t1 double, phone string, label string, symbol string, text string"
    rows = documents.select(key, F.posexplode(F.coalesce(F.from_json(column, f"array<struct<{fields}>>"), F.from_json(column, f"struct<segments:array<struct<{fields}>>>")["segments"])).alias("idx", "s"))
    a, b = F.coalesce("s.start", "s.begin", "s.t0"), F.coalesce("s.end", "s.stop", "s.t1")
    label = F.upper(F.regexp_replace(F.coalesce("s.phone", "s.label", "s.symbol", "s.text"), "[^A-Za-z0-2]", ""))
    out = rows.select(key, "idx", label.alias("label"), F.least(a, b).alias("start"), F.greatest(a, b).alias("stop"))
    return out.where("start is not null and stop is not null and label not in ('', 'SIL', 'SP', 'PAU')").withColumn("stop", F.greatest(F.col("stop"), F.col("start") + 0.001))


# --- images


def _png_rows(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG of 8 bits a channel, without interlace."""
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    width, height = (int.from_bytes(head[k : k + 4], "big") for k in (0, 4))
    depth, colour, interlace = head[8], head[9], head[12]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        raise ValueError("only 8 bits a channel without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width * channels + channels), np.int64)  # a row above and a pixel to the left, of zeros
    for y in range(height):
        rule, line, above = raw[y, 0], raw[y, 1:].astype(np.int64), out[y]
        if rule == 2:
            line = line + above[channels:]
        elif rule:  # these look at the pixel to the left, one after another
            own = np.zeros(width * channels + channels, np.int64)
            for x in range(channels, len(own)):
                left, up, corner = int(own[x - channels]), int(above[x]), int(above[x - channels])
                guess = left + up - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
                own[x] = (int(line[x - channels]) + {1: left, 3: (left + up) // 2, 4: near}[int(rule)]) & 255
            line = own[channels:]
        out[y + 1, channels:] = line & 255
    image = out[1:, channels:].reshape(height, width, channels)
    return palette[image[..., 0]].astype(np.int64) if colour == 3 else image


def _netpbm(data: bytes) -> np.ndarray:
    """(height, width, channels) of a portable grey or colour map, plain or raw, of a byte a channel."""
    head = re.match(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    kind, width, height, most = (int(g) for g in head.groups())
    if not 0 < most < 256:
        raise ValueError("only a byte a channel")
    channels = 3 if kind in (3, 6) else 1
    n, rest = width * height * channels, data[head.end() :]
    values = np.array(rest.split()[:n], np.int64) if kind < 4 else np.frombuffer(rest[:n], np.uint8).astype(np.int64)
    return (values.reshape(height, width, channels) * 255 + most // 2) // most


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, v, error) of image files, PNG or portable maps: grey values by luma; a file that is none, or of another kind, is one row with its error, and one of no bytes no row.

    Files are read by Spark and decoded where they lie, one image at a time; see ``operators.rasters`` for sizes and thresholds.
    """

    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            try:
                image = _png_rows(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _netpbm(data)
                if image.shape[2] > 2:
                    grey = (image[..., 0] * 19595 + image[..., 1] * 38470 + image[..., 2] * 7471 + 0x8000) >> 16
                else:
                    grey = image[..., 0]
                rows.append((image.shape[1], grey.ravel().tolist(), None))
            except Exception as e:  # whatever a broken file makes of a decoder
                rows.append((None, None, f"no image that can be read: {type(e).__name__}"))
        return pd.DataFrame(rows, columns=["width", "values", "error"]).astype({"width": "Int32"})

    made = _binary(spark, path).select("path", F.pandas_udf(run, "width int, values array<int>, error string")("content").alias("i"))
    at = made.select("path", "i.error", "i.width", F.posexplode_outer("i.values").alias("k", "v"))
    return at.select("path", F.expr("cast(k % width as int)").alias("x"), F.expr("cast(k div width as int)").alias("y"), "v", "error")


# --- emoji primitives and maps

PRIMITIVE = T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("style_bits", T.IntegerType()), T.StructField("strokes", T.ArrayType(T.ArrayType(T.IntegerType())))])


def read_primitives(spark: SparkSession, path: str) -> DataFrame:
    """Stroke primitives of a JSON document: an object with primitives, or a bare list."""
    raw = spark.read.text(path, wholetext=True).select("value")
    kind = PRIMITIVE.simpleString()
    return raw.select(F.explode(F.coalesce(F.from_json("value", f"struct<primitives:array<{kind}>>")["primitives"], F.from_json("value", f"array<{kind}>"))).alias("p")).select("p.*")


MACRO = "struct<emoji:string,name:string,macro_id:int,primitives:array<string>,notes:string>"


def read_macros(spark: SparkSession, path: str) -> DataFrame:
    """(emoji, name, macro_id, primitives, notes) of a JSON document with macros; a missing name is the key, a missing number 0, missing primitives none."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"struct<macros:array<{MACRO}>>")["macros"]).alias("k", "m")).orderBy("k")
    none = F.array().cast("array<string>")
    return raw.select("m.emoji", F.coalesce("m.name", "m.emoji").alias("name"), F.coalesce("m.macro_id", F.lit(0)).alias("macro_id"), F.coalesce("m.primitives", none).alias("primitives"), F.coalesce("m.notes", F.lit("")).alias("notes"))


def metric_files(metrics: DataFrame, folder: str) -> None:
    """Metrics as JSON, a folder for each scenario."""
    metrics.write.mode("overwrite").partitionBy("scenario").json(folder)


def markdown(metrics: DataFrame, limit: int = 1000) -> str:
    """A report table of at most ``limit`` rows."""
    rows = metrics.limit(limit).collect()
    head = "| " + " | ".join(metrics.columns) + " |\n" + "|---" * len(metrics.columns) + "|\n"
    return head + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows)


def demo_info() -> str:
    return json.dumps({"labels": list(W.LABELS), "word_max": W.WORD_MAX})
