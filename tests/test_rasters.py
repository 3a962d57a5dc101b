"""Pen strokes, pixels, thresholds, image files and arcs against plain recomputation."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyweft.operators import rasters as R
from polyweft.sources import files


def plain_strokes(lines, grid):
    out = []
    for line in lines:
        places = []
        for x, y in line:
            p = tuple(max(0, min(grid - 1, round(v))) for v in (x, y))
            if not places or places[-1] != p:
                places.append(p)
        if len(places) > 1:
            out += [(0, 0, False)] * bool(out) + [(*places[0], False)] + [(b[0] - a[0], b[1] - a[1], True) for a, b in zip(places, places[1:])]
    return out


def plain_pixels(steps, canvas, grid):
    scale, at, out = (canvas - 1) / max(grid - 1, 1), None, set()
    for dx, dy, pen in steps:
        if not pen:
            at = (dx, dy) if dx or dy else at
        elif at:
            to = (at[0] + dx, at[1] + dy)
            x, y, x1, y1 = (round(v * scale) for v in (*at, *to))
            sx, sy, ex, ey = (1 if x < x1 else -1), (1 if y < y1 else -1), abs(x1 - x), -abs(y1 - y)
            error = ex + ey
            while True:
                if 0 <= x < canvas and 0 <= y < canvas:
                    out.add((x, y))
                if (x, y) == (x1, y1):
                    break
                twice = 2 * error
                if twice >= ey:
                    error, x = error + ey, x + sx
                if twice <= ex:
                    error, y = error + ex, y + sy
            at = to
    return out


@pytest.mark.parametrize("canvas,grid", [(256, 64), (50, 64), (9, 1)])
def test_strokes_and_pixels(spark, canvas, grid):
    rng = random.Random(6)
    number = lambda: rng.choice((rng.uniform(-20, 90), rng.randrange(0, 4) + 0.5, 0.0))
    drawings = [[[(number(), number()) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(4))] for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(drawings)), "drawing_id long, lines array<array<struct<x:double,y:double>>>")
    made = df.select("drawing_id", R.pen_strokes(F.col("lines"), grid).alias("steps"))
    want = [plain_strokes(d, grid) for d in drawings]
    assert {r.drawing_id: [tuple(s) for s in r.steps] for r in made.collect()} == dict(enumerate(want))
    got = {}
    for r in R.drawn(made, canvas, grid).collect():
        got.setdefault(r.drawing_id, set()).add((r.x, r.y))
    assert got == {i: p for i, s in enumerate(want) if (p := plain_pixels(s, canvas, grid))}


def test_thresholds(spark):
    rng = random.Random(4)
    images = {i: [rng.choice((rng.randrange(40, 60), rng.randrange(150, 255))) for _ in range(30)] for i in range(20)} | {20: [7] * 4, 21: [0, 255]}
    df = spark.createDataFrame([(i, k % 6, k // 6, v) for i, vs in images.items() for k, v in enumerate(vs)] + [(22, 0, 0, None)], "image_id int, x int, y int, v int")

    def plain(vs):
        best = (-1.0, 0)
        for t in range(min(vs), max(vs)):
            low, high = [v for v in vs if v <= t], [v for v in vs if v > t]
            between = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            best = max(best, (round(between, 6), -t))
        return -best[1] if best[0] >= 0 else vs[0]

    assert {r.image_id: r.threshold for r in R.thresholds(df).collect()} == {i: plain(vs) for i, vs in images.items()}
    assert R.binarised(df, 100).where("on").count() == sum(v < 100 for vs in images.values() for v in vs)


def test_resizing(spark):
    px = [(1, x, y, 10 * x + y) for x in range(4) for y in range(2)]
    df = spark.createDataFrame(px, "image_id int, x int, y int, v int")
    small = {(r.x, r.y): r.v for r in R.resized(df, 2).collect()}
    assert small == {(0, 0): 5, (1, 0): 25, (0, 1): 6, (1, 1): 26}
    large = {(r.x, r.y): r.v for r in R.resized(df, 8).collect()}
    assert len(large) == 64 and all(large[x, y] == 10 * (x // 2) + y // 4 for x, y in large)


def png(image, colour, rules, palette=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, channels = image.shape
    flat, raw = image.reshape(height, -1).astype(int), b""
    for y in range(height):
        rule = rules[y % len(rules)]
        left = np.concatenate((np.zeros(channels, int), flat[y, :-channels]))
        up = flat[y - 1] if y else np.zeros_like(flat[y])
        corner = np.concatenate((np.zeros(channels, int), up[:-channels]))
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        best = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        raw += bytes([rule]) + ((flat[y] - {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: best}[rule]) % 256).astype(np.uint8).tobytes()
    body = chunk(b"PLTE", palette) if palette else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + body + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    colour, grey = rng.integers(0, 256, (7, 5, 3)), rng.integers(0, 256, (4, 6, 1))
    luma = lambda im: (im[..., 0] * 19595 + im[..., 1] * 38470 + im[..., 2] * 7471 + 0x8000) >> 16
    palette = bytes(rng.integers(0, 256, 768).tolist())
    alpha = np.concatenate((colour, rng.integers(0, 256, (7, 5, 1))), 2)
    made = {
        "a.png": (png(colour, 2, [0, 1, 2, 3, 4]), luma(colour)), "b.png": (png(grey, 0, [4, 3, 2, 1]), grey[..., 0]), "c.png": (png(grey, 3, [1], palette), luma(np.frombuffer(palette, np.uint8).reshape(-1, 3)[grey[..., 0]].astype(int))), "d.png": (png(alpha, 6, [4]), luma(colour)),
        "e.pgm": (b"P5 # a remark\n6 4\n255\n" + grey.astype(np.uint8).tobytes(), grey[..., 0]), "f.ppm": (b"P3\n5 7\n255\n" + " ".join(map(str, colour.ravel())).encode(), luma(colour)),
    }
    for name, (data, _) in made.items():
        (tmp_path / name).write_bytes(data)
    for name, data in (("x.png", made["a.png"][0][:60]), ("y.png", b""), ("z.txt", b"hello")):
        (tmp_path / name).write_bytes(data)
    got, errors = {}, {}
    for r in files.read_images(spark, str(tmp_path)).collect():
        name = r.path.rsplit("/", 1)[-1]
        if r.error:
            errors[name] = r.v
        else:
            got.setdefault(name, {})[r.x, r.y] = r.v
    assert errors == {"x.png": None, "z.txt": None}  # Spark gives no row for a file of no bytes
    for name, (_, values) in made.items():
        assert got[name] == {(x, y): int(values[y, x]) for y in range(values.shape[0]) for x in range(values.shape[1])}, name


def test_arcs():
    quarter = files.arc((10, 0), (0, 10), 10, 10, 0, False, True, 1.0)
    assert quarter[0] == (10, 0) and quarter[-1] == (0, 10) and all(math.isclose(math.hypot(*p), 10) for p in quarter)
    assert all(math.dist(a, b) <= 1.0 for a, b in zip(quarter, quarter[1:])) and all(x >= -1e-9 and y >= -1e-9 for x, y in quarter)
    rest = files.arc((10, 0), (0, 10), 10, 10, 0, True, False, 1.0)
    assert all(math.isclose(math.hypot(*p), 10) for p in rest) and min(x for x, _ in rest) < -9.9
    other = files.arc((10, 0), (0, 10), 10, 10, 0, False, False, 1.0)
    assert all(math.isclose(math.dist(p, (10, 10)), 10) for p in other)
    tilted = files.arc((2, 0), (-2, 0), 2, 1, 30, False, True, 0.1)  # scaled up until it reaches: its middle is the chord's
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    sizes = [((c * x + s * y) / 2) ** 2 + (-s * x + c * y) ** 2 for x, y in tilted]
    assert max(sizes) - min(sizes) < 1e-9 and sizes[0] > 1
    assert files.arc((1, 1), (5, 1), 0, 3, 0, True, True, 1.0) == [(1, 1), (5, 1)] and files.arc((1, 1), (1, 1), 2, 2, 0, True, True, 1.0) == [(1, 1)]


def test_paths_with_arcs_and_smooth_curves():
    path = lambda d: files._path(d, 0.5)
    assert path("M0,0a5 5 0 0110 0z") == path("M 0 0 A 5 5 0 0 1 10 0 L 0 0")
    assert path("M0 0 C0 10 10 10 10 0 S20 -10 20 0") == path("M0 0 C0 10 10 10 10 0 C10 -10 20 -10 20 0")
    assert path("M0 0 Q5 10 10 0 T20 0 T30 0") == path("M0 0 Q5 10 10 0 Q15 -10 20 0 Q25 10 30 0")
    assert path("M0 0 S5 5 10 0") == path("M0 0 C0 0 5 5 10 0") and path("M0 0 L1e1 2") == path("M0 0 L10 2")
    assert files._matrix("skewX(45)") == pytest.approx([1, 0, 1, 1, 0, 0]) and files._matrix("rotate(90 1 1)") == pytest.approx([0, 1, -1, 0, 2, 0])
