"""Components and outlines against a plain flood fill and a plain walk."""

import random

import pytest

from polyweft.operators import graphs
from polyweft.operators import regions as R

SPIRAL = ("#########", "#.......#", "#.#####.#", "#.#...#.#", "#.#.#.#.#", "#.#.###.#", "#.#.....#", "#.#######")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(1, x, y, rng.random() < 0.55) for x in range(23) for y in range(17)]
    out += [(2, x, y, c == "#") for y, line in enumerate(SPIRAL) for x, c in enumerate(line)]
    out += [(3, 0, 0, True), (3, 0, 0, True), (4, 0, 0, False), (5, 0, 0, None)]
    out += [(6, 0, 0, True), (6, 1, 1, True), (6, 1, 0, False), (6, 0, 1, False)]  # two that meet at a corner
    return out + [(7, x, y, not (x == 2 and y == 2)) for x in range(5) for y in range(5)]  # a hole


@pytest.fixture(scope="module")
def pixels(spark, rows):
    return spark.createDataFrame(rows, "image_id long, x int, y int, on boolean")


def flood(rows):
    on = {r[:3] for r in rows if r[3]}
    out = {}
    for p in sorted(on, key=lambda p: (p[0], p[2], p[1])):
        if p not in out:
            out[p], todo = p[1:], [p]
            while todo:
                i, x, y = todo.pop()
                for q in ((i, x + 1, y), (i, x - 1, y), (i, x, y + 1), (i, x, y - 1)):
                    if q in on and q not in out:
                        out[q] = p[1:]
                        todo.append(q)
    return out


@pytest.mark.parametrize("tile", [3, 64])
def test_labels(pixels, rows, tile):
    labels = R.labelled(pixels, tile)
    got = {(r.image_id, r.x, r.y): (r.label % R.ROW, r.label // R.ROW) for r in labels.collect()}
    want = flood(rows)
    assert got == want
    for r in R.boxes(labels).collect():
        own = [p for p, name in want.items() if (p[0], *name) == (r.image_id, r.label % R.ROW, r.label // R.ROW)]
        xs, ys = [p[1] for p in own], [p[2] for p in own]
        assert (r.n, r.left, r.top, r.right, r.bottom) == (len(own), min(xs), min(ys), max(xs), max(ys))
        assert [(p.x, p.y) for p in r.outline] == [(r.left, r.top), (r.right, r.top), (r.right, r.bottom), (r.left, r.bottom), (r.left, r.top)]


@pytest.mark.parametrize("closed", [False, True])
def test_outlines(pixels, rows, closed):
    lines = {}
    for r in R.polylines(R.outlines(pixels, closed)).collect():
        points = [(p.x, p.y) for p in r.points]
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(points, points[1:]))
        assert points[0] == (r.outline.x, r.outline.y) and (points[0] == points[-1]) == r.closed
        assert r.closed or not closed
        lines.setdefault(r.image_id, []).append(points)
    # every border between a pixel that is on and one that is not is crossed once, by one outline
    for image in {r[0] for r in rows}:
        on = {r[1:3] for r in rows if r[0] == image and r[3]}
        size = [r[1:3] for r in rows if r[0] == image]
        wide, high = max(s[0] for s in size), max(s[1] for s in size)
        inside = lambda x, y: 0 <= x <= wide and 0 <= y <= high
        crossed = [p for points in lines.get(image, []) for p in (points[:-1] if points[0] == points[-1] else points)]
        near = lambda x, y: [(x + dx, y + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        want = {((x + a) / 2, (y + b) / 2) for x, y in on for a, b in near(x, y) if (a, b) not in on and (closed or inside(a, b))}
        if not closed:  # an image of one row or column has no cells
            want = want if wide and high else set()
        assert sorted(crossed) == sorted(want)
        # two outlines of a ring; corners keep pixels apart
        assert len(lines.get(image, [])) == {3: closed, 6: 2, 7: 1 + closed}.get(image, len(lines.get(image, [])))


def test_components_of_odd_graphs(spark):
    rng = random.Random(8)
    edges = [(1, i, i + 1) for i in range(200)] + [(2, 0, i) for i in range(1, 150)] + [(2, 5, 5), (2, 7, 0), (2, 0, 7)] + [(3, rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    got = {(r.image_id, r.node): r.root for r in graphs.components(spark.createDataFrame(edges, "image_id long, a long, b long")).collect()}
    want = {}
    for g, a, b in edges:
        if a != b:
            for n in (a, b):
                want.setdefault((g, n), n)
    for _ in range(300):
        for g, a, b in edges:
            if a != b:
                want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    assert got == want
    assert graphs.components(spark.createDataFrame([], "image_id long, a long, b long")).count() == 0


def test_ranks_of_chains_and_rings(spark):
    chains = [[9, 4, 7, 1, 30], [50, 40], list(range(100, 170))]
    rings = [[3, 8, 2], [20, 60, 25, 61, 26, 62, 27]]
    links = [(1, a, b) for c in chains for a, b in zip(c, c[1:])] + [(1, a, b) for c in rings for a, b in zip(c, c[1:] + c[:1])]
    got = {r.node: (r.first, r["rank"], r.closed) for r in graphs.ranks(spark.createDataFrame(links, "image_id long, node long, next long")).collect()}
    want = {n: (c[0], i, False) for c in chains for i, n in enumerate(c)}
    for c in rings:
        k = c.index(min(c))
        want |= {n: (min(c), i, True) for i, n in enumerate(c[k:] + c[:k])}
    assert got == want
