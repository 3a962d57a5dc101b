"""Image streams of several layouts against a plain reader that goes word by word."""

import random

import pytest

from polyweft.operators import families as M
from polyweft.operators import images as I

X = 524288


def plain_check(words):
    """Family and whether the stream fits its grammar, one word after another."""
    payloads = [w & 0xFFFF for w in words if w is not None and w >> 18 == 2 and w >> 16 & 3 == 0]
    marks = [p & 0xC00 for p in payloads]
    if not marks or marks[0] not in (0x800, 0x400):
        return None, False
    if len(set(marks)) > 1:
        return None, False
    legacy = marks[0] == 0x800
    depth, asked, told, opened, headers, values, sets, paints = 0, False, None, False, [0, 0], set(), 0, 0
    for p in payloads:
        code, arg = p >> 6 & 7, p & 63
        run = max(1, arg)
        if p & 0x200:
            if legacy:
                if not asked:
                    return "legacy", False
                asked = False
            elif opened:
                values.add(code)
            else:
                if told is None or code > 2 or code in told:
                    return "enhanced", False
                told = None if len(told) == 2 else told | {code}
            continue
        if asked:
            return "legacy", False
        if not legacy and code == 7:
            if arg > 1 or (arg == 0) == opened:
                return "enhanced", False
            opened = arg == 0
            headers[arg] += 1
            continue
        if opened:
            return "enhanced", False
        if code < 4:
            depth += run
        elif code == 6:
            depth -= run
            if depth < 0:
                return "legacy" if legacy else "enhanced", False
        elif code == 5:
            if (legacy and run != 1) or told is not None:
                return "legacy" if legacy else "enhanced", False
            asked, told, sets = legacy, None if legacy else set(), sets + 1
        elif code == 4:
            paints += 1
    fits = not (opened or asked or told is not None or depth or not sets or not paints)
    return ("legacy", fits) if legacy else ("enhanced", fits and headers == [1, 1] and values == set(range(8)))


def plain_paint(words, family, width, height):
    payloads = [w & 0xFFFF for w in words if w is not None and w >> 18 == 2 and w >> 16 & 3 == 0]
    spread = lambda v: v << 5 | v << 2 | v >> 1
    if family == "legacy":
        root = 1
        while root < max(width, height):
            root *= 2
    else:
        head = {p >> 6 & 7: p & 63 for p in payloads[1:9]}
        width, height, root = (head[k] << 6 | head[k + 1] for k in (0, 2, 4))
        top = 2 ** head[6] - 1
        payloads = payloads[10:]
        data = [(p >> 6 & 7, p & 63) for p in payloads if p & 0x200]
    canvas, stack, colour = {}, [(0, 0, root)], (0, 0, 0)
    for p in payloads:
        if p & 0x200:
            if family == "legacy":
                colour = tuple(spread(p >> s & 7) for s in (6, 3, 0))
            continue
        code, run = p >> 6 & 7, max(1, p & 63)
        for _ in range(run):
            x, y, size = stack[-1]
            if code < 4:
                half = max(1, size // 2)
                stack.append((x + half * (code & 1), y + half * (code >> 1), half))
            elif code == 6:
                stack.pop()
            elif code == 5 and family == "enhanced":
                three, data = dict(data[:3]), data[3:]
                colour = tuple(round(three.get(k, 0) / top * 255) for k in range(3))
            elif code == 4:
                canvas |= {(a, b): colour for a in range(x, x + size) for b in range(y, y + size)}
    return {(x, y): canvas.get((x, y), (0, 0, 0)) for x in range(min(width, root)) for y in range(min(height, root))}


def random_stream(rng, legacy):
    """A walk with runs, most of them well formed, then perhaps a word changed, dropped or added."""
    mark = X + (0x800 if legacy else 0x400)
    c = lambda code, run=1: mark + code * 64 + run
    d = lambda kind, v: mark + 0x200 + kind * 64 + v
    w, depth = [], 0
    if not legacy:
        width, height, root = rng.choice([(5, 3, 8), (8, 8, 8), (7, 2, 7), (9, 9, 4)])
        w = [c(7, 0), d(0, 0), d(1, width), d(2, 0), d(3, height), d(4, 0), d(5, root), d(6, 3), d(7, 50), c(7, 1)]
    for _ in range(rng.randrange(2, 14)):
        kind = rng.randrange(6)
        if kind < 2 and depth < 5:
            run = rng.choice((0, 1, 1, 2))
            w.append(c(rng.randrange(4), run))
            depth += max(1, run)
        elif kind == 2 and depth:
            run = rng.randrange(1, depth + 1)
            w.append(c(6, run))
            depth -= run
        elif kind == 3:
            w += [c(5), mark + 0x200 + rng.randrange(512)] if legacy else [c(5), *(d(k, rng.randrange(8)) for k in rng.sample(range(3), 3))]
        elif kind == 4:
            w.append(c(4, rng.choice((0, 1, 3))))
        elif legacy:
            w.append(c(7))
    if rng.random() < 0.9:
        w += [c(5), *([mark + 0x200 + 77] if legacy else [d(0, 1), d(1, 2), d(2, 3)]), c(4)]
    if depth:
        w.append(c(6, depth))
    change = rng.random()
    at = rng.randrange(len(w))
    if change < 0.15:
        del w[at]
    elif change < 0.3:
        w.insert(at, rng.choice([c(6), c(5), c(5, 2), d(0, 1), d(3, 1), c(7, 0), c(7, 1), c(7, 2), X + 0xC00, X + (0x400 if legacy else 0x800) + 256]))
    elif change < 0.5:
        w.insert(at, rng.choice([72, None, X + 65536 + 0x800, 1 << 20]))
    return w


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(17)
    return [random_stream(rng, i % 2 == 0) for i in range(400)] + [[], [72], [None]]


def test_grammar_and_painting(spark, streams):
    df = spark.createDataFrame([(i, s, 5, 7) for i, s in enumerate(streams)], "image_id long, words array<int>, width int, height int")
    want = [plain_check(s) for s in streams]
    told = {r.image_id: r for r in M.checked(df).collect()}
    assert len(told) == len(streams)
    for i, (family, fits) in enumerate(want):
        assert told[i].family == family and (told[i].error is None) == fits, (i, streams[i], told[i])
    assert 60 < sum(f for _, f in want) < 350
    got, errors = {}, set()
    for r in M.decoded(df).collect():
        if r.error is None:
            got.setdefault(r.image_id, {})[r.x, r.y] = (r.r, r.g, r.b)
        else:
            errors.add(r.image_id)
    assert errors == {i for i, (_, fits) in enumerate(want) if not fits}
    for i, (family, fits) in enumerate(want):
        if fits:
            assert got[i] == plain_paint(streams[i], family, 5, 7), (i, family, streams[i])


def test_legacy_streams_need_their_size(spark):
    words = [X + 0x800 + 5 * 64 + 1, X + 0x800 + 0x200 + 7, X + 0x800 + 4 * 64 + 1]
    df = spark.createDataFrame([(1, words, None, 2), (2, words, 0, 2), (3, words, 3, 1)], "image_id long, words array<int>, width int, height int")
    rows = M.decoded(df).collect()
    assert {r.image_id for r in rows if r.error == "a legacy stream without its size"} == {1, 2}
    assert sorted((r.x, r.y, r.r, r.g, r.b) for r in rows if r.image_id == 3) == [(0, 0, 0, 0, 255), (1, 0, 0, 0, 255), (2, 0, 0, 0, 255)]


@pytest.mark.parametrize("size", [(4, 4), (5, 3)])
def test_legacy_round_trip(spark, size):
    rng = random.Random(3)
    px = [(1, x, y, *(rng.choice((0, 40, 255)) for _ in range(3))) for x in range(size[0]) for y in range(size[1])]
    df = spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int")
    back = {(r.x, r.y): (r.r, r.g, r.b) for r in M.decoded(M.legacy_encoded(df, 0.0)).collect()}
    spread = lambda v: (v >> 5) << 5 | (v >> 5) << 2 | v >> 6
    assert back == {(x, y): tuple(map(spread, c)) for _, x, y, *c in px}


def test_enhanced_streams_are_painted_as_the_other_reader_does(spark):
    px = [(1, x, y, round(255 * x / 7), round(255 - 255 * y / 7), 128) for x in range(8) for y in range(8)]
    e = I.encoded(spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int"), 300.0).selectExpr("image_id", "words", "cast(null as int) as width", "cast(null as int) as height")
    told = lambda df: {(r.x, r.y): (r.r, r.g, r.b) for r in df.collect()}
    assert told(M.decoded(e)) == told(I.decoded(e))
