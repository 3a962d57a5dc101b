"""Streams cut into ranges against whole ones."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_streams import random_stream, scan

from polyweft.operators import ranges as R
from polyweft.operators import streams as S


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(20260220)
    # a taste block that goes on over many ranges, and a range of continuations without one
    return [random_stream(rng) for _ in range(150)] + [[0x80409, 0x90412] + [0xA0401] * 40 + [0xB0407, 0x41] + [0xA0401] * 30, []]


@pytest.fixture(scope="module")
def df(spark, streams):
    return spark.createDataFrame([(i, p, w) for i, s in enumerate(streams) for p, w in enumerate(s)], "stream_id long, pos int, word int")


@pytest.mark.parametrize("length,fan", [(2, 2), (5, 3), (4096, 1024)])
def test_ranges_give_what_whole_streams_give(df, streams, length, fan):
    classified = R.dispatched(df, length, fan)
    assert {(r.stream_id, r.pos): r.modality for r in classified.collect()} == {(i, p): m for i, s in enumerate(streams) for p, m in enumerate(scan(s))}
    told = lambda b: Counter((r.stream_id, r.modality, r.block, r.start, tuple(r.words)) for r in b.collect())
    assert told(R.blocks(classified, length, fan)) == told(S.blocks(S.dispatched(df)))


def test_no_window_holds_a_stream(df):
    plan = R.dispatched(df)._jdf.queryExecution().toString()
    assert "Window" in plan and not any("windowspecdefinition(stream_id" in line and "r#" not in line and "at#" not in line for line in plan.split("\n"))


def test_numbers_without_gaps(df, streams):
    spread = df.select("stream_id", "pos", (F.col("pos").cast("long") * 1000 - 7).alias("key"))
    got = R.numbered(spread, "key", "n", length=2500, fan=2).collect()
    assert len(got) == sum(map(len, streams)) and all(r.n == r.pos for r in got)


def test_states_and_sums_before(spark):
    rows = [(1, r, r % 3, None if r % 4 else r) for r in range(0, 40, 2)] + [(2, 5, 1, None)]
    got = {(x.stream_id, x.r): (x.before_n, x.before_s) for x in R.before(spark.createDataFrame(rows, "stream_id long, r long, n long, s long"), ["n"], ["s"], fan=3).collect()}
    for g, r, _, _ in rows:
        earlier = [x for x in rows if x[0] == g and x[1] < r]
        assert got[g, r] == (sum(x[2] for x in earlier), next((x[3] for x in reversed(earlier) if x[3] is not None), None))
