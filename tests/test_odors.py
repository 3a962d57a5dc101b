"""Odor profiles against the rules said plainly, and notes as strokes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from polyweft.functions import codecs as C
from polyweft.functions import odors


def plain(p, depth, bits, places):
    q, unit = p["quality"], lambda v: max(0.0, min(1.0, v))

    def axis(ws):
        low, high = sum(min(0.0, w) for w in ws), sum(max(0.0, w) for w in ws)
        return max(0, min(7, round((sum(w * unit(v) for w, v in zip(ws, q)) - low) / (high - low) * 7)))

    a, i = axis(C.PLEASANT_WEIGHTS), axis(C.INTENSE_WEIGHTS)
    c = unit(p.get("complexity", 0.5))
    flat = {k: p[k] for k in ("molecular_weight", "vapor_pressure_kpa", "functional_groups") if k in p}
    m = p.get("molecular_descriptors", flat or None)
    weight, vapor, groups = (m or {}).get("molecular_weight", 0.0), (m or {}).get("vapor_pressure_kpa", 0.0), (m or {}).get("functional_groups", [])
    own = {g.strip().lower() for g in groups}
    if m is not None:
        c = unit(0.5 * c + 0.5 * unit(0.55 * min(6, len(own)) / 6 + 0.35 * min(1.0, max(0.0, weight) / 220) + 0.15 * ("aromatic" in own)))
    bins = [round(v / 7 * (places - 1)) for v in (a, i)]
    levels = (1 << bits) - 1
    fine = round(c * levels)
    ops = [1 if bins[0] >= 4 else 0, 2 if bins[1] >= 4 else 3, 0 if fine <= 5 else 1 if fine <= 10 else 2, 3 if sum([*bins, fine]) % 2 == 0 else 2][:depth]
    ops = (ops + [ops[-1]] * 3)[:3]
    axes = [round(b / (places - 1) * 7) for b in bins]
    if weight > 0 or vapor > 0 or groups:
        score = len(own) + ("aromatic" in own) + (weight >= 150)
        ops = [0 if own & set(C.AVERSIVE) else 1 if own & set(C.PLEASANT) or axes[0] >= 4 else 0, 2 if vapor >= 1.6 else 3, 0 if score <= 2 else 1 if score <= 4 else 2]
    order = sorted(range(5), key=lambda k: -q[k])
    second = odors.BY_SECOND[order[1]]
    way = [2 if i >= 5 else 1 if i >= 3 else 0, odors.BY_FIRST[order[0]], 4 if c >= 0.66 else 0 if c <= 0.33 else second]
    way.append(second if q[order[0]] - q[order[1]] < 0.08 else 7 if a >= 5 and c <= 0.45 else 5 if a <= 2 else 6)
    return (*axes, way, ops, round(fine / levels * 15))


@pytest.mark.parametrize("depth,bits,places", [(3, 4, 8), (1, 2, 4), (4, 3, 6)])
def test_profiles(spark, depth, bits, places):
    rng = random.Random(depth)
    profiles = []
    for _ in range(150):
        p = {"category": "MUSKY-ANIMAL", "quality": [rng.choice((0.0, 0.5, round(rng.uniform(-0.2, 1.2), 3))) for _ in range(5)]}
        if rng.random() < 0.6:
            p["complexity"] = round(rng.uniform(-0.3, 1.3), 3)
        molecule = {k: v for k, v in (("molecular_weight", rng.choice((0.0, 90.5, 300.0))), ("vapor_pressure_kpa", rng.choice((0.0, 1.6, 3.0))), ("functional_groups", rng.sample(["ester", " Amine", "aromatic", "wood", "ESTER"], rng.randrange(5)))) if rng.random() < 0.7}
        if rng.random() < 0.4:
            p["molecular_descriptors"] = molecule
        if rng.random() < 0.4:
            p |= {k: v for k, v in molecule.items()} if "molecular_descriptors" not in p else {"molecular_weight": 7.0}
        profiles.append(p)
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(profiles)], "i int, j string")
    for r in df.select("i", odors.record(odors.profile(F.col("j")), depth, bits, places).alias("r")).collect():
        assert (r.r.pleasantness, r.r.intensity, r.r.directions, r.r.tree, r.r.complexity) == plain(profiles[r.i], depth, bits, places), profiles[r.i]
        assert r.r.category == 5 and r.r.chirality == 0


def test_profiles_that_are_none(spark):
    told = lambda j: spark.createDataFrame([(j,)], "j string").select(odors.record(odors.profile(F.col("j"))).alias("r")).collect()
    for bad in ('{"category":"FLORAL","quality":[1,2]}', '{"category":"nothing","quality":[1,1,1,1,1]}', "[]", None):
        with pytest.raises(Exception, match="five channels"):
            told(bad)
    with pytest.raises(ValueError):
        odors.record(F.col("x"), tree_depth=5)
