"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import itertools
import random
import re
import subprocess
import sys
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyweft.llm import chat, common, components, exact_dedup, licences, lm, lm_scoring, mixing, packing, pii, quality, simhash, sketches
from polyweft.llm.queries import pretoken_pattern, tokenizer_path

LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "one two three four five six", "a"), (2, "one  two\tthree four five six", "a"), (3, None, None), (4, "", "b"), (5, "one two three four five six", "a"), (5, "one two three four five six", "a"),
    (None, "alone in the dark", "b"), (7, LONG, "b"), (8, "ÄÖÜ ß 日本 👩‍👩‍👧", None), (9, " \n ", "c"), (10, "card 4417 7442 8035 1547 mail a.b@c.example.com", "c"),
]
SCHEMA = "doc_id long, text string, source string"
EXTRA = "doc_id long, text string, source string, t string, id long, label int, keep_id long, text_sha256 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in ROWS], EXTRA)


def same(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, none, clashing):
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = {same(t) for i, t, _ in ROWS if i == r.doc_id}
        assert r.text_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    by = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got}
    assert (2, 1, 4, False) in by and (1, 1, 4, True) in by and (3, 3, 2, True) in by and (4, 3, 2, False) in by and (9, 9, 1, True) in by
    assert exact_dedup.groups(none).count() == 0
    kept = exact_dedup.deduplicated(clashing)
    assert kept.columns == clashing.columns and kept.count() == 7


def test_mixing(docs, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ROWS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(t) for _, t, _ in ROWS)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mixed(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(none).count() == 0
    named = docs.withColumns({c: F.lit(99) for c in ("__s", "__n", "__size", "size", "key", "tie", "mix_key", "looked_up_key")})
    out = mixing.mixture(named)
    assert out.columns == named.columns and {r["__size"] for r in out.collect()} == {99}


def test_mixing_equals_plain_prefixes(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BUCKET", 2)  # some levels of the tree
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumns({"source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6}))
    rating = quality.rating(labels)
    got = {r.doc_id: r for r in mixing.mixed(docs, rating=rating).collect()}
    by_source = {}
    for r in mixing._keyed(docs, "doc_id", "text", "source", rating)[0].collect():
        by_source.setdefault(r.source, []).append(r)
    for rows in by_source.values():
        total = sum(r.size for r in rows)
        target = got[rows[0].doc_id].target
        epochs, ahead = int(target // total), 0
        for r in sorted(rows, key=lambda r: (r.key, r.doc_id, r.tie)):
            more = ahead + r.size / 2 < target - epochs * total
            assert got[r.doc_id].taken == min(3, epochs + more) * r.size, r
            ahead += r.size
    taken = mixing.mixture(docs, rating=rating).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {k: r.copies for k, r in got.items() if r.copies}


def test_water_level(spark):
    sizes = {"a": 1000, "b": 1, "c": 10, "d": 500}
    rows = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weights = dict(zip(sorted(sizes), (1, 2, 3, 1)))
    left, open_, want = float(sum(sizes.values())), set(sizes), {}
    while True:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            open_.discard(s)
    assert got == pytest.approx(want)


def test_licences(spark, docs, none):
    assert all(not r.licences for r in licences.scanned(docs).collect()) and licences.scanned(none).count() == 0
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    df = spark.createDataFrame([(1, mit), (2, "Licensed under the Apache License, Version 2.0."), (3, "All rights reserved. Released under the MIT License.\nMore. ALL RIGHTS RESERVED!"), (4, "Copyright (c) 2019 Ann Other. All rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scanned(df).collect()}
    assert got[1] == ["MIT"] and got[2] == ["Apache-2.0"] and got[3] == ["MIT", "Proprietary"] and got[4] == ["Proprietary"]
    assert all(re.search(licences.ANCHOR, s) for s in licences.known()) and len({i for i in licences.known().values()}) == len(licences.SENTENCES) + len(licences.SPDX)
    assert {i for _, run in licences.rules() for i in run} == set(licences.known().values())


def test_wrapped_licences(spark):
    wrap = lambda t, lead="": textwrap.fill(t, 80, initial_indent=lead, subsequent_indent=" " * len(lead))
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    asis = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    mit = "\n\n".join(["MIT License", "Copyright (c) 2020 Ann Other", *map(wrap, (grant, notice, asis))])
    items = ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    met = wrap("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")
    bsd = lambda n: "\n\n".join(["Copyright (c) 2020, Ann Other", met, *[wrap(x, f"{i}. ") for i, x in enumerate(items[:n], 1)]])
    gpl = "Copyright (C) 2020 Ann Other\n" + wrap("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.") + "\n\n" + wrap("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.")
    apache = "Copyright 2020 Ann Other\n\n" + wrap("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at") + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + wrap("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")
    texts = [mit, bsd(3), bsd(2), gpl, apache]
    texts += [t.replace("\n", "\r\n") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scanned(df).collect()}
    want = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0-or-later", "Apache-2.0"] * 2
    assert [got[i].licences for i in range(10)] == [[w] for w in want]
    assert [len(got[i].sentences) for i in (0, 1, 2, 3, 4)] == [4, 4, 3, 3, 5]


def test_licences_of_several_cuts_and_tags(spark):
    gpl2 = textwrap.fill("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", 76)
    rows = [
        (1, "Released under the MIT License\n\n" + gpl2),
        (2, "/* SPDX-License-Identifier: MIT */\nint x;\n// SPDX-License-Identifier: GPL-2.0-or-later"),
        (3, "\n".join("# " + x for x in gpl2.split("\n"))),
        (4, "Copyright (c) 2001, 2002 Some Body\n" + gpl2 + "\n\nAll rights reserved."),
        (5, "SPDX-License-Identifier: Apache-2.0\x01 licensed under the mit license. " + "a. " * 20000),
        (6, None),
    ]
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[1].licences) == {"MIT", "GPL-2.0-or-later"} and got[1].sentences == ["mit-ref", "gpl2-free"]
    assert set(got[2].licences) == {"MIT", "GPL-2.0-or-later"} and got[3].licences == ["GPL-2.0-or-later"] and set(got[4].licences) == {"GPL-2.0-or-later", "Proprietary"}
    assert set(got[5].licences) == {"Apache-2.0", "MIT"} and got[6].licences == []


def test_licence_sql_says_the_same(spark, sf, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r.doc_id, ",".join(r.sentences), ",".join(r.licences), r.has_licence) for r in licences.scanned(docs).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert set(con.sql(licences.oracle()).select("doc_id, sentences, licences, has_licence").fetchall()) == want and any(w[3] for w in want)


def test_simhash_masks_cover():
    rng = random.Random(1)
    for bits, radius, parts in ((64, 3, 1), (128, 15, 4)):
        masks = simhash.masks(bits, radius, parts)
        for _ in range(400):
            differ = sum(1 << b for b in rng.sample(range(bits), radius))
            assert any(m & differ == 0 for m in masks)


def test_simhash_against_brute_force(spark, docs, none, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 5))) for b in base for _ in range(6)] + [base[0] ^ (1 << i) for i in range(60)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(prints)], "id long, w0 long")
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    want = {i: find(i) for i in range(len(prints))}
    assert {r.id: r.component_id for r in simhash.grouped(df, ["w0"], 3).collect()} == want
    monkeypatch.setattr(simhash, "LARGE_RUN", 3)  # most keys are split, most classes looked up
    monkeypatch.setattr(components, "HUB", 2)
    assert {r.id: r.component_id for r in simhash.grouped(df, ["w0"], 3).collect()} == want
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert out[(3, "0" * 16)] == out[(4, "0" * 16)] == out[(9, "0" * 16)] == 3 and out[(5, next(f for d, f in out if d == 5))] == 1
    assert simhash.simhash_groups(none).count() == 0


def test_shingles():
    assert simhash.shingles(b"", 3) == [] and simhash.shingles(b" A  b ", 3) == [b"a b"]
    assert simhash.shingles(b"a b c D", 3) == [b"a b c", b"b c d"]


def test_near_dedup_keeps_clean_documents(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base = words(300)
    near = list(base)
    near[100] = "changed"
    other, clean = " ".join(words(300)), " ".join(words(40))
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, other), (4, None), (5, "alone"), (2, clean), (2, clean), (None, "no id"), (6, " \n")]
    df = spark.createDataFrame([(*r, 0, "x", 7) for r in rows], "doc_id long, text string, id int, t string, near_node int")
    out = simhash.near_deduplicated(df)
    assert out.columns == df.columns and {(r.id, r.t, r.near_node) for r in out.collect()} == {(0, "x", 7)}
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (3, other), (4, None), (5, "alone"), (2, clean), (None, "no id")], key=str)
    assert simhash.near_deduplicated(df.limit(0)).count() == 0


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    fresh = itertools.count()
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    texts = []
    for n, k in ((50, 5), (100, 11), (100, 20), (200, 40), (100, 24), (60, 25), (12, 2), (9, 1)):
        for _ in range(6):
            base = words(n)
            texts += [base, base + words(k), words(k) + base, base[: n - k]]
            cut = rng.randrange(n - k)
            texts.append(base[:cut] + words(k) + base[cut:])
    run = words(100)  # more copies than a small run holds, from nearly alike to below the share
    for _ in range(70):
        at = rng.randrange(100)
        texts.append(run[:at] + words(1) + run[at + 1 :] + words(rng.randrange(0, 40)))
    texts += [["a", "b"], ["A", "b"], ["a"], []]
    sets = [frozenset(simhash.shingles(" ".join(t).encode(), 5)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in simhash.near_deduplicated(df).collect()}
    assert got == {i for i in range(len(texts)) if find(i) == i}


def test_large_runs_are_asked_without_rows_for_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for i in range(300):  # alike, most pairs below the share, some at it
        t = list(rng.choice(texts)) if i % 4 == 3 else list(base)
        for at in rng.sample(range(150), 1 if i % 4 == 3 else 3):
            t[at] = f"x{i}_{at}"
        texts.append(t)
    sets = [frozenset(simhash.shingles(" ".join(t).encode(), 5)) for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    alike = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) * 9 >= (len(sets[i]) + len(sets[j])) * 4]
    want = {r.node for r in components.components(spark.createDataFrame(alike, "a long, b long")).collect() if r.node != r.root}
    made = {}

    def written(rows, name):
        out = common.written(rows, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "written", written)
    for sizes in ({}, {"TILE": 16, "COLUMNS": 8, "BLOCK": 3000}):
        for name, value in sizes.items():
            monkeypatch.setattr(simhash, name, value)
        kept = {r.doc_id for r in simhash.near_deduplicated(df).collect()}
        assert kept == set(range(len(texts))) - want
        assert made["across"] <= len(texts) * (1 if not sizes else 20)


def test_workers_let_go_of_what_they_kept():
    first = common.kept_in_worker(dict)
    assert common.kept_in_worker(dict) is first
    common.let_go()
    assert common.kept_in_worker(dict) is not first


def test_workers_give_back_the_memory_of_texts():
    held = """
import re, sys
def mb(): return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+([0-9]+)", open("/proc/self/smaps_rollup").read()))) // 1024
from polyweft.llm import common
before, texts = mb(), [bytes(2500) for _ in range(60_000)]
last = bytes(2500)
full = mb()
del texts
common.let_go()
print(before, full, mb())
"""
    done = subprocess.run([sys.executable, "-c", held], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    before, full, after = map(int, done.stdout.split())
    assert full - before > 100 and after - before < 20


def test_pipeline_bounds_what_python_gets_at_once(spark, sf):
    corpus_pipeline.quality_filter(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    long = spark.range(12, numPartitions=1).select(F.repeat(F.lit("ab "), 1_000_000).alias("t"))
    sizes = [r["n"] for r in long.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in it), "n long").collect()]
    assert sum(sizes) >= 36_000_000 and max(sizes) < 8_000_000


def test_near_dedup_links_by_covered_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STAGE_BITS", -1)  # the finish by shared shingles lets nothing pass
    rng = random.Random(11)
    texts = []
    for g in range(25):
        base = [f"g{g}w{k}" for k in range(rng.randrange(60, 400))]
        texts += [base, base + ["more"] * rng.randrange(1, 20), base[rng.randrange(1, 12) :], base + ["last"], [*base[:30], "in", *base[30:]]]
    texts = [" ".join(t).encode() for t in texts]
    texts += [t.replace(b" ", b"\n ") for t in texts[:10]]
    sets = [simhash._hashes(t) for t in texts]
    prints = [simhash._set_print(h) for h in sets]
    alike = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        bits = sum(int(x).bit_count() for x in prints[i] ^ prints[j])
        if bits <= simhash.STAGE_RADIUS and len(set(sets[i]) & set(sets[j])) * 9 >= (len(sets[i]) + len(sets[j])) * 4:
            alike.append((i, j))
    drop = {r.node for r in components.components(spark.createDataFrame(alike, "a long, b long")).collect() if r.node != r.root}
    assert len(drop) > 50
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_deduplicated(df).collect()} == set(range(len(texts))) - drop


def test_components_of_stars_go_through_no_round(spark, monkeypatch):
    made = []

    def written(rows, name):
        made.append(name)
        return common.written(rows, name)

    monkeypatch.setattr(components, "written", written)
    stars = [(i, i + k) for i in (0, 100, 200) for k in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i + k: i for i in (0, 100, 200) for k in range(30)} and made == ["links", "least"]


def test_more_links_extend_components(spark, monkeypatch):
    rng = random.Random(8)
    first = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    more = [(rng.randrange(260), rng.randrange(260)) for _ in range(40)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    plain = lambda df: sorted((r.node, r.root) for r in df.collect())
    for most in (common.MOST_SENT, 3):  # tables are sent, or met by shuffles
        for module in (common, components):
            monkeypatch.setattr(module, "MOST_SENT", most)
        root = list(range(260))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in first + more:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        found = components.components(frame(first))
        got = components.extended(found, frame(more))
        linked = {x for p in first + more if p[0] != p[1] for x in p}
        assert [p for p in plain(got) if p[0] != p[1]] == [(x, find(x)) for x in sorted(linked) if find(x) != x]
        assert len({n for n, _ in plain(got)}) == got.count()
        assert plain(components.extended(got, frame(first))) == plain(got)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}}


def test_packing(docs, none):
    got = packing.packed(docs, tokenizer_path(packing.VOCABULARY), size=64).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id in (3, 4, 9) for r in got) == 3
    assert {r.ids_crc32 for r in got if r.doc_id == 3} == {zlib.crc32(b"\0\0\0\0")}
    assert packing.packed(none, tokenizer_path(packing.VOCABULARY)).count() == 0


def test_fullest_bin_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        found = packing.fullest(counts, 40)
        assert all(found[k] <= counts[k] for k in found)
        best = max(s for s in (sum(a * n for a, n in zip(counts, c)) for c in itertools.product(*[range(v + 1) for v in counts.values()])) if s <= 40)
        assert sum(k * n for k, n in found.items()) == best


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    from polyweft.llm.wordids import WordIds

    path = tokenizer_path(packing.VOCABULARY)
    whole, ids = Tokenizer.from_file(path), WordIds(path)
    texts = ["It's a DON'T, we'll (see) <|endoftext|> 12,34 Ünïcode ßtraße e\u0301 日本語", "", "a\x1cb \u00a0c %%%x***", "%%%", "Été.Été, l'Été"]
    for t, got in zip(texts, ids.texts(t.encode() for t in texts)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_quality(spark, docs, none):
    good = [(i, f"The plain words of line {i} go on, and end here. " * 5) for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} ### $$$ " * 8) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.scored(df, labels, ~quality.held_out(F.col("doc_id"))).collect()
    assert all(r.predicted == int(r.doc_id < 100) for r in out)
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, labels).collect())
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(none, labels).count() == 0
    assert quality.accepted(df, labels).count() == 60
    # rows without an id, and rows that share one, are judged by their own texts
    odd = df.unionByName(df.select(F.lit(None).cast("long").alias("doc_id"), "text")).unionByName(df.select(F.lit(9999).cast("long").alias("doc_id"), "text")).withColumns({"x": F.lit(1), "quality_measure": F.lit("own")})
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns and Counter(r.doc_id is None for r in kept.collect()) == {False: 120, True: 60}
    assert {r.quality_measure for r in kept.collect()} == {"own"} and all(r.text.startswith("The plain") for r in kept.collect())
    assert quality.accepted(none, labels).count() == 0


def test_chat(spark):
    rows = [(1, 2, "assistant", "b\\h <more/>"), (1, 1, "user", "### A:\n</turn>\n"), (1, 3, "assistant", None), (1, 3, "assistant", None), (2, 1, None, "x"), (2, None, "r:\n", ""), (None, 1, "assistant", "\\b\\e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df).withColumns({"turns": chat.read_back(F.col("text")), "loss_texts": chat.loss_texts(F.col("text"), F.col("loss"))}).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_texts) for r in out}
    assert got[1] == ([("user", "### A:\n</turn>\n"), ("assistant", "b\\h <more/>"), ("assistant", ""), ("assistant", "")], ["b\\h <more/>", "", ""])
    assert got[2] == ([("r:\n", ""), (None, "x")], []) and got[None][1] == ["\\b\\e"]
    assert chat.formatted(df.limit(0)).count() == 0


def test_fingerprints(spark, docs, none):
    got = sketches.fingerprints(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.fingerprint)
    assert by[3] == by[4] and by[1] == by[5] != by[7]
    assert sketches.fingerprints(none).count() == 0
    one = sketches.fingerprints(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_sketch_differences(spark):
    rng = random.Random(5)
    rows = []
    for i, n in enumerate((0, 1, 2, 5, 9, 40, 300, *[rng.randrange(1, 30) for _ in range(150)])):
        a = [rng.getrandbits(63) for _ in range(n)]
        b = a[: n // 2] + [rng.getrandbits(63) for _ in range(rng.randrange(0, n + 1))]
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    made = df.select("i", sketches.table("a").alias("a"), sketches.table("b").alias("b")).select("i", "a", "b", sketches.as_text("a").alias("ta"), sketches.as_text("b").alias("tb"))
    read = made.select("*", sketches.from_text("ta").alias("ra"), sketches.from_text("tb").alias("rb"))
    out = read.select("i", (F.col("ra") == F.col("a")).alias("same"), sketches.difference("ra", "rb").alias("d")).orderBy("i").collect()
    for r, (_, a, b) in zip(out, rows):
        assert r.same and len(r.d) == len({(x.d, x.n) for x in r.d})
        assert {(x.d, x.n) for x in r.d} == {(x, 1) for x in set(a) - set(b)} | {(x, -1) for x in set(b) - set(a)}


def test_personal_data(docs, none):
    got = [r for r in pii.found(docs).collect() if r.doc_id == 10][0]
    assert [(s.kind, s.start, s.end) for s in got.base] == [("card", 5, 24), ("email", 30, 47)]
    assert set(map(tuple, got.base)) <= set(map(tuple, got.spans)) and pii.found(none).count() == 0
    assert pii.redacted("mail a@b.cd now", [(5, 11, "email")]) == "mail [email] now"


def test_rules_equal_regular_expressions():
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": pii._ip_ok, "card": pii._card_ok, "phone": pii._phone_ok}
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@-+ 2(0)5%é") for _ in range(rng.randrange(0, 40)))
        want = sorted(((m.start(), m.end(), k) for k, f in forms.items() for m in re.finditer(f, t) if ok[k](m[0])), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert pii.rule_spans(t) == want, t


def test_crf_and_lstm_gradients():
    rng = np.random.default_rng(0)
    x, y = pii.generated(rng, 3, 12)
    p = {"out": rng.normal(0, 0.2, (24, 9)), "bias": np.zeros(9), "moves": rng.normal(0, 0.1, (9, 9)), "xf": rng.normal(0, 0.2, (100, 48)), "hf": rng.normal(0, 0.2, (12, 48)), "xb": rng.normal(0, 0.2, (100, 48)), "hb": rng.normal(0, 0.2, (12, 48))}
    _, g = pii._gradients(p, x, y)
    for k, d in g.items():
        i = np.unravel_index(np.abs(d).argmax(), d.shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        assert d[i] == pytest.approx((pii._gradients(up, x, y)[0] - pii._gradients(down, x, y)[0]) / 2e-3, rel=1e-2, abs=1e-4)


def test_language_model_sums_to_one():
    table = np.full((lm.SIZE, lm.SIZE), 1.0 / lm.SIZE)
    p, fixed = lm.start(table)
    x, y, _ = lm.windows([np.array([5, 6, 7], np.uint16)])
    total = sum(np.exp(lm.log_probs(p, fixed, x, np.where(np.arange(lm.SCORED) == 2, k, -1)[None])[0, 2]) for k in range(lm.SIZE))
    assert total == pytest.approx(1, abs=1e-3)


def test_windows_score_each_token_once():
    texts = [np.arange(3, 3 + n).astype(np.uint16) for n in (0, 1, 15, 16, 17, 50)]
    _, y, text = lm.windows(texts)
    for i, t in enumerate(texts):
        assert [v for v in y[text == i].ravel() if v >= 0] == [*t, lm.END]


def test_language_model_sees_and_learns_from_enough():
    assert lm_scoring.SHARE <= 64 and lm.HEADS >= 2 and lm.KEYS - lm.SCORED >= 16
    x, y, _ = lm.windows([np.arange(3, 60).astype(np.uint16)])
    p, fixed = lm.start(np.full((lm.SIZE, lm.SIZE), 1.0 / lm.SIZE))
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(v.dtype) for k, v in p.items()}
    far = x.copy()
    far[:, lm.KEYS - lm.SCORED - 15] += 1  # 15 ids before the first that is scored
    assert not np.allclose(lm.log_probs(p, fixed, x, y)[1:, 0], lm.log_probs(p, fixed, far, y)[1:, 0], atol=1e-7)


def test_language_model_scoring(spark, docs, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 5)
    monkeypatch.setattr(lm_scoring, "HOT", 3)
    args = (tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern())
    learn = F.coalesce(F.col("doc_id"), F.lit(1)) != 8
    got = lm_scoring.scored(docs, learn, *args).collect()
    counts = {}
    for i, t, _ in ROWS:
        if i != 8:
            for w in [*(t or "").lower().encode().split(), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t or "" for i, t, _ in ROWS if i == r.doc_id)
        words = [*text.encode().lower().split(), b"\n"]
        assert r.n_tokens == len(words) and r.n_known == sum(w in counts for w in words) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)) and r.score < 0
    assert lm_scoring.scored(none, learn, *args).count() == 0


def test_language_model_learns_from_every_training_text(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm_scoring, "START_DOCS", 0)
    args = (tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern())
    texts = [" ".join([w] * (20 + k)) for k, w in enumerate("river stone cloud paper green seven north music table house glass horse".split())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm_scoring._texts(df, F.lit(True), "doc_id", "text")
    model = lm_scoring.learnt(rows, lm_scoring.word_counts(rows), *args)
    assert lm_scoring.SHARE == 1
    words = lm.Subwords(*args)
    classes = [model["cls"][[i for w in t.split() for i in words.ids(w.encode())]] for t in texts]
    moved = (model["params"]["own"] != lm.start(np.full((lm.SIZE, lm.SIZE), 1.0 / lm.SIZE))[0]["own"]).any(1)
    assert all(moved[c].all() for c in classes)
    assert model["windows"] == sum(-(-(len(c) + 1) // lm.SCORED) for c in classes)


def test_language_model_gradients():
    import numpy as np

    rng = np.random.default_rng(2)
    table = rng.random((lm.SIZE, lm.SIZE)) + 0.1
    p, fixed = lm.start(table / table.sum(1, keepdims=True))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, y, _ = lm.windows([rng.integers(3, 40, n).astype(np.uint16) for n in (30, 5, 17)])
    for k, d in lm.gradients(p, fixed, x, y)[1].items():
        i = np.unravel_index(np.abs(d).argmax(), d.shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert d[i] == pytest.approx((lm.gradients(up, fixed, x, y)[0] - lm.gradients(down, fixed, x, y)[0]) / 2e-2, rel=3e-2, abs=2e-5), k


def test_likeness_computes_one_difference(spark):
    sets = spark.sql("select array(1L, 2L, 3L) as x, array(2L, 3L, 4L) as y union all select array(), array()")
    made = sets.select(sketches.table("x").alias("a"), sketches.table("y").alias("b"))
    reads = lambda c: made.select(c)._jdf.queryExecution().analyzed().toString().count(".leaves")
    assert reads(sketches.likeness("a", "b")) == reads(F.size(sketches.difference("a", "b"))) > 0
    assert sorted(r[0] for r in made.select(sketches.likeness("a", "b")).collect()) == [0.5, 1.0]


def test_training_is_adam_and_leaves_its_start():
    rng = np.random.default_rng(4)
    p, fixed = lm.start(np.full((lm.SIZE, lm.SIZE), 1.0 / lm.SIZE))
    before = {k: v.copy() for k, v in p.items()}
    texts = [rng.integers(3, 60, 40).astype(np.uint16)]
    x, y, _ = lm.windows(texts)
    got, _ = lm.train(p, fixed, texts, 3, 0.01, batch=len(x))
    want, m, s = ({k: f(v.astype(np.float64)) for k, v in p.items()} for f in (np.copy, np.zeros_like, np.zeros_like))
    for step in (1, 2, 3):
        for k, d in lm.gradients({k: v.astype(np.float32) for k, v in want.items()}, fixed, x, y)[1].items():
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.99 * s[k] + 0.01 * d.astype(np.float64) ** 2
            want[k] -= 0.01 * step / 20 * (1 - step / 4) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    assert all((p[k] == before[k]).all() and np.allclose(got[k], want[k], atol=1e-5) for k in p)


def test_steps_of_training_get_no_new_memory():
    code = """
import resource
import numpy as np
from polyweft.llm import common, lm
common.keep_memory()
p, fixed = lm.start(np.full((lm.SIZE, lm.SIZE), 1.0 / lm.SIZE))
x, y, _ = lm.windows([np.arange(2000).astype(np.uint16) % 1000 + 3])
faults = []
for _ in range(30):
    lm.gradients(p, fixed, x, y)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print(faults[-1] - faults[9])
"""
    root = str(Path(lm.__file__).parents[2])
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root).stdout) < 1000  # 20 steps


def test_words_cut_together_equal_words_cut_alone():
    words = lm.Subwords(tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern())
    texts = [w.encode() for w in ["hello", "it's", "'s", " ", " x", "x ", "12,345", "%%%", "\u0085", "日本語", "a\x1cb", "don't", "--", "é", " y", "<|endoftext|>"]] + [b"\xff\xfe", b"z"]
    ids, begins = words.many(texts)
    cut = np.split(ids, np.flatnonzero(begins)[1:])
    assert [c.tolist() for c in cut] == [words.ids(t) for t in texts]


def test_coded_words_equal_words_looked_up_alone(monkeypatch):
    monkeypatch.setattr(lm_scoring._Words, "MOST", 4)  # the table is emptied again and again
    words = lm.Subwords(tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern())
    rng = np.random.default_rng(6)
    cls, share = lm.vocabulary(rng.integers(0, 9, words.n_ids).astype(float))
    hot, strange = {b"river": -1.5, b"stone": -2.0, b"odd": -3.0}, frozenset([b"odd"])
    table = lm_scoring._Words(words, cls, share, hot, strange)
    for texts in ([[b"river", b"river", b"odd"], []], [[b"moss", b"stone", b"moss", b"\xff"]], [[b"it's", b"river"], [b"xylophones", b"moss", b"odd", b"odd"]]):
        for text, (code, base, rare, n_strange, cold) in zip(texts, table.coded(texts)):
            ids = [i for w in text for i in words.ids(w)]
            assert code == cls[ids].astype(np.uint16).tobytes() and cold == [w for w in text if w not in hot]
            assert base == pytest.approx(sum(hot.get(w, 0) for w in text)) and rare == pytest.approx(share[ids].sum()) and n_strange == sum(w in strange for w in text)


def test_language_model_reads_texts_twice(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"river stone {i} cloud") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    seen = []
    monkeypatch.setattr(lm_scoring, "written", lambda df, name: (seen.append((name, any("/docs/" in f for f in df.inputFiles()))), common.written(df, name))[1])
    monkeypatch.setattr(lm_scoring, "STEPS", 2)
    assert lm_scoring.scored(spark.read.parquet(f"{tmp_path}/docs"), F.col("doc_id") % 5 != 1, tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern()).count() == 20
    # once for the counts and once for the classes, which gradients and scores read
    assert [name for name, texts in seen if texts] == ["word-counts", "coded"]
