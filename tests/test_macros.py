"""Macro keys in texts against a plain search for the longest key, and macros from files."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from polyweft.functions import macros as K
from polyweft.plans.macro_queries import KEYS
from polyweft.sources import files
from polyweft.storage import written


def plain(text, ids):
    """Words as one character after another gives them."""
    out, run, i = [], b"", 0

    def flush():
        nonlocal run
        out.extend(0x40000 | run[k] << 8 | (run[k + 1] if k + 1 < len(run) else 0) for k in range(0, len(run), 2))
        run = b""

    while i < len(text):
        key = max((k for k in ids if text.startswith(k, i)), key=len, default=None)
        if key and (any(c in key for c in "‍️⃣") or any("\U0001f3fb" <= c <= "\U0001f3ff" for c in key) or (len(key) > 1 and all("\U0001f1e6" <= c <= "\U0001f1ff" for c in key))):
            flush()
            out.append(0x80000 | ids[key])
            i += len(key)
            continue
        for c in unicodedata.normalize("NFD", text[i]):
            if " " <= c <= "~" or c in "\t\n\rßøØæÆœŒ":
                flush()
                out.append(ord(c))
            else:
                run += c.encode()
        i += 1
    flush()
    return out


#: Keys that are longer than others and become none, among them one inside another's joiner sequence.
ODD = (*KEYS, "a", "ab‍", "ab‍c", "ab‍cd", "a+", "(", "🇫", "👩‍💻x", "é‍", "[^]‍")


def test_longest_keys(spark):
    ids = {k: i for i, k in enumerate(ODD)}
    rng = random.Random(11)
    parts = [*ODD, *"abcdé+(🇫🇷👩‍️⃣x日", "̖́", "̖́"]
    texts = ["", "plain", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500))]
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (-1, None)], "i int, t string")
    made = written(df.select("i", "t", K.encode(F.col("t"), K.Macros.of(list(ids.items()))).alias("w")), "macro-test")
    back = {r.i: (r.t, r.w, r.b) for r in made.select("*", K.decode(F.col("w"), K.Macros.of(list(ids.items()))).alias("b")).collect()}
    assert back.pop(-1)[1] is None
    for t, w, b in back.values():
        assert w == plain(t, ids), repr(t)
        assert b == unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFD", c) for c in t)), repr(t)


def test_tables_without_macros_and_with_repeats(spark):
    df = spark.createDataFrame([("a👍🏽b",)], "t string")
    words = lambda rows: df.select(K.encode(F.col("t"), K.Macros.of(rows))).first()[0]
    assert words([]) == words([("a", 1)]) == plain("a👍🏽b", {})
    assert words([("👍🏽", 1), ("👍🏽", 2)]) == [97, 0x80002, 98]  # the last of a key
    assert K.Macros.of([("👍🏽", 1), ("❤️", 1)]).keys == {1: "❤️"}  # the last of a number
    for bad in ([("x", -1)], [("x", 1 << 16)], [("", 1)], [("x", i) for i in range(K.MOST + 1)]):
        with pytest.raises(ValueError):
            K.Macros.of(bad)


def test_macro_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"macros": [{"emoji": "👍🏽", "macro_id": 5, "primitives": ["a", "b", "a"]}, {"emoji": "❤️", "name": "heart", "macro_id": 6, "primitives": ["b"]}]}))
    (tmp_path / "p.json").write_text(json.dumps({"primitives": [{"name": "a", "style_bits": 3, "strokes": [[1, 0, 0, 0, 0, 0], [0, 1, 2, 3, 0, 1]]}, {"name": "b", "style_bits": 0, "strokes": [[2] * 6]}]}))
    table, primitives = files.read_macros(spark, str(tmp_path / "m.json")), files.read_primitives(spark, str(tmp_path / "p.json"))
    macros = K.Macros.read(table)
    assert macros.ids == {"👍🏽": 5, "❤️": 6} and macros.longest_first == ["❤️", "👍🏽"]
    a, b = [1 << 14 | 3, (0 << 14 | 1 << 12 | 2 << 10 | 3 << 8 | 0 << 6 | 1 << 4) | 3], [0xAAA0]
    got = {r.emoji: r.words for r in K.stroke_words(table, primitives).collect()}
    assert got == {"👍🏽": a + b + a, "❤️": b}
    with pytest.raises(Exception, match="no primitive"):
        K.stroke_words(table.withColumn("primitives", F.array(F.lit("z"))), primitives).collect()
