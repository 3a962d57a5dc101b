"""Functions by name in SQL, and streams as files of their own."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from test_streams import TEXTS, single

from polyweft.functions import names
from polyweft.functions import text as T
from polyweft.sources import files
from polyweft.sources.bin_files import WordFiles
from polyweft.storage import written


def test_names_say_what_the_expressions_say(spark):
    assert {"encode_words", "decode_words", "word_modality"} <= set(names.register(spark))
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(TEXTS)), (99, None)], "i int, t string")
    made = written(spark.sql("select i, t, encode_words(t) as w from {d}", d=df), "sql-words")
    rows = spark.sql("select *, decode_words(w) as back from {d}", d=made).collect()
    want = {r.i: r.w for r in df.select("i", T.encode(F.col("t")).alias("w")).collect()}
    for r in rows:
        assert r.w == want[r.i] and r.back == (None if r.t is None else unicodedata.normalize("NFC", r.t))
    words = [0x41, 0x80409, 0x8C001, 0x84001, 0x82201, 0x81004, 0x8081F, 0x80211, 0xC0100, 0xC0010, 0x80120, 1 << 20, -1, 0x400C3]
    told = spark.sql("select w, word_modality(w) as m, word_mode(w) as k, word_is_valid(w) as ok from {d}", d=spark.createDataFrame([(w,) for w in words] + [(None,)], "w int")).collect()
    for r in told:
        ok = r.w is not None and 0 <= r.w < 1 << 20
        assert r.ok == ok and r.m == (single(r.w) if ok else None)
    assert spark.sql("select decode_words(array(72, 65536)) as a, decode_words(array(262144 + 195 * 256)) as b").first() == (None, None)


def test_streams_as_files(spark, tmp_path):
    spark.dataSource.register(WordFiles)
    df = spark.createDataFrame([(1, [65, 1 << 20, None, 1048575]), (2, None), (3, [])], "stream_id long, words array<int>").repartition(3)
    at = tmp_path / "out"
    df.write.format("word_files").mode("append").save(str(at))
    assert {p.name: p.read_bytes().hex() for p in at.iterdir()} == {"1.bin": "00000041000fffff", "2.bin": "", "3.bin": ""}
    back = files.read_words_binary(spark, f"{at}/*.bin").orderBy("pos").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.word) for r in back] == [("1.bin", 65), ("1.bin", 1048575)]
    spark.createDataFrame([("a/b", [7])], "stream_id string, words array<int>").write.format("word_files").mode("overwrite").save(f"file://{at}")
    assert [p.name for p in at.iterdir()] == ["a%2Fb.bin"]


@pytest.mark.parametrize("rows", [[(1, [1]), (None, [2])], [(1, [1]), (1, [2])]])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, rows):
    spark.dataSource.register(WordFiles)
    at = tmp_path / "out"
    with pytest.raises(Exception, match="without an id|several rows"):
        spark.createDataFrame(rows, "stream_id long, words array<int>").repartition(2).write.format("word_files").mode("append").save(str(at))
    assert not list(at.glob("*.bin"))  # a task that still ran may have made its own folder again, which readers pass over
