"""Relations that several queries share, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# words of all modalities, taste runs with near misses, and text with escapes
SAMPLE = (
    72, 105, 262144 + 0xC3A9, 32,
    524288 + 0x8C01, 524288 + 0x8005, 524288 + 0x8405, 524288 + 0x8803, 524288 + 0x8C00,
    524288 + 0x4001, 524288 + 0x4C01, 524288 + 0x2201, 524288 + 0x2C01,
    524288 + 0x1000 + 77, 65, 524288 + 0x1000 + 4095,
    524288 + 0x0409, 589824 + 0x0412, 655360 + 0x0401, 655360 + 0x0402, 720896 + 0x0407,
    524288 + 0x0409, 589824 + 0x0412, 720896 + 0x0407, 655360 + 0x0402,
    524288 + 0x0400, 524288 + 0x0600, 524288 + 0x0540,
    589824 + 0x081F + (1 << 9), 524288 + 0x0803, 655360 + 0x0C02,
    524288 + 0x0211, 524288 + 0x0252, 524288 + 0x0289,
    786432 + 0x0100, 851968 + 0x0180, 524288 + 0x0120, 786432 + 0x0010,
    10, 524288 + 0x00FF, 223, 9,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each user: the sample's words in turn, with words out of range and nulls among them."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).alias("pos"))
    at = (F.col("pos") + F.col("stream_id") * 5) % len(SAMPLE)
    word = F.element_at(F.array(*[F.lit(w) for w in SAMPLE]), (at + 1).cast("int"))
    return rows.select("stream_id", "pos", F.when(F.col("event_id") % 29 == 0, F.lit(1048576 + 5)).when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise(word).cast("int").alias("word"))


WORDS_SQL = f"""
ev as (select event_id, user_id as stream_id, row_number() over (partition by user_id order by event_id) - 1 as pos from events),
w as (select stream_id, pos::int as pos, cast(case when event_id % 29 = 0 then 1048581 when event_id % 31 = 0 then null else ([{', '.join(map(str, SAMPLE))}])[((pos + stream_id * 5) % {len(SAMPLE)} + 1)::int] end as int) as word from ev)
"""

MODALITY_SQL = """
case when word is null or word not between 0 and 1048575 then null
when (word >> 18) & 3 = 3 and word & 256 != 0 then 'mental' when (word >> 18) & 3 != 2 then 'text' when word & 16384 != 0 then 'music' when word & 8192 != 0 then 'voice'
when word & 32768 != 0 then 'diagram' when word & 4096 != 0 then 'bpe' when word & 3072 = 1024 then 'image' when word & 2048 != 0 then 'touch' when word & 512 != 0 then 'smell' when word & 256 != 0 then 'mental' else 'text' end
"""

CLASSIFIED_SQL = (
    WORDS_SQL
    + f""",
f as (select *, coalesce(word between 0 and 1048575 and (word >> 18) & 3 = 2 and word & 1024 != 0, false) as t, (word >> 16) & 3 as v from w),
s as (select *, t and v = 0 and coalesce(lead(t and v = 1) over o, false) and coalesce(lead(t and v = 2, 2) over o, false) as st, t and v in (2, 3) as more from f window o as (partition by stream_id order by pos)),
i as (select *, st or coalesce(lag(st) over o, false) or coalesce(lag(st, 2) over o, false) as inb from s window o as (partition by stream_id order by pos)),
r as (select *, sum(case when not more or inb then 1 else 0 end) over (partition by stream_id order by pos) as run from i),
c as (select stream_id, pos, word, case when word is null or word not between 0 and 1048575 then null when inb or (more and first_value(inb) over (partition by stream_id, run order by pos)) then 'taste' else ({MODALITY_SQL}) end as modality from r)
"""
)
