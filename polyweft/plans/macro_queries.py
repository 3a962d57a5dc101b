"""Queries over macro keys in texts, and over the strokes that macros stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.functions import macros as K
from polyweft.functions import words as W
from polyweft.plans.common import table
from polyweft.plans.text_queries import _M, _replaced
from polyweft.storage import written

# keys with joiners, skin tones, flags and keycaps, ties and beginnings of each other, and some that do not become macro words
KEYS = (
    "👍", "👍🏽", "👍🏿", "👩", "👩‍💻", "👩🏽‍💻", "👨‍👩‍👧", "👨‍👩‍👧‍👦", "👨‍👩", "❤", "❤️", "❤️‍🔥", "1️⃣", "#️⃣", "🇫🇷", "🇫🇷 fr", "🇩🇪", "🏳️‍🌈", "🙂", ":)", "☎️", "🧑🏻‍🤝‍🧑🏿", "🧑🏻", "🇺🇸🇺🇸",
)
#: What is put behind each text, two by number: keys, beginnings of keys, and signs without one.
ADDED = (
    "👍🏽👍", "👩‍👩‍💻", "👨‍👩‍👧‍👦", "👨‍👩‍👧‍x", "❤️‍🔥❤", "❤️‍", "1️⃣11⃣", "🇫🇷🇫🇷 fr", "🇫🇷 f", "🇺🇸🇺🇸🇺🇸", "🏳️‍🌈🏳️", ":) 🙂", "🧑🏻‍🤝‍🧑🏿🧑🏻", "🧑🏻‍🤝", "日本☎️", "é👩🏽‍💻É", "",
)
_NUMBER = 0x410  # no type bit that a macro word must not have


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.array(*[F.lit(a) for a in ADDED])
    pick = lambda e: F.get(added, F.expr(f"cast(({e}) % {len(ADDED)} as int)"))
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat("text", pick("conv_id + turn"), pick("conv_id * 7 + turn * 3"), F.lit("end")).alias("t"))


def macro_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with macros encoded, and decoded again."""
    macros = K.Macros.of([(k, _NUMBER + i) for i, k in enumerate(KEYS)])
    made = written(_texts(spark, sf_dir).select("conv_id", "turn", K.encode(F.col("t"), macros).alias("words")), "macro-words")
    n = F.size(F.filter("words", lambda w: K.is_macro(w, macros))).cast("long")
    told = F.array_join(F.transform("words", lambda w: w.cast("string")), ",")
    return made.select("conv_id", "turn", n.alias("macros"), F.sha2(told, 256).alias("words_sha"), F.sha2(K.decode(F.col("words"), macros), 256).alias("text_sha"))


def macro_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as macros of the primitives of two regions."""
    state = lambda e: F.expr(f"cast(({e}) % 4 as int)")
    row = lambda k: F.array(*[state(f"r_regionkey * {i + 1} + {k}") for i in range(6)])
    primitives = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.expr("cast(r_regionkey * 3 as int)").alias("style_bits"), F.array(row(0), row(1)).alias("strokes"))
    names = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = table(spark, sf_dir, "nation").join(F.broadcast(names), F.col("n_regionkey") == F.col("r_regionkey"))  # a region for each continent
    other = names.select(F.col("r_regionkey").alias("other"), F.col("r_name").alias("other_name"))
    n = n.join(F.broadcast(other), F.expr("n_nationkey % 5 = other")).select(F.col("n_name").alias("emoji"), F.array("r_name", "other_name", "r_name").alias("primitives"))
    return K.stroke_words(n, primitives).select("emoji", F.array_join(F.transform("words", lambda w: w.cast("string")), ",").alias("words"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_LONGEST = sorted(KEYS, key=len, reverse=True)
_KEYS_SQL = "[" + ", ".join(f"{{'k': '{k}', 'n': {KEYS.index(k)}, 'glued': {str(K.holds_together(k)).lower()}}}" for k in _LONGEST) + "]"
_PRIVATE = r"\x{E000}-\x{E0FF}"
_STATE = lambda k: " + ".join(f"(((r_regionkey * {i + 1} + {k}) % 4) << {4 + 2 * (5 - i)})" for i in range(6)) + " + r_regionkey * 3"
ORACLES = {
    "macro_texts": f"""with recursive t as (select conv_id, turn, text || ({_quoted(ADDED)})[((conv_id + turn) % {len(ADDED)} + 1)::int] || ({_quoted(ADDED)})[((conv_id * 7 + turn * 3) % {len(ADDED)} + 1)::int] || 'end' as t from conversations),
s as (select conv_id, turn, 0 as n, '' as unit, t as rest from t
  union all select conv_id, turn, n + 1, case when k.glued then chr(57344 + k.n) else rest[1] end, case when k.glued then substr(rest, length(k.k) + 1) else substr(rest, 2) end
  from (select *, list_filter({_KEYS_SQL}, lambda x: starts_with(rest, x.k))[1] as k from s where rest <> '')),
m as (select conv_id, turn, string_agg(unit, '' order by n) as marked from s group by all),
u as (select conv_id, turn, marked, flatten(list_transform(regexp_extract_all({_replaced('marked')}, '[{_M}]|[{_PRIVATE}]|[^{_M}{_PRIVATE}]+'), lambda u: case when regexp_full_match(u, '[{_M}]') then [unicode(u)]
  when regexp_full_match(u, '[{_PRIVATE}]') then [524288 + {_NUMBER} + unicode(u) - 57344] else list_transform(range(0, (strlen(u) + 1) // 2), lambda i: 262144 + ('0x' || rpad(substr(hex(u), 1 + 4 * i, 4), 4, '0'))::int) end)) as w from m)
select conv_id, turn, len(regexp_extract_all(marked, '[{_PRIVATE}]')) as macros, sha256(array_to_string(w, ',')) as words_sha, sha256(t) as text_sha from u join t using (conv_id, turn)""",
    "macro_strokes": f"""with p as (select r_regionkey, [{_STATE(0)}, {_STATE(1)}] as w from region)
select n_name as emoji, array_to_string(list_concat(list_concat(a.w, b.w), a.w), ',') as words from nation join p a on n_regionkey = a.r_regionkey join p b on n_nationkey % 5 = b.r_regionkey""",
}
QUERIES = {f.__name__: f for f in (macro_texts, macro_strokes)}
