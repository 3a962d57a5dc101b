"""The queries opN_<name>, thin over the operators, and the SQL that tells the same where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.llm import bpe, chat, exact_dedup, filters, fim, licences, lm_scoring, mixing, packing, pii, quality, simhash, sketches
from polyweft.llm.common import documents, remainder, text_of


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies: beside POLYWEFT_TOKENIZERS if that is set, else where its package has it."""
    folder = os.environ.get("POLYWEFT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.scored(documents(spark, sf_dir), remainder(F.col("doc_id")) != 1, tokenizer_path("byte_bpe_50k.tiktoken"), pretoken_pattern())
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


OP2_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed(docs, rating=quality.rating(labels, ~quality.held_out(F.col("doc_id")))).drop("source")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scanned(documents(spark, sf_dir))
    return out.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"), "has_licence")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path(packing.VOCABULARY))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.scored(documents(spark, sf_dir), labels, ~quality.held_out(F.col("doc_id")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.formatted(turns.unionByName(more)).withColumns({"turns": chat.read_back(F.col("text")), "learnt": F.array_join(chat.loss_texts(F.col("text"), F.col("loss")), "")})
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        sha(F.col("learnt")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"replace(replace(replace(replace(replace({0}, '\', '\b'), '### ', '\h'), '</turn>', '\e'), '<more/>', '\m'), '<none/>', '\n')"
OP8_SQL = rf"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, coalesce(replace({_ESCAPED.format("role")}, ':', '\c'), '<none/>') as head, {_ESCAPED.format("text")} as body from t),
o as (select *, row_number() over w as n, coalesce(head = lag(head) over w, false) as merged, coalesce(head = lead(head) over w, false) as goes_on from e
  window w as (partition by conv_id order by turn nulls first, head, body)),
l as (select *, case when merged then length(chr(10) || '<more/>' || chr(10)) else length('### ') + length(head) + length(':' || chr(10)) end + length(body) + case when goes_on then 0 else length('</turn>' || chr(10)) end as chars from o)
select conv_id, count(*) as n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  sum(case when head = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by n) filter (head = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from l group by conv_id
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(documents(spark, sf_dir)).drop("own", "changed")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.found(documents(spark, sf_dir))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[number(k) for k in pii.KINDS], F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), with_output=False)
    return out.select("doc_id", *[f"fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


OP11_SQL = r"""
with u as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
h as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from u),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:lo], '') as p, array_to_string(u[lo + 1:hi], '') as m, array_to_string(u[hi + 1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from p
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir).select("doc_id", bpe.round_trip(text_of(), tokenizer_path(bpe.VOCABULARY)).alias("b"))
    return out.select("doc_id", bpe.n_tokens(F.col("b.ids")).alias("n_tokens"), F.sha2("b.ids", 256).alias("ids_sha256"), F.sha2(F.col("b.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
with l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
  coalesce(doc_id > min(doc_id) over (partition by coalesce(text, '')), false) as later from documents),
m as (select t.doc_id, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
  'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': later} as f from t left join l on t.doc_id = l.doc_id),
k as (select part, (case when f.A then 'A' else '' end) || (case when f.B then 'B' else '' end) || (case when f.C then 'C' else '' end) || (case when f.D then 'D' else '' end) || (case when f.E then 'E' else '' end) as fails,
  count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as o from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select o as filter_order, i::int as step, o[i] as f, o[:i - 1] as before, o[:i] as upto from o, range(1, 6) r(i)),
r as (select part, filter_order, step, f, sum(case when translate(fails, upto, '') = fails then n else 0 end) as kept,
  sum(case when contains(fails, f) and translate(fails, before, '') = fails then n else 0 end) as removed,
  sum(case when contains(fails, f) and translate(fails, before, '') <> fails then n else 0 end) as redundant,
  sum(case when fails = f then n else 0 end) as unique_fails,
  sum(case when contains(fails, f) and translate(fails, before, '') = fails then good else 0 end) as good_lost,
  sum(case when contains(fails, f) and translate(fails, before, '') = fails then toxic else 0 end) as toxic_lost from k, s group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from r
"""


_OPERATORS = (op1_lm_scoring, op2_exact_dedup, op3_mixing, op4_licences, op5_simhash, op6_packing, op7_quality, op8_chat_format, op9_fingerprints, op10_pii, op11_fim, op12_bpe, op13_filters)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op4_licences": licences.oracle(), "op8_chat_format": OP8_SQL, "op11_fim": OP11_SQL, "op13_filters": OP13_SQL}
