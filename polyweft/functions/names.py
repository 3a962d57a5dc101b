"""The library's word functions under names of their own, for queries written as SQL text.

``register`` makes temporary SQL functions: their bodies are expressions, which Spark puts into the plan of a query, so
that they are optimised with it. The normal forms alone are Arrow functions, for texts that are not all ASCII; as with
``text.decode``, words to decode must be a stored column, not the result of ``encode_words`` in the same query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from polyweft.functions import text as T
from polyweft.functions import words as W

_M = T.MAPPED.replace("\\", "\\\\")
_ASCII = r"^[\\x00-\\x7F]*$"
_OWN = ", ".join(map(str, sorted({9, 10, 13, *range(0x20, 0x7F), *(ord(c) for c in T._OWN_LETTERS + T.DECODED_ONLY)})))
_RUN = "transform(sequence(0, cast(ceil(octet_length(u) / 2) as int) - 1), i -> cast(conv(rpad(substr(hex(encode(u, 'UTF-8')), 1 + 4 * i, 4), 4, '0'), 16, 10) as int) + 262144)"
_BYTE = lambda v: f"lpad(hex(bigint({v})), 2, '0')"
# a function of SQL cannot be called in a lambda: fields are taken here
_MODE, _VERSION, _PAYLOAD = "((w >> 18) & 3)", "((w >> 16) & 3)", "(w & 65535)"
_HEX = f"if({_MODE} = 1, concat({_BYTE('(w >> 8) & 255')}, if(w & 255 <> 0, {_BYTE('w & 255')}, '')), case {_PAYLOAD} when 338 then 'C592' when 339 then 'C593' else hex(encode(chr({_PAYLOAD}), 'UTF-8')) end)"
_KNOWN = f"{_VERSION} = 0 and ({_MODE} = 1 or ({_MODE} = 0 and {_PAYLOAD} in ({_OWN})))"
_IMAGE = f"w & {W.IMAGE_FAMILY} = {W.IMAGE_ENHANCED}"

#: name and arguments, type, body; a body may use the functions before it.
FUNCTIONS = (
    ("word_mode(w int)", "int", _MODE),
    ("word_version(w int)", "int", _VERSION),
    ("word_payload(w int)", "int", _PAYLOAD),
    ("word_is_valid(w int)", "boolean", f"coalesce(w between 0 and {W.WORD_MAX}, false)"),
    (
        "word_modality(w int)", "string",
        f"case when not word_is_valid(w) then null when word_mode(w) = 3 and w & {W.MENTAL} <> 0 then 'mental' when word_mode(w) <> 2 then 'text' when w & {W.MUSIC} <> 0 then 'music' when w & {W.VOICE} <> 0 then 'voice' when w & {W.DIAGRAM} <> 0 then 'diagram' "
        f"when w & {W.BPE} <> 0 then 'bpe' when {_IMAGE} then 'image' when w & {W.TOUCH} <> 0 then 'touch' when w & {W.SMELL} <> 0 then 'smell' when w & {W.MENTAL} <> 0 then 'mental' else 'text' end",
    ),
    (
        "encode_words(t string)", "array<int>",
        f"flatten(transform(regexp_extract_all(coalesce(polyweft_nfd(case when not rlike(t, '{_ASCII}') then t end), t), '([{_M}]+|[^{_M}]+)', 0), u -> if(rlike(u, '^[{_M}]'), transform(split(u, ''), c -> ascii(c)), {_RUN})))",
    ),
    ("words_as_written(ws array<int>)", "string", f"try_validate_utf8(cast(if(forall(ws, w -> {_KNOWN}), unhex(array_join(transform(ws, w -> {_HEX}), '')), null) as string))"),
    ("decode_words(ws array<int>)", "string", f"coalesce(polyweft_nfc(case when not rlike(words_as_written(ws), '{_ASCII}') then words_as_written(ws) end), words_as_written(ws))"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions in a session, in place of earlier ones of these names; gives the names."""
    for form in ("nfd", "nfc"):
        spark.udf.register(f"polyweft_{form}", T._normal(form.upper()))
    for head, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {head} returns {kind} return {body}")
    return [head.partition("(")[0] for head, _, _ in FUNCTIONS]
