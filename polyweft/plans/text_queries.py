"""Queries over the text codec and the scalar functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweft.functions import scalars as S
from polyweft.functions import text as T
from polyweft.functions import words as W
from polyweft.plans.common import table
from polyweft.storage import written


def _as_text(words) -> F.Column:
    return F.array_join(F.transform(words, lambda w: w.cast("string")), ",")


def text_encode_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("chars"), T.encode(F.col("text")).alias("words"))
    escapes = F.size(F.filter("words", lambda w: W.mode(w) == W.ESCAPE))
    out = d.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("words")).alias("n_words"), F.sum(escapes).alias("n_escapes"), F.sum("chars").alias("n_chars"))
    return out.withColumn("words_per_mille_chars", F.rint(F.col("n_words") * 1000 / F.col("n_chars")).cast("long"))


def text_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.encode(F.col("text")).alias("words"))
    return d.select("doc_id", F.size("words").cast("long").alias("n_words"), F.sha2(_as_text("words"), 256).alias("words_sha"))


def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = written(table(spark, sf_dir, "conversations").select("conv_id", "turn", T.encode(F.col("text")).alias("words")), "words")
    return w.select("conv_id", "turn", F.sha2(T.decode(F.col("words")), 256).alias("text_sha"))


def text_decode_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the benchmark's passages."""
    w = written(table(spark, sf_dir, "benchmark").select("item_id", T.encode(F.col("text")).alias("words")), "words")
    return w.select("item_id", F.sha2(T.decode(F.col("words")), 256).alias("text_sha"))


# texts of many alphabets: composed and decomposed letters, marks in another order, syllables, emoji
_ALPHABETS = ("plain", "déjà vu ßœ", "Škoda ő Žižka", "ή Ελλάδα ώ", "tiếng Việt ấ", "한국어 각", "日本語 が ガ", "й ё їжак", "नमस्ते क़", "مرحبا آ", "e\u0301 q\u0323\u0307 q\u0307\u0323", "👩‍👩‍👧 🇫🇷 \u212b", "", "\u0344 \u2126", "x\ty\r\nz\x01")


def text_alphabets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts of many alphabets, and the text that comes back: its composed form."""
    given = F.array(*[F.lit(t) for t in _ALPHABETS])
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.element_at(given, (F.col("n_nationkey") % len(_ALPHABETS) + 1).cast("int")), F.lit("|"), F.col("n_name")).alias("t"))
    w = written(n.select("n_nationkey", T.encode(F.col("t")).alias("words")), "words")
    return w.select("n_nationkey", _as_text("words").alias("words"), F.sha2(T.decode(F.col("words")), 256).alias("back_sha"))


def escape_only_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", _as_text(T.encode_escape_only(F.col("text"))).alias("words"))


def split_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.split_text(F.col("text"), 64)).alias("chunk", "piece"))
    return c.select("conv_id", "turn", F.col("chunk").cast("long").alias("chunk"), "piece")


def chunk_token_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose pieces do not encode to what the whole text encodes to."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    pieces = c.select("conv_id", "turn", F.posexplode(T.split_text(F.col("text"), 5)).alias("k", "piece")).select("conv_id", "turn", "k", T.encode(F.col("piece")).alias("words"))
    by_piece = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "words"))), lambda p: p["words"]))
    joined = pieces.groupBy("conv_id", "turn").agg(by_piece.alias("by_piece")).join(c.select("conv_id", "turn", T.encode(F.col("text")).alias("whole")), ["conv_id", "turn"])
    return joined.groupBy("conv_id").agg(F.count_if(F.col("by_piece") != F.col("whole")).alias("mismatches"))


def bpe_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(W.bpe_word((F.col("l_partkey") % 4096).cast("int")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bpe_vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with the names of a vocabulary; those without one give an empty text."""
    tokens = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4096).cast("int").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("token"), F.col("p_name").alias("name"))
    return tokens.join(vocabulary, "token", "left").select("token", "n", F.coalesce("name", F.lit("")).alias("text"), T.bpe_mark(F.col("token")).alias("mark"))


def unit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    strokes = F.array(*[F.shiftright(F.col("p_partkey"), 2 * i).bitwiseAND(3).cast("int") for i in range(6)])
    return p.select("p_partkey", W.unit_word(strokes, F.col("p_size") % 16).alias("word"))


def music_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", W.music_macro((F.col("p_partkey") % 65536).cast("int")).alias("word"))


def keyword_form_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that get a keyword by their number, their form, symmetry and directions."""
    words = [k for kws in S.FORMS.values() for k in kws]
    d = table(spark, sf_dir, "documents")
    given = F.concat_ws(" ", "text", F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % len(words) + 1).cast("int")), F.when(F.col("doc_id") % 2 == 0, "Counter-Clockwise  grid").otherwise(""))
    d = d.select("doc_id", given.alias("t"))
    f = d.withColumn("f", S.form_class(F.col("t"))).withColumns({"form": F.col("f.form"), "score": F.col("f.score")}).withColumn("symmetry", S.symmetry(F.col("t"), F.col("form")))
    modulus = S.directions_of(F.col("symmetry"))
    dirs = S.base_directions(F.col("form"), modulus, S.chirality(F.col("t")))
    return f.select("doc_id", "form", "score", "symmetry", _as_text(dirs).alias("directions"))


def symmetry_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(s) for s in ("D1", "D2", "D4", "D6")]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("s"), F.when(F.col("p_partkey") % 3 == 0, 12).otherwise(8).alias("m"), F.array((F.col("p_size") % 8).cast("int"), (F.col("p_partkey") % 8).cast("int")).alias("d"))
    turned = S.rotated(F.col("d"), F.col("s"), F.col("m"))
    return p.select("p_partkey", F.array_join(F.transform(turned, lambda t: _as_text(t)), "|").alias("turned"), S.is_symmetric(F.flatten(turned), F.col("s"), F.col("m")).alias("symmetric"), S.is_symmetric(F.concat("d", F.array(F.lit(1))), F.lit("D2"), F.lit(8)).alias("odd"))


def phoneme_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select(F.explode(S.letters_to_phonemes(F.col("text"))).alias("p"))
    return d.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.col("p").alias("phoneme"), S.phoneme_class(F.col("p")).alias("class"), "n")


def ipa_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every IPA sign with marks around it, over the regions."""
    signs = [*S.IPA, "ˈaɪ", "t͡ʃ", "qq", "?", "|", "xdʒ"]
    r = table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*[F.lit(s) for s in signs])).alias("sign"))
    return r.select("r_regionkey", "sign", S.ipa_to_phoneme(F.concat(F.lit(" "), F.upper("sign"))).alias("phoneme"))


def phoneme_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("-"), (F.col("p_size") % 5).cast("string")).alias("raw"))
    t = p.withColumn("t", S.phoneme_token(F.col("raw")))
    return t.select("p_partkey", F.col("t.symbol").alias("symbol"), F.col("t.stress").alias("stress"))


def colour_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = ("#F00", " #00FFFF ", "#123456", None, "#ff0", "red")
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(c) for c in colours]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("c"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") / 4.0).alias("w"), F.element_at(F.array(F.lit("Dash"), F.lit(None), F.lit("dotty")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("d"))
    code = p.withColumn("s", S.style_code(F.col("c"), F.col("w"), F.col("d")))
    back = S.style_of(F.col("s.width"), F.col("s.colour"), F.col("s.dash"))
    return code.select("p_partkey", F.col("s.width").alias("width"), F.col("s.colour").alias("colour"), F.col("s.dash").alias("dash"), back["stroke"].alias("stroke"))


def odor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyweft.functions.codecs import ODORS

    given = ("floral", "spicy-herbal", " woody/earthy", "Putrid Decay", "3", "9", "nothing")
    turns = ("L", "left", "R", "-", "1", "0")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(g) for g in given]), (F.col("s_suppkey") % 7 + 1).cast("int")).alias("g"), F.element_at(F.array(*[F.lit(t) for t in turns]), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("t"))
    return s.select("s_suppkey", S.category_code(F.col("g"), tuple(ODORS)).alias("category"), S.chirality_code(F.col("t")).alias("chirality"))


#: Letters of the tables' texts that decompose; DuckDB has no decomposed form.
_LATIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"


def _replaced(expr: str) -> str:
    for c in _LATIN:
        expr = f"replace({expr}, '{c}', '{unicodedata.normalize('NFD', c)}')"
    return expr


_M = r"\x20-\x7E\t\n\r" + T._OWN_LETTERS
_PAIRS = "list_transform(range(0, (strlen(u) + 1) // 2), lambda i: 262144 + ('0x' || rpad(substr(hex(u), 1 + 4 * i, 4), 4, '0'))::int)"


def _words(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({_replaced(text)}, '[{_M}]|[^{_M}]+'), lambda u: case when regexp_full_match(u, '[{_M}]') then [unicode(u)] else {_PAIRS} end))"


def _sql_texts(form: str) -> str:
    """The texts of ``text_alphabets`` in a normal form; control characters by number."""
    text = lambda t: " || ".join(f"chr({ord(c)})" if c < " " else f"'{c}'" for c in unicodedata.normalize(form, t)) or "''"
    return "[" + ", ".join(text(t) for t in _ALPHABETS) + "]"


def _arr(values) -> str:
    return "[" + ", ".join("null" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _member(value: str, groups: dict) -> str:
    return "case " + " ".join(f"when {value} in ({', '.join(repr(x) for x in xs)}) then '{n}'" for n, xs in groups.items()) + " else 'other' end"


_ALL = [k for kws in S.FORMS.values() for k in kws]
_SCORES = {n: " + ".join(f"contains(q, '{k}')::int" for k in kws) for n, kws in S.FORMS.items()}
_SPIRALS = {(m, t): ",".join(str(i * t % m) for i in range(m)) for m in (8, 12) for t in (1, -1)}
_BASE = "case " + " ".join(f"when form = 'SPIRAL' and m = {m} and turn = {t} then '{v}'" for (m, t), v in _SPIRALS.items()) + " " + " ".join(f"when form = '{f}' and m = {m} then '{','.join(map(str, d))}'" for m, fs in S.BASES.items() for f, d in fs.items()) + " end"
_STEPS = "case " + " ".join(f"when s = '{n}' and m = {m} then {list(v)}" for m, gs in S.ROTATIONS.items() for n, v in gs.items()) + " end"
# whether a list is the turns of its first part by every step
_TURNS = lambda xs, steps, m: f"(len({xs}) % len({steps}) = 0 and flatten(list_transform({steps}, lambda t: list_transform(({xs})[1:len({xs}) // len({steps})], lambda d: (d + t) % {m}))) = {xs})"
_IPA_ONE = {k: v for k, v in S.LETTERS.items()} | {k: v for k, v in S.IPA.items() if len(k) == 1}
_MAP = lambda d: "map(" + _arr(d.keys()) + ", " + _arr(d.values()) + ")"

ORACLES = {
    "text_encode_by_lang": f"""with d as (select lang, length(text) as chars, {_words('text')} as words from documents),
g as (select lang, count(*) as documents, sum(len(words))::bigint as n_words, sum(len(list_filter(words, lambda w: w >> 18 = 1)))::bigint as n_escapes, sum(chars)::bigint as n_chars from d group by lang)
select *, cast(round_even(n_words * 1000 / n_chars::double, 0) as bigint) as words_per_mille_chars from g""",
    "text_encode_words": f"with d as (select doc_id, {_words('text')} as words from documents) select doc_id, len(words) as n_words, sha256(array_to_string(words, ',')) as words_sha from d",
    "text_decode": "select conv_id, turn, sha256(text) as text_sha from conversations",
    "text_alphabets": f"""with g as (select n_nationkey, ({_sql_texts('NFD')})[n_nationkey % {len(_ALPHABETS)} + 1] || '|' || n_name as u, ({_sql_texts('NFC')})[n_nationkey % {len(_ALPHABETS)} + 1] || '|' || n_name as c from nation)
select n_nationkey, array_to_string(flatten(list_transform(regexp_extract_all(u, '[{_M}]|[^{_M}]+'), lambda u: case when regexp_full_match(u, '[{_M}]') then [unicode(u)] else {_PAIRS} end)), ',') as words, sha256(c) as back_sha from g""",
    "text_decode_general": "select item_id, sha256(text) as text_sha from benchmark",
    "escape_only_variant": f"with b as (select item_id, {_replaced('text')} as u from benchmark) select item_id, array_to_string({_PAIRS}, ',') as words from b",
    "split_text_chunks": "with c as (select conv_id, turn, text, unnest(range(0, greatest((length(text) + 63) // 64, 1))) as chunk from conversations) select conv_id, turn, chunk, substr(text, 1 + chunk * 64, 64) as piece from c",
    "chunk_token_mismatch": f"""with c as (select conv_id, turn, text, unnest(range(0, greatest((length(text) + 4) // 5, 1))) as k from conversations), p as (select conv_id, turn, k, substr(text, 1 + k * 5, 5) as piece from c),
e as (select conv_id, turn, flatten(list({_words('piece')} order by k)) as a from p group by conv_id, turn), w as (select conv_id, turn, {_words('text')} as b from conversations)
select conv_id, count(*) filter (a != b) as mismatches from e join w using (conv_id, turn) group by conv_id""",
    "bpe_bridge": "select (524288 + 4096 + l_partkey % 4096)::int as word, count(*) as n from lineitem group by 1",
    "bpe_vocab_lookup": "with t as (select (l_partkey % 4096)::int as token, count(*) as n from lineitem group by 1) select token, n, coalesce(p_name, '') as text, chr(65534) || upper(to_hex(token)) || chr(65534) as mark from t left join part on p_partkey = token",
    "unit_words": "select p_partkey, cast(" + " + ".join(f"(((p_partkey >> {2 * i}) & 3) << {4 + 2 * (5 - i)})" for i in range(6)) + " + p_size % 16 as int) as word from part",
    "music_macros": "select p_partkey, (196608 + p_partkey % 65536)::int as word from part",
    "keyword_form_class": f"""with d as (select doc_id, trim(regexp_replace(lower(concat_ws(' ', text, ({_arr(_ALL)})[(doc_id % {len(_ALL)} + 1)::int], case when doc_id % 2 = 0 then 'Counter-Clockwise  grid' else '' end)), '\\s+', ' ', 'g')) as q from documents),
s as (select doc_id, q, {', '.join(f'{e} as s_{n.lower()}' for n, e in _SCORES.items())} from d),
b as (select *, greatest({', '.join(f's_{n.lower()}' for n in S.FORMS)}) as score from s),
f as (select *, case when score = 0 then 'COBWEB' {' '.join(f"when s_{n.lower()} = score then '{n}'" for n in S.FORMS)} end as form from b),
y as (select *, case when contains(q, 'hexagon') or contains(q, 'honeycomb') or contains(q, 'tiling') then 'D6' when form = 'LATTICE' then 'D2' else 'D4' end as symmetry from f),
z as (select *, case when symmetry = 'D6' then 12 else 8 end as m, case when contains(q, 'counter-clockwise') or contains(q, 'ccw') then -1 else 1 end as turn from y)
select doc_id, form, score::int as score, symmetry, {_BASE} as directions from z""",
    "symmetry_group": f"""with p as (select p_partkey, (['D1', 'D2', 'D4', 'D6'])[(p_partkey % 4 + 1)::int] as s, case when p_partkey % 3 = 0 then 12 else 8 end as m, p_size % 8 as a, p_partkey % 8 as b from part)
select p_partkey, array_to_string(list_transform({_STEPS}, lambda t: ((a + t) % m)::varchar || ',' || ((b + t) % m)::varchar), '|') as turned,
{_TURNS(f"flatten(list_transform({_STEPS}, lambda t: [(a + t) % m, (b + t) % m]))", _STEPS, 'm')} as symmetric, {_TURNS('[a, b, 1]', str(list(S.ROTATIONS[8]['D2'])), '8')} as odd from p""",
    "phoneme_classes": f"with l as (select list_filter(list_transform(string_split(lower(text), ''), lambda c: map_extract_value({_MAP(S.LETTERS)}, c)), lambda p: p is not null) as ps from conversations), x as (select unnest(case when len(ps) > 0 then ps else ['AH'] end) as phoneme from l) select phoneme, {_member('phoneme', S.PHONEMES)} as class, count(*) as n from x group by phoneme",
    "ipa_phonemes": f"""with r as (select r_regionkey, unnest({_arr([*S.IPA, 'ˈaɪ', 't͡ʃ', 'qq', '?', '|', 'xdʒ'])}) as sign from region), t as (select *, lower(trim(' ' || upper(sign))) as raw, translate(lower(trim(' ' || upper(sign))), 'ˈˌ͡', '') as token from r)
select r_regionkey, sign, case when raw in ('', '|') then 'SP' else coalesce(map_extract_value({_MAP(S.IPA)}, token), {', '.join(f"case when contains(token, '{p}') then '{S.IPA[p]}' end" for p in S.IPA_PAIRS)}, list_filter(list_transform(string_split(token, ''), lambda c: map_extract_value({_MAP(_IPA_ONE)}, c)), lambda p: p is not null)[1], 'AH') end as phoneme from t""",
    "phoneme_tokens": "with p as (select p_partkey, upper(regexp_replace(p_name || '-' || (p_size % 5), '[^A-Za-z0-2]', '', 'g')) as c from part) select p_partkey, case when c != '' then regexp_replace(c, '[0-2]$', '') end as symbol, case when c != '' then regexp_matches(c, '[12]$') end as stress from p",
    "colour_styles": f"""with p as (select p_partkey, ({_arr(('#F00', ' #00FFFF ', '#123456', None, '#ff0', 'red'))})[(p_partkey % 6 + 1)::int] as c, case when p_partkey % 4 != 0 then p_size / 4.0::double end as w, ({_arr(('Dash', None, 'dotty'))})[(p_partkey % 3 + 1)::int] as d from part),
l as (select p_partkey, c, w, d, regexp_replace(lower(trim(c)), '^#(.)(.)(.)$', '#\\1\\1\\2\\2\\3\\3') as h from p),
k as (select p_partkey, c is not null or w is not null or d is not null as any_, least(greatest(round_even(coalesce(w, 1.0::double), 0)::int, 1), 10) as width, greatest(coalesce(list_position({_arr(S.COLOURS)}, h), 0) - 1, 0) as colour, greatest(coalesce(list_position({_arr(S.DASHES)}, lower(trim(d))), 0) - 1, 0) as dash from l)
select p_partkey, case when any_ then width end as width, case when any_ then colour end as colour, case when any_ then dash end as dash, case when any_ then ({_arr(S.COLOURS)})[colour + 1] end as stroke from k""",
    "odor_tokens": f"""with s as (select s_suppkey, ({_arr(('floral', 'spicy-herbal', ' woody/earthy', 'Putrid Decay', '3', '9', 'nothing'))})[(s_suppkey % 7 + 1)::int] as g, ({_arr(('L', 'left', 'R', '-', '1', '0'))})[(s_suppkey % 6 + 1)::int] as t from supplier)
select s_suppkey, coalesce(case when try_cast(g as int) between 0 and 7 then try_cast(g as int) end, nullif(coalesce(list_position({_arr(('FLORAL', 'FRUITY', 'SPICY_HERBAL', 'WOODY_EARTHY', 'CHEMICAL_SOLVENT', 'MUSKY_ANIMAL', 'MINTY_CAMPHOR', 'PUTRID_DECAY'))}, translate(upper(trim(g)), '-/ ', '___')), 0), 0) - 1)::int as category, (upper(trim(t)) in ('L', 'R', '+', 'LEFT', '1'))::int as chirality from s""",
}
QUERIES = {
    f.__name__: f
    for f in (
        text_encode_by_lang, text_encode_words, text_decode, text_decode_general, text_alphabets, escape_only_variant, split_text_chunks, chunk_token_mismatch, bpe_bridge, bpe_vocab_lookup, unit_words, music_macros,
        keyword_form_class, symmetry_group, phoneme_classes, ipa_phonemes, phoneme_tokens, colour_styles, odor_tokens,
    )
}
