"""Streams as relations (stream_id, pos, word): dispatch, blocks, counts, filters, validation and decoding.

All windows of a stream share one partitioning, by stream_id, and one order, by pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweft.functions import text as T
from polyweft.functions import words as W


def _stream():
    """Made when used: a window needs a session."""
    return Window.partitionBy("stream_id").orderBy("pos")


def _upto():
    return _stream().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_arrays(df: DataFrame, words: str = "words") -> DataFrame:
    """One row for each word of an array column."""
    return df.select("stream_id", F.posexplode(words).alias("pos", "word"))


def to_arrays(stream: DataFrame) -> DataFrame:
    """One row for each stream; order is carried by pos."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return stream.groupBy("stream_id").agg(F.transform(pairs, lambda p: p["word"]).alias("words"))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """(stream_id, pos, word, kind) of JSON arrays with elements of any type.

    What is no integer in range has a null word and its type in kind; what is no JSON array gives no row.
    """
    parsed = df.select("stream_id", F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").startswith("ARRAY"))
    exploded = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    rows = exploded.select("stream_id", "pos", F.schema_of_variant("value").alias("kind"), F.try_variant_get("value", "$", "bigint").alias("n"))
    whole = F.col("kind") == "BIGINT"
    return rows.select("stream_id", "pos", F.when(whole & F.col("n").between(0, W.WORD_MAX), F.col("n")).cast("int").alias("word"), "kind", "n")


def coerced(stream: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of ``from_json`` with valid and error. ``strict`` false: a boolean counts as 0 or 1."""
    is_bool = F.col("kind") == "BOOLEAN"
    number = F.when(is_bool & F.lit(not strict), F.col("n")).when(F.col("kind") == "BIGINT", F.col("n"))
    bad_type = F.concat(F.lit("index "), F.col("pos"), F.lit(": non-int word type="), F.lower("kind"))
    bad_range = F.concat(F.lit("index "), F.col("pos"), F.lit(": word out of range "), number)
    error = F.when(number.isNull(), bad_type).when(~number.between(0, W.WORD_MAX), bad_range)
    return stream.withColumns({"word": F.when(error.isNull(), number).cast("int"), "error": error})


def dispatched(stream: DataFrame) -> DataFrame:
    """``stream`` with modality; a null or out-of-range word has none.

    A taste block starts where three neighbouring extension words with the taste bit have versions 0, 1, 2, and
    goes on over such words of version 2 or 3; this comes before the modality of single words.
    """
    ok = F.coalesce(W.in_range("word"), F.lit(False))
    bit = ok & W.is_taste_bit("word")
    at = lambda k, v: F.coalesce(F.lead(bit & (W.version("word") == v), k).over(_stream()), F.lit(False)) if k else bit & (W.version("word") == v)
    marked = stream.withColumns({"_start": at(0, 0) & at(1, 1) & at(2, 2), "_more": bit & W.version("word").isin(2, 3)})
    near = lambda k: F.coalesce(F.lag("_start", k).over(_stream()), F.lit(False))
    marked = marked.withColumn("_in", F.col("_start") | near(1) | near(2))
    # a continuation belongs to a block if the word before it does
    settled = F.when(F.col("_in") | ~F.col("_more"), F.col("_in"))
    taste = F.coalesce(F.last(settled, ignorenulls=True).over(_upto()), F.lit(False))
    return marked.withColumn("modality", F.when(ok, F.when(taste, "taste").otherwise(W.modality("word")))).drop("_start", "_more", "_in")


def blocks(classified: DataFrame) -> DataFrame:
    """(stream_id, modality, block, start, words): the longest runs of one modality; text and bpe separate, and an invalid word does."""
    m = F.coalesce("modality", F.lit(""))
    change = F.coalesce((m != F.lag(m).over(_stream())).cast("int"), F.lit(1))
    numbered = classified.withColumn("_island", F.sum(change).over(_upto())).where("modality not in ('text', 'bpe')")
    pairs = F.array_sort(F.collect_list(F.struct("pos", "word")))
    out = numbered.groupBy("stream_id", "modality", "_island").agg(F.min("pos").alias("start"), F.transform(pairs, lambda p: p["word"]).alias("words"))
    order = Window.partitionBy("stream_id", "modality").orderBy("start")
    return out.select("stream_id", "modality", (F.row_number().over(order) - 1).alias("block"), "start", "words")


def counts(classified: DataFrame) -> DataFrame:
    """One row for each stream: n_<label> of all labels and total_words, invalid words left out."""
    return classified.groupBy("stream_id").agg(*[F.count_if(F.col("modality") == m).alias(f"n_{m}") for m in W.LABELS], F.count("modality").alias("total_words"))


def ratios(counted: DataFrame) -> DataFrame:
    share = lambda m: F.coalesce(F.try_divide(F.col(f"n_{m}"), F.col("total_words")), F.lit(0.0)).alias(f"r_{m}")
    return counted.select("*", *[share(m) for m in W.LABELS])


def only(classified: DataFrame, label: str) -> DataFrame:
    """Words of one modality; the filter stands above the windows, which need all neighbours."""
    return classified.where(F.col("modality") == label)


def without(classified: DataFrame, label: str) -> DataFrame:
    return classified.where(F.col("modality") != label)


def validation(stream: DataFrame) -> DataFrame:
    """(stream_id, valid, errors): messages of the words, then one if the text cannot be decoded."""
    message = F.when(F.col("word").isNull(), F.concat(F.lit("index "), F.col("pos"), F.lit(": non-int word"))).when(~W.in_range("word"), F.concat(F.lit("index "), F.col("pos"), F.lit(": word out of range "), F.col("word")))
    found = F.array_sort(F.collect_list(F.when(message.isNotNull(), F.struct("pos", message.alias("m")))))
    told = stream.groupBy("stream_id").agg(F.transform(found, lambda e: e["m"]).alias("word_errors"))
    read = texts(dispatched(stream)).select("stream_id", F.col("text").isNull().alias("unread"))
    errors = F.concat("word_errors", F.when(F.coalesce("unread", F.lit(False)), F.array(F.lit("text: malformed words"))).otherwise(F.expr("cast(array() as array<string>)")))
    return told.join(read, "stream_id", "left").select("stream_id", errors.alias("errors")).select("stream_id", (F.size("errors") == 0).alias("valid"), "errors")


def texts(classified: DataFrame) -> DataFrame:
    """(stream_id, text, tokens): text words joined across other blocks and cut at bpe words, each cut decoded alone; null if one cannot be."""
    own = classified.where("modality in ('text', 'bpe')").withColumn("cut", F.sum((F.col("modality") == "bpe").cast("int")).over(_upto()))
    plain = F.transform(F.array_sort(F.collect_list(F.when(F.col("modality") == "text", F.struct("pos", "word")))), lambda p: p["word"])
    token = F.max(F.when(F.col("modality") == "bpe", W.payload("word", 12)))
    cuts = own.groupBy("stream_id", "cut").agg(plain.alias("plain"), token.alias("token")).select("stream_id", "cut", T.decode(F.col("plain")).alias("text"), "token")
    ordered = F.array_sort(F.collect_list(F.struct("cut", "text", "token")))
    parts = cuts.groupBy("stream_id").agg(ordered.alias("parts"))
    whole = F.when(F.forall("parts", lambda p: p["text"].isNotNull()), F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    return parts.select("stream_id", whole.alias("text"), F.filter(F.transform("parts", lambda p: p["token"]), lambda t: t.isNotNull()).alias("tokens"))


def texts_safe(classified: DataFrame) -> DataFrame:
    """``texts``, a second time without malformed text words where the first failed; (stream_id, text, tokens, dropped)."""
    strict = texts(classified)
    good = (F.col("modality") == "bpe") | ((F.col("modality") == "text") & T.decodable(F.col("word")))
    dropped = classified.where(F.col("modality").isin("text", "bpe") & ~good).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    again = texts(classified.where(good)).select("stream_id", F.col("text").alias("text2"), F.col("tokens").alias("tokens2"))
    joined = strict.join(again, "stream_id", "left").join(dropped, "stream_id", "left")
    failed = F.col("text").isNull()
    return joined.select("stream_id", F.coalesce("text", "text2", F.lit("")).alias("text"), F.when(failed, F.coalesce("tokens2", F.expr("cast(array() as array<int>)"))).otherwise(F.col("tokens")).alias("tokens"), F.when(failed, F.coalesce("n", F.lit(0))).otherwise(0).alias("dropped"))


def summary(stream: DataFrame) -> DataFrame:
    return ratios(counts(dispatched(stream))).join(validation(stream), "stream_id")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Streams one after the other, positions numbered anew."""
    tagged = [p.select("stream_id", F.lit(i).alias("part"), "pos", "word") for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    order = Window.partitionBy("stream_id").orderBy("part", "pos")
    return both.select("stream_id", (F.row_number().over(order) - 1).alias("pos"), "word")


def mode_shares(stream: DataFrame) -> DataFrame:
    m = lambda k: F.count_if(W.mode("word") == k)
    share = lambda k, name: (m(k) / F.count("word")).alias(name)
    return stream.groupBy("stream_id").agg(share(0, "normal"), share(1, "escape"), share(2, "extension"), share(3, "reserved"), F.count_if((W.mode("word") == 3) & ~W.has("word", W.MENTAL)).alias("reserved_non_mental"))


def checkpoints(classified: DataFrame, points: int = 48) -> DataFrame:
    """Running counts, transitions and mean segment length at up to ``points`` prefixes of each stream."""
    whole = Window.partitionBy("stream_id")
    change = F.coalesce((F.col("modality") != F.lag("modality").over(_stream())).cast("int"), F.lit(0))
    n = F.row_number().over(_stream())
    run = classified.where("modality is not null").withColumns({"n": n, "change": change, "total": F.count(F.lit(1)).over(whole)})
    run = run.withColumns({**{f"n_{m}": F.sum((F.col("modality") == m).cast("int")).over(_upto()) for m in W.LABELS}, "transitions": F.sum("change").over(_upto())})
    # a prefix is kept where its share of the stream reaches another of the points
    kept = run.where((F.col("n") == F.col("total")) | (F.floor(F.col("n") * points / F.col("total")) != F.floor((F.col("n") - 1) * points / F.col("total"))))
    return kept.select("stream_id", "n", *[f"n_{m}" for m in W.LABELS], "transitions", (F.col("n") / (F.col("transitions") + 1)).alias("segment_length"))


def runs(df: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """Run-length encoding: (key, start, value, length), longer runs cut at ``most``."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    grouped = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_run", F.sum(change).over(upto)).groupBy(key, "_run").agg(F.min("_n").alias("start"), F.first(value).alias(value), F.count(F.lit(1)).alias("total"))
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / most).cast("int") - 1))
    return grouped.withColumn("_k", piece).select(key, (F.col("start") + F.col("_k") * most).alias("start"), value, F.least(F.lit(most), F.col("total") - F.col("_k") * most).alias("length"))


def exploded_runs(df: DataFrame, value: str = "value", length: str = "length") -> DataFrame:
    """Run-length decoding."""
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col(length).cast("int")))).drop("_k")
