"""Streams of all modalities: put together in call order, and decoded whole with a fallback for each modality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweft.functions import codecs as C
from polyweft.functions import text as T
from polyweft.functions import words as W
from polyweft.operators import images as I
from polyweft.operators import streams as S


class Builder:
    """The words of a row's records in the order of the calls, as one array column. Each call gives a new builder; the first is the reset."""

    def __init__(self, parts: tuple[Column, ...] = ()):
        self._parts = parts

    def words(self, words: Column) -> Builder:
        """Words that are ready; null adds none."""
        return Builder((*self._parts, F.coalesce(words.cast("array<int>"), F.expr(C.NONE))))

    def text(self, text: Column) -> Builder:
        return self.words(T.encode(text))

    def tokens(self, tokens: Column) -> Builder:
        return self.words(F.transform(tokens, W.bpe_word))

    def drawing(self, points: Column, style: Column | None = None) -> Builder:
        return self.words(F.when(points.isNotNull(), C.diagram_words(points, style)))

    def taste(self, events: Column) -> Builder:
        return self.words(F.flatten(F.transform(events, C.taste_words)))

    def smell(self, category: Column, pleasantness: Column, intensity: Column, directions: Column) -> Builder:
        return self.words(F.when(directions.isNotNull(), C.smell_words(category, pleasantness, intensity, directions)))

    def touch(self, receptor: Column, region: Column, directions: Column, pressures: Column) -> Builder:
        return self.words(C.touch_words(receptor, region, directions, pressures))

    def image(self, words: Column, family: str | None = None) -> Builder:
        """Words of an image, as ``images.encoded`` or ``families.legacy_encoded`` make them and a join brings them; a word of no image raises."""
        fits = lambda w: (W.mode(w) == W.EXTENSION) & (W.is_image_payload(w) if family is None else W.is_image_family(w, {"enhanced": W.IMAGE_ENHANCED, "legacy": W.IMAGE_LEGACY}[family]))
        return self.words(F.when(F.forall(words, fits), words).when(words.isNotNull(), F.raise_error(F.lit("a word of no image")).cast("array<int>")))

    def music(self, strokes: Column, numerator: Column | None = None, denominator: Column | None = None, key: Column | None = None, tempo: Column | None = None) -> Builder:
        """Strokes (x, y, directions, anchor) under the words of what is known of metre, key and tempo; a null anchor tells none."""
        known = [F.lit(None).cast("int") if v is None else v for v in (numerator, denominator, key, tempo)]
        stroke = lambda s: C.sound_stroke(W.MUSIC, s["x"], s["y"], s["directions"], anchor=s["anchor"])
        return self.words(F.when(strokes.isNotNull(), F.concat(C.music_meta(*known), F.flatten(F.transform(strokes, stroke)))))

    def voice(self, strokes: Column, step_seconds: Column, levels: Column) -> Builder:
        """Strokes (x, y, directions, anchor) under the words of the language, the step and the pitch levels."""
        stroke = lambda s: C.sound_stroke(W.VOICE, s["x"], s["y"], s["directions"], anchor=s["anchor"])
        return self.words(F.when(strokes.isNotNull(), F.concat(C.voice_meta(step_seconds, levels), F.flatten(F.transform(strokes, stroke)))))

    def mental(self, strokes: Column, modulus: int = 8, rle: bool = True) -> Builder:
        """Strokes (form, symmetry, frequency, speed, x, y, directions, frame, delta) of one set of directions."""
        names = ("form", "symmetry", "frequency", "speed")
        stroke = lambda s: C.mental_words(*[s[n] for n in names], F.lit(modulus), s["x"], s["y"], s["directions"], s["frame"], s["delta"], rle)
        return self.words(F.flatten(F.transform(strokes, stroke)))

    def build(self) -> Column:
        """The whole stream; a word out of range raises."""
        whole = F.concat(*self._parts) if self._parts else F.expr(C.NONE)
        return F.when(F.forall(whole, lambda w: W.in_range(w)), whole).otherwise(F.raise_error(F.lit("a word is out of range")).cast("array<int>"))


#: The value of a block by its modality; what none of them reads is an empty array, and an image that does not paint is left out.
READERS = {
    "diagram": C.diagram_points,
    "music": lambda w: C.sound_strokes(W.MUSIC, w),
    "voice": lambda w: C.sound_strokes(W.VOICE, w),
    "mental": C.mental_strokes,
    "touch": C.touch_strokes,
    "smell": C.smell_strokes,
    "taste": C.taste_events,
    "image": lambda w: I.painted(w),
}


def decoded(stream: DataFrame) -> DataFrame:
    """One row a stream: text, tokens, word_count, valid, errors, n_<label> and <modality>_blocks, arrays of (block, value) in order.

    word_count is the raw number of words, invalid ones too. Text that cannot be decoded is decoded again without its
    malformed words, and the stream is not valid then. A stream of no words gives no row.

    Words are dealt by stream once; dispatch, the parts of a stream and the stream itself all stand on that one order. A
    part is a block of one modality, or the text up to the next token.
    """
    c = F.col
    told = F.coalesce("modality", F.lit(""))
    order, upto = S._stream(), S._upto()
    spoken = c("modality").isin("text", "bpe") & c("modality").isNotNull()
    change = F.coalesce((told != F.lag(told).over(order)).cast("int"), F.lit(1))
    rows = S.dispatched(stream.select("stream_id", "pos", "word")).withColumn("spoken", F.coalesce(spoken, F.lit(False)))
    rows = rows.withColumns({"island": F.sum(change).over(upto), "cut": F.sum((c("spoken") & (c("modality") == "bpe")).cast("int")).over(upto)})
    message = F.when(c("word").isNull(), F.concat(F.lit("index "), c("pos"), F.lit(": non-int word"))).when(~W.in_range("word"), F.concat(F.lit("index "), c("pos"), F.lit(": word out of range "), c("word")))
    in_order = lambda what: F.transform(F.array_sort(F.collect_list(what)), lambda p: p["word"])
    parts = rows.groupBy("stream_id", "spoken", F.when(c("spoken"), c("cut")).otherwise(c("island")).alias("part")).agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.max(F.when(~c("spoken"), told)).alias("modality"), in_order(F.when(told != "bpe", F.struct("pos", "word"))).alias("words"), F.max(F.when(c("modality") == "bpe", W.payload("word", 12))).alias("token"),
        F.count_if(told == "text").alias("n_text"), F.collect_list(F.when(message.isNotNull(), F.struct("pos", message.alias("m")))).alias("errors"),
    )
    # a part's text and, where that fails, its text without malformed words; one of the two is composed
    parts = parts.withColumn("strict", T.as_written(F.when(c("spoken"), c("words"))))
    parts = parts.withColumn("fails", c("spoken") & c("strict").isNull())
    parts = parts.withColumn("text", T.nfc(F.coalesce("strict", T.as_written(F.when(c("fails"), F.filter("words", T.decodable))))))
    value = lambda m, read: F.when(c("modality") == m, read(F.when(c("modality") == m, c("words")))).alias(m)
    read = parts.select("stream_id", "spoken", "part", "start", "n", "modality", "token", "n_text", "errors", "text", "fails", *[value(m, r) for m, r in READERS.items()])
    of = lambda m: c("modality") == m
    n_of = {"text": F.sum("n_text"), "bpe": F.count("token")}
    counts = [n_of.get(m, F.sum(F.when(of(m), c("n")).otherwise(0))).alias(f"n_{m}") for m in W.LABELS]
    gathered = [F.array_sort(F.collect_list(F.when(of(m), F.struct("start", c(m).alias("value"))))).alias(m) for m in READERS]
    by_stream = read.groupBy("stream_id").agg(
        F.sum("n").alias("word_count"), *counts, F.array_sort(F.flatten(F.collect_list("errors"))).alias("found"), F.array_sort(F.collect_list(F.when(c("spoken"), F.struct("part", "text", "fails", "token")))).alias("said"), *gathered,
    )
    failed = F.exists("said", lambda p: p["fails"])
    # a part that cannot be read even without its malformed words leaves the stream without text
    text = F.when(F.exists("said", lambda p: p["text"].isNull()), "").otherwise(F.array_join(F.transform("said", lambda p: p["text"]), ""))
    errors = F.concat(F.transform("found", lambda e: e["m"]), F.when(failed, F.array(F.lit("text: malformed words"))).otherwise(F.expr("cast(array() as array<string>)")))
    numbered = lambda m: F.transform(m, lambda b, i: F.struct(i.cast("long").alias("block"), b["value"].alias("value")))
    blocks = [(F.filter(numbered(m), lambda b: b["value"].isNotNull()) if m == "image" else numbered(m)).alias(f"{m}_blocks") for m in READERS]
    out = by_stream.withColumn("errors", errors)
    return out.select(
        "stream_id", "word_count", *[f"n_{m}" for m in W.LABELS], (F.size("errors") == 0).alias("valid"), "errors", text.alias("text"), F.filter(F.transform("said", lambda p: p["token"]), lambda t: t.isNotNull()).alias("tokens"), *blocks,
    )
