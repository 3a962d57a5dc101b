"""Chat formatting as relational expressions.

Turn structs of a conversation are collected, sorted by turn, merged where neighbours have the same role, and
concatenated. A block is ``### Role:``, a newline, its texts with ``MORE`` between those of merged turns, and
``</turn>`` and a newline. Texts and roles are escaped: the escape sign and the control strings give way to
the sign and a letter, so that control strings stand in the output where the template put them and nowhere
else, and replacing back restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escape sign first: it is put back last.
SIGN = "\\"
HEAD, NAMED, CLOSE, MORE, NO_ROLE = "### ", ":\n", "</turn>\n", "\n<more/>\n", "<none/>"
#: Control strings and the letters that stand for them after the sign.
LETTERS = (("### ", "h"), ("</turn>", "e"), ("<more/>", "m"), ("<none/>", "n"))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(SIGN), F.lit(SIGN + "b"))
    for control, letter in LETTERS:
        out = F.replace(out, F.lit(control), F.lit(SIGN + letter))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for control, letter in LETTERS:
        out = F.replace(out, F.lit(SIGN + letter), F.lit(control))
    return F.replace(out, F.lit(SIGN + "b"), F.lit(SIGN))


def _role(role: Column) -> Column:
    """A role as it stands in a head: a colon gives way as well, so that the head's own colon is the first."""
    return F.coalesce(F.replace(escaped(role), F.lit(":"), F.lit(SIGN + "c")), F.lit(NO_ROLE))


def _role_back(text: Column) -> Column:
    return F.when(text != NO_ROLE, unescaped(F.replace(text, F.lit(SIGN + "c"), F.lit(":"))))


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, text (the formatted conversation) and loss: spans (start, length) in code points, from 0, of the texts to learn.

    Null texts are empty; a null role is a role of its own. Turns stand by number, nulls first; turns that share
    a number by role and text, so that reruns agree; repeated rows are turns of their own. A null conversation id
    is a conversation. An empty table gives no rows. A conversation is one output value and is put together in
    one task, its turns having been escaped before the shuffle.
    """
    one = F.struct(F.col(turn_col).alias("turn"), _role(F.col(role_col)).alias("role"), escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    sorted_ = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    # blocks: index of each turn that opens one, that is, whose role differs from the one before
    opens = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"] != F.element_at("turns", i)["role"]))
    ranged = sorted_.withColumn("opens", opens)
    ends = F.concat(F.transform(F.slice("opens", 2, F.greatest(F.size("opens") - 1, F.lit(0))), lambda i: i - 1), F.array(F.size("turns")))
    blocks = F.transform(F.arrays_zip(F.col("opens").alias("first"), ends.alias("last")), lambda b: F.struct(
        F.element_at("turns", b["first"])["role"].alias("role"),
        F.transform(F.slice("turns", b["first"], b["last"] - b["first"] + 1), lambda t: t["text"]).alias("texts"),
    ))
    merged = ranged.select("conv_id", blocks.alias("blocks"))
    written_out = merged.withColumn("parts", F.transform("blocks", lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(NAMED), F.array_join(b["texts"], MORE), F.lit(CLOSE))))
    # a running sum gives the start of each text; only those of the loss role are kept
    lengths = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        (b["role"] == _role(F.lit(loss_role))).alias("loss"),
        F.when(i == 0, F.length(b["role"]) + len(HEAD) + len(NAMED)).otherwise(len(MORE)).alias("before"),
        F.length(t).alias("length"),
        F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("after"),
    ))))
    nothing = F.expr("struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as spans)")
    span = lambda at, x: F.array(F.struct((at + x["before"]).alias("start"), x["length"].alias("length")))
    spans = F.aggregate(lengths, nothing, lambda s, x: F.struct(
        (s["at"] + x["before"] + x["length"] + x["after"]).alias("at"),
        F.when(x["loss"], F.concat(s["spans"], span(s["at"], x))).otherwise(s["spans"]).alias("spans"),
    ), lambda s: s["spans"])
    return written_out.select("conv_id", F.array_join("parts", "").alias("text"), spans.alias("loss"))


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted conversation, merged turns apart again."""
    blocks = F.slice(F.split(text, CLOSE), 1, F.greatest(F.size(F.split(text, CLOSE)) - 1, F.lit(0)))
    head = lambda b: F.substring_index(b, NAMED, 1)
    rest = lambda b: F.substr(b, F.length(head(b)) + len(NAMED) + 1)
    role = lambda b: _role_back(F.substr(head(b), F.lit(len(HEAD) + 1)))
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(rest(b), MORE), lambda t: F.struct(role(b).alias("role"), unescaped(t).alias("text")))))


def loss_texts(text: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"])))
