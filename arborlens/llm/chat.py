"""Conversations as marked-up text, checked by reading it back.

A turn is written as ``### role: text``, a line feed, ``</turn>`` and a line feed; a conversation is its turns, one after the
other. The parser is deterministic: ``###`` with a blank, and ``</turn>``, are marks wherever no backslash stands before them; the
role ends at the first colon, and one backslash before a mark is taken away. Marks cannot overlap each other or themselves. Each turn is written as it is, read back and
compared with its source. Where the two differ, conflicting content is escaped (first in the text, then in the role too) until
they are identical. A turn's text begins and ends with marks whatever it holds, so the reading of a conversation is that of
its turns; the whole is read back and compared once more, and a difference is an error.

Escapes: in a text, a backslash before each mark. In a role, the signs of ``_ROLE_SIGNS`` become a backslash and
a digit. The loss mask is a list of byte spans of the UTF-8 text: the texts of the assistant's turns, as written.

Only column functions are used. Turns are written, read and escaped where they lie; one shuffle by conversation puts them in
order. A conversation becomes one row, as its digests are of the whole: one conversation is limited by the 2 GB of a string.

Defined results: turns are in the order of ``turn`` (null first), then role, then text; repeated rows are turns of their own;
a null role or text is empty; rows without an id are one conversation, without an id; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKS = ("### ", "</turn>")
SPEAKER = "assistant"  # the role whose texts are learnt
_ROLE_SIGNS = ("\\", ":", "#", "<")  # written as a backslash and their place here; the backslash goes first


def escape_text(text: Column) -> Column:
    return reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit("\\" + mark)), MARKS, text)


def unescape_text(text: Column) -> Column:
    return reduce(lambda c, mark: F.replace(c, F.lit("\\" + mark), F.lit(mark)), MARKS, text)


def escape_role(role: Column) -> Column:
    return reduce(lambda c, i: F.replace(c, F.lit(_ROLE_SIGNS[i]), F.lit(f"\\{i}")), range(len(_ROLE_SIGNS)), role)


def unescape_role(role: Column) -> Column:
    return reduce(lambda c, i: F.replace(c, F.lit(f"\\{i}"), F.lit(_ROLE_SIGNS[i])), reversed(range(len(_ROLE_SIGNS))), role)


def write(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), role, F.lit(": "), text, F.lit("\n</turn>\n"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def parse(formatted: Column) -> Column:
    """The turns of a text, as an array of ``(role, text)``; null where the text is not one of the grammar."""
    # The mark comes first in the patterns: the look-behind is only tried where there is one.
    starts, end = r"### (?<!\\### )", r"</turn>(?<!\\</turn>)"

    def turn(ends: Column) -> Column:
        inner, colon = ends[0], F.locate(":", ends[0])
        sound = (F.size(ends) == 2) & (ends[1] == "\n") & (colon > 0) & (inner.substr(colon + 1, F.lit(1)) == " ") & (
            F.endswith(inner, F.lit("\n")) & (F.length(inner) >= colon + 2))
        return F.when(sound, F.struct(
            unescape_role(inner.substr(F.lit(1), colon - 1)).alias("role"),
            unescape_text(inner.substr(colon + 2, F.length(inner) - colon - 2)).alias("text")))

    def turns(parts: Column) -> Column:
        later = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        found = F.transform(F.transform(later, lambda part: F.split(part, end)), turn)
        return F.when(parts[0] == "", _with(found, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), t)))

    return _with(F.split(formatted, starts), turns)


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, written, inset, shown``: every turn as written; its text begins after ``inset`` bytes and has
    ``shown`` bytes."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    source = F.array(F.struct(role, text))
    tries = [(role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))]
    identical = [F.when(parse(write(*t)).eqNullSafe(source), F.struct(t[0].alias("role"), t[1].alias("text"))) for t in tries]
    as_written = F.coalesce(*identical, F.raise_error(F.lit("a turn cannot be written so that it reads back")).cast("struct<role:string,text:string>"))
    # A generator keeps the choice from being worked out again for each of its uses.
    chosen = turns.select("*", F.inline(F.array(as_written)).alias("_role", "_text"))
    return chosen.select(
        "conv_id", "turn", "role", "text", write(F.col("_role"), F.col("_text")).alias("written"),
        (F.octet_length("_role") + 6).cast("bigint").alias("inset"), F.octet_length("_text").cast("bigint").alias("shown"))


def chat(conversations: DataFrame, speaker: str = SPEAKER) -> DataFrame:
    """``conv_id, formatted, loss``: a row per conversation; ``loss`` are spans ``(start, length)`` in bytes."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.octet_length("written")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = render(conversations).withColumn("place", F.row_number().over(order)).withColumn("before", before)
    span = F.when(F.col("role") == speaker, F.struct((F.col("before") + F.col("inset")).alias("start"), F.col("shown").alias("length")))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "written", "role", "text", span.alias("span")))).alias("t"))
    whole = turns.select("conv_id", "t", F.array_join("t.written", "").alias("formatted"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(parse(F.col("formatted")).eqNullSafe(source), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return whole.select("conv_id", checked.alias("formatted"), F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"))


def learnt(formatted: Column, loss: Column) -> Column:
    """The texts under the mask, unescaped, as an array."""
    raw = formatted.cast("binary")
    return F.transform(loss, lambda s: unescape_text(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))


def fields(written: DataFrame) -> DataFrame:
    """What a reader of the output finds: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    read = written.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
                          F.inline(F.array(F.struct(parse(F.col("formatted")).alias("turns"),
                                                    F.array_join(learnt(F.col("formatted"), F.col("loss")), "").alias("masked")))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
