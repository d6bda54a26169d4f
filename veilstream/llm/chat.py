"""Chat formatting with a grammar round trip, in SQL functions only.

Grammar:  conversation = turn*;  turn = "<|im_start|>" role LF text "<|im_end|>" LF.
A control string is an opener, `<` or `[`, followed by one of the endings in CONTROLS. Written text holds no control
string as such; inside a text one is escaped by a backslash behind its opener, and one that is already written with
backslashes gets one more, so that taking one away everywhere restores the text. A turn is first rendered as it is and
parsed again; the parser takes no text with a control string in it. Only where the turn read back differs from the
source is its content escaped, and the result is parsed
and compared in turn; a turn that still differed would end the job (one pass of escapes always suffices, see above). The parser always takes escapes away, so it needs no sign of what was done.

A role of other than small letters is written as `=` and its bytes in hexadecimal.
Edge cases: null text is empty; null role is the empty role; turns of equal number go by role and text; rows without a
conv_id form the conversation of id null; repeated rows are turns of their own; an empty table gives no rows. A
conversation's rows are joined in blocks of turns before its blocks meet, so no task sorts all rows of a long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the opener in control strings of this and other common templates.
CONTROLS = ("|im_start|>", "|im_end|>", "|endoftext|>", "|system|>", "|user|>", "|assistant|>", "s>", "/s>", "INST]", "/INST]", "SYS>>", "/SYS>>")
_ENDINGS = "|".join(x.replace("|", r"\|").replace("]", r"\]") for x in CONTROLS)
_CONFLICT = rf"([<\[])(\\*)({_ENDINGS})"
_ESCAPED = rf"([<\[])\\(\\*)({_ENDINGS})"
_RAW = rf"[<\[](?:{_ENDINGS})"
#: Turns that are joined together before the whole conversation.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONFLICT, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def write_role(role: Column) -> Column:
    return F.when(role.rlike(r"\A[a-z]*\z"), role).otherwise(F.concat(F.lit("="), F.hex(role.cast("binary"))))


def read_role(role: Column) -> Column:
    return F.when(role.startswith("="), F.unhex(F.substr(role, F.lit(2))).cast("string")).otherwise(role)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), write_role(role), F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>. What is not a turn has a null role, a control string in a text makes it null."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"\A<\|im_start\|>([^\n]*)\n"

    def turn(p: Column) -> Column:
        role = F.when(p.rlike(head), read_role(F.regexp_extract(p, head, 1)))
        text = F.regexp_replace(p, head, "")
        return F.struct(role.alias("role"), F.when(~text.rlike(_RAW), unescape(text)).alias("text"))

    return F.transform(pieces, turn)


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered, faithful) for each row; rendered reads back as role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    source = F.array(F.struct("role", "text"))
    out = out.withColumn("rendered", render(F.col("role"), F.col("text")))
    out = out.withColumn("rendered", F.when(parse(F.col("rendered")) == source, F.col("rendered")).otherwise(render(F.col("role"), escape(F.col("text")))))
    faithful = parse(F.col("rendered")) == source
    broken = F.raise_error(F.concat(F.lit("a turn does not read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean")
    return out.withColumn("faithful", F.when(F.coalesce(faithful, F.lit(False)), True).otherwise(broken))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, faithful): one string per conversation, turns in order."""
    turns = format_turns(rows).withColumn("block", F.floor(F.col("turn") / BLOCK))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["rendered"]), "")
    blocks = turns.groupBy("conv_id", "block").agg(ordered(F.struct("turn", "role", "text", "rendered")).alias("rendered"), F.bool_and("faithful").alias("faithful"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(-(2**62))).alias("block"), "rendered"))), lambda x: x["rendered"]), "")
    return blocks.groupBy("conv_id").agg(whole.alias("formatted"), F.bool_and("faithful").alias("faithful"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted strings alone.

    The loss mask covers the texts of assistant turns.
    """
    out = conversations.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"))
    all_ = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
