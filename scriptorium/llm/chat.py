"""Chat formatting with built-in functions only.

A conversation's turns are collected as structs, sorted, merged where adjacent
turns have the same role, and joined to one string:

    <|role:user|>\\ntext<|next|>\\ntext<|end|>\\n<|role:assistant|>\\ntext<|end|>\\n

``<|next|>`` keeps apart the texts of a merged block, so reading back gives the
rows that went in.  Texts cannot form a marker: the escape sign is written as
sign + e, then ``<|`` and ``|>`` get the sign in their middle; ``|``, ``<`` and ``>`` in a role
are written as sign + p, l and g.  Every marker ends in one line break, so a text may begin with others,
and a role cannot be taken for another marker.  ``mask`` lists the runs of characters of the string in order,
each with whether the loss counts them: the assistants' texts, nothing else.

A conversation is one row of the result, so its turns meet in one task, as any
formatter needs; work is in proportion to its length.  Defined results: a null
text or role is empty; a null conv_id is a conversation of its own; turns with
equal numbers are ordered by role, then text; repeated rows are repeated turns; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "␛"
ROLE, OPEN, NEXT, END = "<|role:", "|>\n", "<|next|>\n", "<|end|>\n"
LOSS_ROLE = "assistant"
#: What a role may not hold as it is, and the letter behind the escape sign that stands for it.
ROLE_SIGNS = (("|", "p"), ("<", "l"), (">", "g"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(SIGN), F.lit(SIGN + "e"))
    out = F.replace(out, F.lit("<|"), F.lit(f"<{SIGN}|"))
    return F.replace(out, F.lit("|>"), F.lit(f"|{SIGN}>"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(f"|{SIGN}>"), F.lit("|>"))
    out = F.replace(out, F.lit(f"<{SIGN}|"), F.lit("<|"))
    return F.replace(out, F.lit(SIGN + "e"), F.lit(SIGN))


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit(SIGN), F.lit(SIGN + "e"))
    for sign, letter in ROLE_SIGNS:
        out = F.replace(out, F.lit(sign), F.lit(SIGN + letter))
    return out


def unescape_role(role: Column) -> Column:
    out = role
    for sign, letter in ROLE_SIGNS:
        out = F.replace(out, F.lit(SIGN + letter), F.lit(sign))
    return F.replace(out, F.lit(SIGN + "e"), F.lit(SIGN))


def _blocks(turns: str, starts: str) -> Column:
    """Adjacent turns of one role as array<struct<role, texts>>; ``starts``: places of their first turns.

    Both are columns, so that the places are found once and not again for each block.
    """

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at(F.col(starts), k + 2), F.size(turns) + 1)
        run = F.slice(turns, start, end - start)
        return F.struct(F.element_at(F.col(turns), start)["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("texts"))

    return F.transform(starts, block)


def _starts(turns: str) -> Column:
    """The places, from 1, of turns whose role isn't the one before."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(turns, lambda t: t["role"]))
    fresh = F.zip_with(F.transform(turns, lambda t, i: F.struct((i + 1).alias("at"), t["role"].alias("role"))), F.slice(before, 1, F.size(turns)), lambda t, b: F.struct(t["at"].alias("at"), (~t["role"].eqNullSafe(b)).alias("new")))
    return F.transform(F.filter(fresh, lambda x: x["new"]), lambda x: x["at"])


def _runs(block: Column) -> Column:
    """The mask of one block: marker, text, separator, text, ..., marker."""
    loss = block["role"] == LOSS_ROLE
    run = lambda n, on: F.struct(n.cast("long").alias("chars"), on.alias("loss"))
    no = F.lit(False)
    head = F.array(run(F.length(escape_role(block["role"])) + len(ROLE + OPEN), no))
    texts = F.flatten(F.transform(block["texts"], lambda t, k: F.array(run(F.when(k == 0, 0).otherwise(len(NEXT)), no), run(F.length(escape(t)), loss))))
    return F.filter(F.concat(head, texts, F.array(run(F.lit(len(END)), no))), lambda r: r["chars"] > 0)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, mask from rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    turns = conversations.select("conv_id", F.struct("turn", role, text).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    placed = turns.select("conv_id", "turns", _starts("turns").alias("starts"))
    blocks = placed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _blocks("turns", "starts").alias("blocks"))
    write = lambda b: F.concat(F.lit(ROLE), escape_role(b["role"]), F.lit(OPEN), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(END))
    return blocks.select("conv_id", "n_turns", F.array_join(F.transform("blocks", write), "").alias("formatted"), F.flatten(F.transform("blocks", _runs)).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted string."""
    ends = F.split(formatted, r"<\|end\|>\n", -1)

    def of(block: Column) -> Column:
        stop = F.locate(OPEN, block, len(ROLE) + 1)
        role = unescape_role(F.substring(block, F.lit(len(ROLE) + 1), stop - len(ROLE) - 1))
        texts = F.split(F.substring(block, stop + len(OPEN), F.length(block)), r"<\|next\|>\n", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(ends, lambda b: b != ""), of))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The pieces of the string under the mask, still escaped, as an array.

    The string falls into markers, each with its line break, and texts; the mask has a run for each.
    """
    pieces = F.filter(F.split(formatted, r"(?<=\|>\n)|(?=<\|)"), lambda p: p != "")
    under = F.filter(F.zip_with(pieces, mask, lambda p, r: F.struct(p.alias("p"), r.alias("r"))), lambda x: x["r"]["loss"])
    return F.transform(under, lambda x: F.when(F.length(x["p"]) == x["r"]["chars"], x["p"]).otherwise(F.raise_error(F.lit("mask and string differ"))))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading a formatted table back gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.transform(masked_texts(F.col("formatted"), F.col("mask")), unescape).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
