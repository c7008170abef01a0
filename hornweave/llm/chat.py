r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output::

    conversation = turn*
    turn         = "<|im_start|>" role "\n" content "<|im_end|>\n"

A role is percent-encoded (``%``, ``<`` and line feed). A content is the text as it is
whenever a parser recovers exactly the turn from the rendered block; otherwise every
``<``, backslashes, ``|`` in it gets one more backslash, and the block is parsed and
compared again. The parser takes one backslash off each such run, so the two agree
after one escape at the latest; a row for which they don't raises an error. Blocks end
in a line feed and start with a control string, so a conversation parses into exactly
its turns.

Defined cases: null role or text is empty; turns sort by number (null first), then role,
then text; repeated rows are repeated turns; a null conversation id is a conversation;
an empty table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(content: Column) -> Column:
    return F.regexp_replace(content, r"<\\(\\*)\|", r"<$1|")


def encode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def decode_role(header: Column) -> Column:
    return F.replace(F.replace(F.replace(header, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), encode_role(role), F.lit("\n"), content, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>; a piece that the grammar doesn't derive gives a null element."""

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, END, 1)
        header = F.substring_index(body, "\n", 1)
        whole = (F.substr(piece, F.length(body) + 1) == F.lit(END + "\n")) & (F.length(header) < F.length(body))
        return F.when(whole, F.struct(decode_role(header).alias("role"), unescape(F.substr(body, F.length(header) + 2)).alias("text")))

    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_turns(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row for each turn: its rendered block, where it lies in the conversation, and its span under the loss mask.

    Blocks are rendered and verified row by row; only running offsets need the rows of a
    conversation in order (a streaming window), so its length isn't bounded by memory.
    """
    t = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    plain, escaped = render(F.col("role"), F.col("text")), render(F.col("role"), escape(F.col("text")))
    source = F.array(F.struct("role", "text"))
    t = t.withColumn("escaped", ~F.coalesce(parse(plain) == source, F.lit(False)))
    t = t.withColumn("block", F.when(~F.col("escaped"), plain).when(parse(escaped) == source, escaped).otherwise(F.raise_error(F.lit("a turn can't be recovered"))))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    header = F.length(F.lit(START)) + F.length(encode_role(F.col("role"))) + 1
    return (
        t.withColumn("ordinal", F.row_number().over(order) - 1)
        .withColumn("start", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0).cast("long")))
        .withColumn("content_start", F.col("start") + header)
        .withColumn("content_length", F.length("block") - header - len(END) - 1)
        .withColumn("in_loss", F.col("role") == ASSISTANT)
    )


def assemble(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its formatted text and its loss mask by turn."""
    in_order = F.array_sort(F.collect_list(F.struct("ordinal", "block", "in_loss")))
    return turns.groupBy("conv_id").agg(in_order.alias("t")).select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["block"]), "").alias("formatted"), F.transform("t", lambda x: x["in_loss"]).alias("loss_mask")
    )


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, from parsing the formatted text again.

    The turns read back must be as many as the mask has, with assistants where it says so; a row for which they
    aren't raises an error, so the mask can't come to lie on other turns unseen.
    """
    read = conversations.withColumn("turns", parse(F.col("formatted")))
    agree = F.transform("turns", lambda t: F.coalesce(t["role"] == ASSISTANT, F.lit(False))) == F.col("loss_mask")
    read = read.withColumn("loss_mask", F.when(agree, F.col("loss_mask")).otherwise(F.raise_error(F.lit("the loss mask doesn't fit the turns read back")).cast("array<boolean>")))
    read = read.withColumn("all", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    masked = F.filter(F.arrays_zip("turns", "loss_mask"), lambda z: z["loss_mask"])
    read = read.withColumn("loss", F.array_join(F.transform(masked, lambda z: z["turns"]["text"]), ""))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
