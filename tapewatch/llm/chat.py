"""Chat formatting with array expressions only.

A conversation becomes one training text. Turns next to each other with the
same role share one message. The parts of the text are kept as segments with a
loss flag, so that a trainer can mask everything but the assistant's words.

    ### user:
    first text<sep/>second text</turn>
    ### assistant:
    answer</turn>

Inside texts and roles ``\\``, ``<`` and ``#`` are written ``\\b``, ``\\l`` and
``\\h`` (in roles also ``:`` as ``\\c``), so no control string can come from a
text and the format can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
NEXT = "<sep/>"
OPEN = "### "
AFTER_ROLE = ":\n"
ASSISTANT = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``segments`` (array of text and
    loss flag) and ``formatted`` (the segments joined).

    ``turns`` has conv_id, turn, role, text; further columns are ignored. A
    null text or role counts as empty, null turns come first, turns with the
    same number are ordered by role and text, repeated rows are all kept. Rows
    with a null conv_id form one conversation. Without rows there is no
    conversation. A conversation is one training example, so its turns meet in
    one row; nothing else of it is collected."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        head = F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE))
        before = F.when(same, F.lit(NEXT)).when(i == 0, head).otherwise(F.concat(F.lit(END), head))
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("loss")),
        )

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform("turns", parts)), last)
    return (
        grouped.select("conv_id", segments.alias("segments"))
        .withColumn("formatted", F.array_join(F.col("segments.text"), ""))
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role and text."""
    ended = F.split(formatted, END)
    messages = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turns(message: Column) -> Column:
        role = F.substring_index(message, AFTER_ROLE, 1)
        body = F.substr(message, F.length(role) + len(AFTER_ROLE) + 1)
        name = unescape(F.substr(role, F.lit(len(OPEN) + 1)), ROLE_ESCAPES)
        return F.transform(
            F.split(body, NEXT), lambda x: F.struct(name.alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(messages, turns))


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask say, as counts and digests."""
    turns = F.col("_turns")
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")
    return (
        formatted.withColumn("_turns", read_back(F.col("formatted")))
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
