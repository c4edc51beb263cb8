"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events ordered by sequence number:

=============  ==============================================================
kind           effect
=============  ==============================================================
`message`      starts message `turn` of `role` with `text`
`delta`        appends `text` to message `turn` (a streamed piece)
`edit`         replaces what message `turn` says by `text`
`regenerate`   empties message `turn`; what follows builds it anew
=============  ==============================================================

The events of each message fold into its final text, final messages are
rendered by a template, and the rendered pieces stand in order of turns. A
piece is `<|im_start|>role\\ntext<|im_end|>\\n`; in roles and texts a backslash
becomes two and the `<|` of a control string gets a backslash between (a line
break in a role becomes a backslash and an n), so what is rendered can always be
read back. The loss mask covers the escaped text of
assistants and nothing else.

Folding is by message, so a long conversation is many groups; only its digest
and its final string need its pieces in one place.

Defined cases: a null text is empty, a null role or kind is `user` or
`message`; events of equal sequence number stand in the order of their kind and
text; deltas without a message make one of role `user`; null conversation ids
are one conversation, null turns come first; several messages of one turn are told
apart by the column `copy` (`events` numbers repeated rows by it) and stand in
its order; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """`text` without control strings; see `unescaped`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """The inverse of `escaped`."""
    # Pairs of backslashes are set aside first, as a NUL and a 2; a NUL of the
    # text itself becomes a NUL and a 1 meanwhile.
    kept = F.replace(text, F.lit("\x00"), F.lit("\x00\x01"))
    kept = F.replace(kept, F.lit("\\\\"), F.lit("\x00\x02"))
    kept = F.replace(F.replace(kept, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    kept = F.replace(kept, F.lit("\x00\x02"), F.lit("\\"))
    return F.replace(kept, F.lit("\x00\x01"), F.lit("\x00"))


def events(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The log of a table of finished turns: a message each."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("seq"), F.col(turn_col).cast("long").alias("turn"),
        F.lit("message").alias("kind"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))


def messages(log: DataFrame) -> DataFrame:
    """`conv_id, turn, copy, role, text`: the final messages of a log with the
    columns `conv_id, seq, turn, copy, kind, role, text`.

    Within a message the last `message`, `edit` or `regenerate` counts; deltas
    after it are appended in order.
    """
    known = log.select(
        "conv_id", "turn", "copy", F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rank = F.when(F.col("kind") == "delta", 1).otherwise(0)
    folded = known.groupBy("conv_id", "turn", "copy").agg(
        F.sort_array(F.collect_list(F.struct("seq", rank.alias("rank"), "kind", "role", "text"))).alias("log")
    )
    base = F.aggregate(
        F.sequence(F.lit(0), F.size("log") - 1), F.lit(-1), lambda last, i: F.when(F.get(F.col("log"), i)["kind"] != "delta", i).otherwise(last)
    )
    folded = folded.withColumn("base", base)
    at = F.get(F.col("log"), F.col("base"))
    text = F.concat(
        F.when((F.col("base") >= 0) & (at["kind"] != "regenerate"), at["text"]).otherwise(F.lit("")),
        F.array_join(F.transform(F.slice("log", F.col("base") + 2, F.size("log")), lambda e: e["text"]), ""),
    )
    role = F.coalesce(F.get(F.filter("log", lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit("user"))
    return folded.select("conv_id", "turn", "copy", role.alias("role"), text.alias("text"))


def rendered(final: DataFrame) -> DataFrame:
    """`conv_id, turn, copy, piece, mask`: each message's piece of the output,
    and the [start, end) of the loss in it, in code points."""
    role, text = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    piece = F.concat(head, text, F.lit(END + "\n"))
    start = F.char_length(head)
    mask = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.char_length(text)).alias("end")))
    return final.select("conv_id", "turn", "copy", piece.alias("piece"), mask.alias("mask"))


def format_chats(log: DataFrame) -> DataFrame:
    """`conv_id, formatted, loss (array of [start, end) in code points)` of every
    conversation of a log."""
    # Where each piece begins is a running sum over a conversation's rows, and
    # these then stand in one place for the string.
    before = Window.partitionBy("conv_id").orderBy("turn", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered(messages(log)).withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)).cast("int"))
    mask = F.when(F.col("mask").isNotNull(), F.struct((F.col("at") + F.col("mask.start")).alias("start"), (F.col("at") + F.col("mask.end")).alias("end")))
    whole = placed.select("conv_id", "turn", "copy", "piece", mask.alias("mask")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "copy", "piece", "mask"))).alias("pieces")
    )
    loss = F.filter(F.transform("pieces", lambda p: p["mask"]), lambda m: m.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The array of (role, text) that an output was rendered from."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(p, "\n", 1)).alias("role"),
            # The text ends before the end mark and its newline; it begins after
            # the role's line, and an escaped role has no newline of its own.
            unescaped(
                F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p) - F.char_length(F.substring_index(p, "\n", 1)) - 1 - len(END) - 1)
            ).alias("text"),
        ),
    )


_CHUNK = 1024


def _cut(chunks: Column, span: Column) -> Column:
    """The code points [start, end) of a string that was cut into chunks. Cutting
    it out of the string itself would walk there from its beginning each time."""
    some = F.transform(F.sequence(F.floor(span["start"] / _CHUNK).cast("int"), F.floor(span["end"] / _CHUNK).cast("int")), lambda i: F.get(chunks, i))
    return F.substring(F.array_join(some, ""), F.pmod(span["start"], F.lit(_CHUNK)) + 1, span["end"] - span["start"])


def digests(chats: DataFrame) -> DataFrame:
    """What the outputs say, read back from them alone."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chunks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    # Two uses of `chunks`, so that it is computed once and not for each span.
    lost = F.when(F.size("chunks") > 0, F.array_join(F.transform("loss", lambda m: unescaped(_cut(F.col("chunks"), m))), "")).otherwise(F.lit(""))
    return (
        chats.withColumn("turns", turns).withColumn("chunks", chunks).withColumn("lost", lost)
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
            F.char_length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
