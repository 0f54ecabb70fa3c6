"""Chat formatting by event sourcing, in DataFrame functions only.

A log of events becomes messages, and a conversation's messages become one training text with a loss mask.

Events have conv_id, turn, seq, kind, role and text. Within a turn they fold in the order of seq: `message`
starts the message anew, `delta` appends to it, `edit` replaces its text, and `regenerate` drops all that
came before it in its turn. A turn that ends without an event that gives text is left out. The fold is an
aggregate over the turn's events: what counts is after the last resetting event.

The rendered text has a block a turn, `### role:` line, text and `</turn>` line. In roles and texts `\\`, `<`
and `#` are written as `\\b`, `\\l` and `\\h` (in roles also `:` as `\\c`), so that no control string can come from
a text, and reading back is exact.

Defined results: null roles and texts are empty; a null turn or conv_id is a value of its own, first in
order; rows of a plain table that share a turn are turns one after another, in the order of role and text;
an empty table gives no rows; other columns are not read. A conversation's turns meet in one row, as its
text is one value; the events of a turn are folded before, by (conversation, turn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ":\n", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")) + ((":", "\\c"),) * role:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in ((":", "\\c"), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def as_events(rows: DataFrame) -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text): each row is a `message`, in a turn of its own.

    Turns are numbered anew in the order of turn, role and text, so that rows which share a turn follow each other.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    return rows.select("conv_id", place.cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: a row for each turn that has a message at the end of its events."""
    text = F.coalesce("text", F.lit(""))
    log = F.array_sort(F.collect_list(F.struct("seq", F.lower("kind").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))))
    resets = F.transform("log", lambda e, k: F.when(e["kind"].isin("message", "edit", "regenerate"), k))
    kept = F.slice("log", F.coalesce(F.array_max(resets), F.lit(0)) + 1, F.greatest(F.size("log"), F.lit(1)))
    said = F.filter("kept", lambda e: e["kind"] != "regenerate")
    roles = F.filter("log", lambda e: e["role"] != "")
    return (
        events.groupBy("conv_id", "turn").agg(log.alias("log"))
        .withColumn("kept", kept).withColumn("said", said).filter(F.size("said") > 0)
        .select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"), F.array_join(F.transform("said", lambda e: e["text"]), "").alias("text"))
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss: the mask as stretches (block, start, length) of characters, where blocks end in `</turn>` lines."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), escaped(role, role=True), F.lit(COLON))
    body = escaped(text)
    turn = F.struct(
        "turn", role.alias("role"), text.alias("text"), F.concat(head, body).alias("block"),
        F.char_length(head).alias("start"), F.char_length(body).alias("length"), (role == loss_role).alias("learn"),
    )
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = F.transform("turns", lambda t: F.concat(t["block"], F.lit(END)))
    marked = F.transform("turns", lambda t, k: F.struct(k.alias("block"), t["start"].alias("start"), t["length"].alias("length"), t["learn"].alias("learn")))
    loss = F.transform(F.filter(marked, lambda t: t["learn"]), lambda t: F.struct(t["block"], t["start"], t["length"]))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(blocks, "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text as the rendered text and its mask give them."""
    blocks = F.split("formatted", F.lit(END.replace("<", "[<]")))
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))  # nothing follows the last end
    turns = F.transform(
        "blocks",
        lambda b: F.struct(
            unescaped(F.substring_index(b, COLON, 1).substr(F.lit(len(HEAD) + 1), F.char_length(b))).alias("role"),
            unescaped(b.substr(F.char_length(F.substring_index(b, COLON, 1)) + len(COLON) + 1, F.char_length(b))).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda m: F.get("blocks", m["block"]).substr(m["start"] + 1, m["length"]))
    return formatted.withColumn("blocks", blocks).withColumns({"turns": turns, "loss_text": unescaped(F.array_join(masked, ""))}).drop("blocks")
