"""Chat formatting (native).

A log of events is partitioned by conversation, sorted by sequence and folded
into final messages; these are rendered by a template that marks turns, with a
loss mask over the assistant's texts.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; events with equal sequence numbers (ties) are ordered by kind
and text; equal rows are turns of their own, and equal events are applied each; texts
are kept whole, whatever their length; a log without events gives no conversation, an
empty table no rows; other columns are not read, whatever their names. Control strings in texts
are escaped by one more backslash between "<" and "|", which unescape() undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What an event does to its message: set the text, append to it, replace it, start it again, remove it.
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """No "<|" is left: "<", any backslashes, "|" get one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    for a, b in (("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, event, role, text) to final messages (conv_id, turn, role, text).

    A message's text is that of its last event other than a delta, followed by
    the deltas after it; "delete" as that event removes the message. Its role
    is the last one given.
    """
    e = events.select("conv_id", "turn", F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    logs = e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("log"))
    back = F.array_position(F.reverse(F.transform("log", lambda x: x["event"] != "delta")), True).cast("int")
    first = F.when(back > 0, F.size("log") - back + 1).otherwise(1)
    live = logs.withColumn("first", first)
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x.isNotNull())
    return live.where(F.element_at("log", F.col("first"))["event"] != "delete").select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("log", F.col("first"), F.size("log")), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages to one row per conversation: conv_id, formatted, loss_mask.

    loss_mask lists the spans (start, end: code points of formatted) to be
    trained on, with the number of their turn (from 0) and where it starts.
    Turns are rendered and measured row by row; only the finished pieces of one
    conversation meet, since they make one value.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "turn", head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*trained_roles).alias("loss"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    length = F.length("piece").cast("long")
    m = m.withColumn("begin", F.sum(length).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - length)
    m = m.withColumn("number", F.row_number().over(by_turn) - 1)
    start = F.col("begin") + F.length("head")
    row = F.struct("number", "piece", "loss", "begin", start.alias("start"), (start + F.length("body")).alias("end"))
    c = m.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    span = lambda x: F.struct(x["number"].alias("turn"), x["begin"].alias("turn_start"), x["start"].alias("start"), x["end"].alias("end"))
    return c.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), span).alias("loss_mask"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says: conv_id, formatted, turns (role, text), loss_texts."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    f = formatted.select("conv_id", "formatted", "loss_mask", F.slice(pieces, 2, F.size(pieces)).alias("pieces"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        at = F.length(role) + 2
        return F.struct(_role_in(role).alias("role"), unescape(F.substr(p, at, F.length(p) - at + 1 - len(END + "\n"))).alias("text"))

    def under(s: Column) -> Column:
        at = (s["start"] - s["turn_start"] - len(START) + 1).cast("int")
        return unescape(F.substr(F.element_at("pieces", s["turn"] + 1), at, (s["end"] - s["start"]).cast("int")))

    return f.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.transform("loss_mask", under).alias("loss_texts"))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("turn"), F.count("*").over(Window.partitionBy("conv_id")).alias("turns"), "role", F.coalesce("text", F.lit("")).alias("text"))


def events_of(rows: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as a log with one event for each row."""
    return _numbered(rows).select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("event"), "role", "text")


#: What is streamed of a message before it is edited or generated again, and the text of a message that is deleted.
DRAFT = "unfinished <|im_end|>"


def stream_of(rows: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as a log of what a chat service records while they come about.

    Every message begins empty and streams a draft. Those of odd turns are
    generated again and streamed in two deltas; those of even turns are edited
    to their first half, and the rest is a delta. The steps of all turns
    alternate, so that only sorting by sequence and folding gives the texts. One
    more message of each conversation is deleted.
    """
    half = (F.length("text") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    odd, first = F.col("turn") % 2 == 1, F.col("turn") == 1
    step = lambda n, event, role, text, turn=F.col("turn"): F.struct(turn.alias("turn"), F.lit(n).alias("step"), event.alias("event"), role.alias("role"), text.alias("text"))
    none, nothing, kind = F.lit(None).cast("string"), F.lit(""), F.lit
    events = [
        step(0, kind("message"), F.col("role"), nothing),
        step(1, kind("delta"), none, F.lit(DRAFT)),
        step(2, F.when(odd, "regenerate").otherwise("edit"), none, F.when(odd, "").otherwise(left)),
        F.when(odd, step(3, kind("delta"), none, left)),
        step(4, kind("delta"), none, right),
        F.when(first, step(0, kind("message"), F.lit("user"), F.lit(DRAFT), F.lit(0))),
        F.when(first, step(5, kind("delete"), none, none, F.lit(0))),
    ]
    log = _numbered(rows).select("conv_id", "turns", F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))
    return log.select("conv_id", "turn", (F.col("step") * (F.col("turns") + 1) + F.col("turn")).alias("seq"), "event", "role", "text")
