"""Chat formatting from an event log.

A log has one row an event: conversation, sequence number, kind, message id,
role and text. ``message`` opens a message, ``delta`` adds to it, ``edit``
replaces its text, ``regenerate`` starts its text again, ``delete`` removes it.
Events of one message fold by themselves; only final messages meet in their
conversation, in order of the sequence number that opened them.

The rendered form marks turns with ``<|turn|>``, ``<|say|>`` and ``<|end|>``.
Inside roles and texts each backslash is doubled and ``<|`` becomes ``<\\|``, so a
mark found in the output is always a real one and the text can be read back:
a backslash always stands before the character it hides. The loss mask holds
the code-point spans of assistant texts, without marks.

All of it is DataFrame expressions.

Defined results: null roles and texts are empty, a null kind is ``message``;
null conversations form one; events of the same number (ties) follow by kind in
the order of ``KINDS``, then by role and text; a repeated ``message`` row is a
message of its own. An event without an open message opens one. Very long texts
and conversations are formatted whole, each by one row. An empty log gives no
row. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: In this order events of one sequence number follow each other.
KINDS = ("message", "regenerate", "edit", "delta", "delete")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of events(conv_id, seq, kind, message, role, text): (conv_id, seq, message, opened, role, text)."""
    clean = events.select(
        "conv_id", "seq", "message", F.coalesce(F.col("kind"), F.lit("message")).alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("step", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    order = W.partitionBy("conv_id", "message").orderBy("seq", "step", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    opened = clean.withColumn("opened", F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(order))
    event = F.struct("seq", "step", "kind", "role", "text")
    grouped = opened.groupBy("conv_id", "message", "opened").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # The text is what the last event that is no delta says, then all deltas after it.
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(-1))))
    text = let(last, lambda k: F.array_join(F.transform(F.filter("log", lambda e, i: i >= k), lambda e: e["text"]), ""))
    gone = let(last, lambda k: F.coalesce(F.get(F.col("log"), F.greatest(k, F.lit(0)))["kind"] == "delete", F.lit(False)))
    first = F.get(F.col("log"), F.lit(0))
    return grouped.where(~gone).select("conv_id", first["seq"].alias("seq"), "message", "opened", first["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of final messages; spans are code points, end exclusive."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAY))
    pieces = messages.select(
        "conv_id", "seq", "message", "opened", "role", "text",
        F.length(head).alias("lead"), F.length(escape(F.col("text"))).alias("chars"), F.concat(head, escape(F.col("text")), F.lit(END)).alias("piece"),
    )
    order = W.partitionBy("conv_id").orderBy("seq", "message", "opened", "role", "text")
    placed = pieces.select(
        "conv_id", F.row_number().over(order).alias("place"), "piece", "role",
        (F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("lead")).alias("start"), "chars",
    )
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "role", "start", "chars"))).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["chars"]).alias("end")),
    )
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of an event log."""
    return render(fold(events))


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation, as structs of role and text."""
    bodies = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    parts = lambda b: F.split(b, r"<\|say\|>|<\|end\|>")
    return F.transform(bodies, lambda b: F.struct(unescape(F.get(parts(b), F.lit(0))).alias("role"), unescape(F.get(parts(b), F.lit(1))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def table_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as an event log."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("message"), "role", "text"
    )
