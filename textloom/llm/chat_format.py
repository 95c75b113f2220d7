"""Chat formatting from event logs, with DataFrame functions only.

A conversation is a log of events (conv_id, seq, kind, message, role, text):

- ``message``    begins a message; its text so far is the event's text
- ``delta``      appends its text to the message (a streamed piece)
- ``edit``       replaces the message's text by its own
- ``regenerate`` throws the message's text away and begins anew with its own

The log is partitioned by conversation and message, sorted by seq and folded
into final messages: what counts is the text from the last event on that is no
delta. Messages stand in the order in which they began. They are then rendered
by a template, with the spans of the assistant's texts as loss mask.

Control strings inside texts and roles are escaped by a backslash after their
first character, one more where there are some already, so unescaping is exact
and texts without control strings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: What follows the first character of a control string.
REST = r"(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{REST})", "$1$2")


def escape_role(role: Column) -> Column:
    """Also a role's line breaks, as one ends it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text): each row begins a message of its own."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.monotonically_increasing_id().cast("string").alias("message"), "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, seq (of its beginning), role and text of each final message.

    Null text counts as empty, an unknown or null kind as ``message``; a message
    whose first event is no ``message`` begins with that event. The role is that
    of the first event that has one, else empty. Events with equal seq are taken
    by kind (delta last), then text; repeated deltas are applied as often as they come.
    """
    kind = F.when(F.col("kind") == "delta", 1).otherwise(0)
    event = F.struct(F.col("seq"), kind.alias("late"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    by = log.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("events"), F.max(F.when(kind == 0, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("last"))
    counts = F.filter("events", lambda e: (e["late"] == 1) & (F.col("last").isNull() | ~(e["seq"] < F.col("last.seq"))))
    text = F.concat(F.coalesce("last.text", F.lit("")), F.array_join(F.transform(counts, lambda e: e["text"]), ""))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return by.select("conv_id", F.col("events")[0]["seq"].alias("seq"), F.coalesce(F.try_element_at(F.transform(roles, lambda e: e["role"]), F.lit(1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted and loss_spans (start from 0 and length, in code points) of each conversation.

    Messages are taken by seq; of equal ones by role, then text. A conversation
    becomes one string, so its own text must fit a row.
    """
    body = messages.select("conv_id", "seq", "role", "text", F.concat(F.lit(START), escape_role(F.col("role")), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    part = F.concat("head", "body", F.lit(END))
    placed = body.select("conv_id", F.row_number().over(order).alias("i"), part.alias("part"), F.col("role").isin(*loss_roles).alias("loss"), F.length("head").alias("skip"), F.length("body").alias("n"), F.sum(F.length(part).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    span = F.when(F.col("loss"), F.struct((F.coalesce("before", F.lit(0)) + F.col("skip")).alias("start"), F.col("n").cast("long").alias("length")))
    by = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("parts"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return by.select("conv_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role and text, unescaped) and loss_text (what the mask covers, unescaped), both read from the string."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = F.lit(len(START))
    rows = once(formatted, "_pieces", F.transform(pieces, lambda x: F.struct(F.substring_index(F.substr(x, head + 1), MIDDLE, 1).alias("role"), x.alias("x"))))
    turns = F.transform("_pieces", lambda p: F.struct(unescape_role(p["role"]).alias("role"), unescape(F.substr(p["x"], head + F.length(p["role"]) + 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return rows.withColumn("turns", turns).withColumn("loss_text", loss).drop("_pieces")


def format_log(log: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation of an event log; other columns are not read, an empty log gives an empty table."""
    return render(fold(log), loss_roles)
