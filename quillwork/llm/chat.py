"""Chat formatting from event logs: fold the events of each message, render the conversation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """A backslash more between each < and | that only backslashes part, so no control string is left; reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, with line breaks and backslashes written as \\n and \\\\: the first line break ends a role."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pairs = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(pairs, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def events_of_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A message event for each row, in the order of turn, role and text (nulls last); repeated rows are turns too."""
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("__turn", "role", "text")])
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("__turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    seq = F.row_number().over(order).cast("long")
    return named.select("conv_id", seq.alias("seq"), seq.alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def log_of_rows(rows: DataFrame, **columns: str) -> DataFrame:
    """An event log that folds back to ``rows``: what a server that streams, corrects and answers again would write.

    By its number, a turn is (1) streamed: a message and two deltas; (2) corrected: a wrong message, an edit, a delta;
    or (0) answered again: a wrong message and delta, a message that follows it, a regeneration, which drops both, and
    two deltas. Every fifth has beside it a message that is deleted. Events stand in reverse; only seq tells the order.
    """
    turns = events_of_rows(rows, **columns)
    text, seq, turn = F.coalesce("text", F.lit("")), F.col("seq") * 16, F.col("seq") % 3
    third = F.floor(F.length(text) / 3).cast("int")
    piece = lambda a, n: F.substring(text, a + 1, n)
    rest = F.length(text) - 2 * third

    def event(k: int, kind: str, said, role=None, other: bool = False):
        of = F.col("message_id") * 2 + int(other)
        return F.struct((seq + k).alias("seq"), of.alias("message_id"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), said.alias("text"))

    role, wrong = F.col("role"), F.lit("<|im_end|> a draft that must not stay")
    streamed = F.array(event(0, "message", piece(F.lit(0), third), role), event(1, "delta", piece(third, third)), event(2, "delta", piece(2 * third, rest)))
    corrected = F.array(event(0, "message", wrong, role), event(1, "edit", piece(F.lit(0), 2 * third)), event(2, "delta", piece(2 * third, rest)))
    again = F.array(event(0, "message", wrong, role), event(1, "delta", wrong), event(2, "message", wrong, F.lit("user"), True), event(3, "regenerate", F.lit(None).cast("string")), event(4, "delta", piece(F.lit(0), third)), event(5, "delta", piece(third, third + rest)))
    deleted = F.array(event(8, "message", wrong, F.lit("user"), True), event(9, "delta", wrong, None, True), event(10, "delete", F.lit(None).cast("string"), None, True))
    main = F.when(turn == 1, streamed).when(turn == 2, corrected).otherwise(again)
    every = F.reverse(F.when((F.col("seq") % 5 == 0) & (turn != 0), F.concat(main, deleted)).otherwise(main))
    return turns.select("conv_id", F.explode(every).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, place, role, text) of a log with conv_id, seq, message_id, kind, role, text.

    In the order of seq (ties: kind, text): ``message`` and ``edit`` set a message's text, ``delta`` appends to it,
    ``regenerate`` empties it and drops every later message begun before, ``delete`` drops it until a ``message`` or
    ``edit`` brings it back. A message stands where its first event stands; its role is the first that is not null.
    Null text is empty text; other kinds are ignored. Events of a message are sorted by Spark and meet in its own row
    only, whatever the length of the conversation.
    """
    log = events.filter(F.col("kind").isin(*KINDS)).select("conv_id", "message_id", F.col("seq"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    step = F.struct("seq", "kind", "text")
    known = log.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("place"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "text"))).alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.max(F.when(F.col("kind").isin("message", "edit", "regenerate", "delete"), step)).alias("reset"),
        F.sort_array(F.collect_list(step)).alias("steps"),
    )
    tail = F.when(F.col("reset").isNull(), F.col("steps")).otherwise(F.filter("steps", lambda e: e >= F.col("reset")))
    parts = F.transform(F.filter(tail, lambda e: e["kind"].isin("message", "edit", "delta")), lambda e: e["text"])
    before = Window.partitionBy("conv_id").orderBy("place", F.col("message_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    kept = known.withColumn("cut", F.max("again").over(before)).filter("(cut is null or place > cut) and (reset is null or reset.kind <> 'delete')")
    return kept.select("conv_id", "place", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_mask: (turn, start, length) in code points of the turn's own stretch, from START on.

    A turn is START, role, a line break, text, END, a line break, with role and text escaped. The mask covers the text
    of each turn of ``trained_role``.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    shown = messages.select("conv_id", "place", "message_id", F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n")).alias("turn"), F.when(F.col("role") == trained_role, F.struct((F.length(role) + 1).alias("start"), F.length(text).alias("length"))).alias("mask"))
    grouped = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "message_id", "turn", "mask"))).alias("turns"))
    masks = F.filter(F.transform("turns", lambda t, k: F.struct(k.alias("turn"), t["mask"]["start"].alias("start"), t["mask"]["length"].alias("length"))), lambda m: m["start"].isNotNull())
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), masks.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss (the masked texts, unescaped), taken from formatted and loss_mask alone."""
    pieces = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>")), 2, 1 << 30)  # nothing stands before the first
    split = rendered.select("conv_id", "formatted", "loss_mask", pieces.alias("pieces"))
    cut = lambda p: F.substring_index(p, END, 1)
    head = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform("pieces", lambda p: F.struct(unescape_role(head(p)).alias("role"), unescape(F.substring(cut(p), F.length(head(p)) + 2, F.length(p))).alias("text")))
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.get("pieces", m["turn"]), m["start"] + 1, m["length"])))
    return split.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def format_events(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_mask of the conversations that a log folds to.

    Null text is empty text, a null role an empty role; null conversation ids are one conversation. Other columns are
    not read; an empty log gives no rows. A very long text is folded like any other; a formatted conversation is one
    value, so the longest must fit a task; nothing else does.
    """
    return render(fold(events), trained_role)


def format_conversations(rows: DataFrame, trained_role: str = "assistant", **columns: str) -> DataFrame:
    """``format_events`` of a table of rows with conversation, turn, role and text. Rows are turns in the order of turn,
    role and text (nulls last); repeated rows are turns of their own."""
    return format_events(events_of_rows(rows, **columns), trained_role)
