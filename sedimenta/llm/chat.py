"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is dealt by conversation and sorted by sequence; streamed deltas, edits and regenerations fold into final messages,
which are rendered with a template, together with a mask of the text that a model shall learn.

Events (columns conv, seq, kind, msg, role, text):
  message     a whole message of its own; ``msg`` gives its place
  start       opens message ``msg`` with a role (and perhaps text)
  delta       appends text to message ``msg``
  edit        replaces the text of message ``msg`` so far; the deltas after it append to the new text
  regenerate  empties message ``msg`` and undoes all that came before it in later messages of the conversation, whole ones included

The fold needs no loop over events: what counts of a message is its events from its last start, edit or regenerate on, unless an
earlier message was regenerated after them.  A whole message counts unless an earlier one was regenerated after it.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed.  In roles and texts ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes
``\\g``, so that no text can hold a mark; :func:`unescaped` restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"
EVENTS = ("conv", "seq", "kind", "msg", "role", "text")
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for raw, mark in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    """Each backslash of an escaped text starts one mark, so the marks can be undone one after the other, the backslash last."""
    for raw, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def final_messages(events: DataFrame) -> DataFrame:
    """conv, msg, seq, role, text: the messages that stay, each with its final text.

    Null text: empty.  Null role: that of the message's start, else empty.  Null conv: one conversation of its own.  Null seq or msg
    sorts first.  An unknown kind raises.  Events that are equal in seq are taken in the order of kind, role and text.
    A message that gets deltas without a start counts from its first event.
    """
    known = ["message", "start", "delta", "edit", "regenerate"]
    bad = F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null"))))
    e = events.select(*EVENTS[:2], F.when(F.col("kind").isin(known), F.col("kind")).otherwise(bad).alias("kind"), *EVENTS[3:])
    at = F.struct("seq", "kind", "role", "text")
    whole = F.col("kind") == "message"
    resets = F.col("kind").isin("start", "edit", "regenerate")
    messages = e.groupBy("conv", "msg").agg(
        F.max(F.when(resets, at)).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max_by("role", F.when(~whole & F.col("role").isNotNull(), at)).alias("role"),
        F.collect_list(F.when(~whole, at)).alias("log"),
        F.collect_list(F.when(whole, at)).alias("whole"),
    )
    before = Window.partitionBy("conv").orderBy(F.col("msg").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    alive = messages.withColumn("undone", F.max("regenerated").over(before))
    stays = lambda x: F.col("undone").isNull() | F.coalesce(x["seq"] > F.col("undone"), F.lit(False))
    counts = lambda x: (F.col("reset").isNull() | (x >= F.col("reset"))) & stays(x)
    said = lambda seq, role, text: F.struct(seq.alias("seq"), F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))
    text = lambda log: F.array_join(F.transform(log, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    folded = alive.withColumn("log", F.filter(F.array_sort("log"), counts))
    own = F.when(F.size("log") > 0, F.array(said(F.get("log", F.lit(0))["seq"], F.col("role"), text(F.col("log"))))).otherwise(F.array())
    others = F.transform(F.filter("whole", stays), lambda x: said(x["seq"], x["role"], F.coalesce(x["text"], F.lit(""))))
    return folded.select("conv", "msg", F.inline(F.concat(own, others)))


def format_chats(events: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """conv, n_turns, pieces, formatted, mask_runs: a row for each conversation that keeps a message.

    events: at least the columns of EVENTS; others are ignored.  Messages are in the order of msg, seq, role and text.  pieces: array of
    (piece, loss), which joined make ``formatted``; mask_runs: lengths of text without and with loss, by turns, beginning without.
    A conversation becomes one row, so it has to fit into a task; nothing else of a conversation is gathered but its messages.
    An empty table gives an empty result.
    """
    m = final_messages(events)
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    rows = m.select("conv", F.struct("msg", "seq", F.col("role").alias("said_by"), role.alias("role"), text.alias("text")).alias("turn"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    loss = lambda t: t["said_by"] == learned_role
    piece = lambda p, learned: F.struct(p.alias("piece"), learned.alias("loss"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(piece(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)), F.lit(False)), piece(t["text"], loss(t)), piece(F.lit(CLOSE), F.lit(False)))))
    chats = chats.select("conv", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    runs = F.flatten(F.transform("pieces", lambda p: F.when(p["loss"], F.array(F.lit(0), F.length(p["piece"]))).otherwise(F.array(F.length(p["piece"]), F.lit(0)))))
    return chats.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).withColumn("mask_runs", runs)


def read_turns(formatted: Column) -> Column:
    """array of (role, text), read back from a rendered conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(OPEN) + 1))
    return F.transform(F.transform(parts, body), lambda x: F.struct(unescaped(F.substring_index(x, MIDDLE, 1)).alias("role"), unescaped(F.substr(x, F.instr(x, MIDDLE) + 1)).alias("text")))


#: Events of a turn at most.
STEPS = 5
#: What an edit or a regeneration takes away again.
DRAFT = "a first answer, taken back "


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as the log of a streaming client.

    A turn is opened without text and streamed in two deltas.  By its place in the conversation it also has a past: of each four turns
    the second begins with a draft and is regenerated, the third begins with one that an edit replaces by the first half of the text.
    Equal turn numbers are messages of their own, in the order of role and text; null text: empty.
    """
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("msg", F.row_number().over(order).cast("long"))
    half = F.shiftright(F.length("text"), 1)
    first, second = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))
    none, draft = F.lit(None).cast("string"), F.lit(DRAFT)
    begin, halves = event("start", none, F.col("role")), (event("delta", first), event("delta", second))
    past = F.col("msg") % 4
    log = (
        F.when(past == 2, F.array(begin, event("delta", draft), event("regenerate", none), *halves))
        .when(past == 3, F.array(begin, event("delta", draft), event("edit", first), halves[1]))
        .otherwise(F.array(begin, *halves))
    )
    return rows.select("conv", "msg", F.posexplode(log).alias("step", "x")).select("conv", (F.col("msg") * STEPS + F.col("step")).alias("seq"), "x.kind", "msg", "x.role", "x.text")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations as logs of events (``conversation_events``), folded into messages, rendered and read back."""
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    added = added.select("conv_id", "x.turn", "x.role", F.lit("\\### Assistant: </turn> ok").alias("text"))
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    chats = format_chats(conversation_events(table))
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescaped(p["piece"])), "")
    out = chats.select(F.col("conv").alias("conv_id"), F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), said.alias("said"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
