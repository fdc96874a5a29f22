"""Chats from event logs: fold deltas, edits and regenerations into messages, then render.

An event is (conv_id, seq, message, kind, role, body):
* ``delta`` appends body to the message's present answer;
* ``regenerate`` throws the present answer away; later deltas start a new one;
* ``edit`` replaces what the message holds by body; later deltas append to it;
* ``remove`` takes the message out.
Messages stand in the order of ``message``, events in the order of ``seq``. Folding is done per
message, so a long conversation spreads over many tasks until its rendered turns are joined.

The template marks turns and escapes control strings inside texts: between the first character of a
control string and the rest a backslash is put (one more, if some stand there already), which
``unescape`` takes away again. Assistant texts are under the loss mask, without their marks.

Defined cases: a null text or body is empty; a null role is the role ``""``; role names are escaped
as texts are and end at the first line feed, so line feeds and backslashes in them are written as
``\\n`` and ``\\\\``; events with the same seq are ordered by kind and body, so repeated runs agree; a
message with no event left (or removed) is no turn; a conversation without turns is no row; rows
with a null conversation form a conversation of their own. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template: <s>[INST] role LF text [/INST]</s>, and assistants' texts between <s> and </s>.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
OPEN, SHUT = "<s>[INST] ", " [/INST]</s>"
ANSWER_OPEN, ANSWER_SHUT = "<s>", "</s>"
ANSWERING = "assistant"
DELTA_CHARS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1\\\\$2$3")


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: what each message holds after its last event.

    The events of one message are gathered (with partial lists per task); a message is bounded by
    what one row can hold.
    """
    event = F.struct(F.col("seq"), F.col("kind"), F.coalesce("body", F.lit("")).alias("body"),
                     F.coalesce("role", F.lit("")).alias("role"))
    logs = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # The last event that sets the text anew, and what came after it.
    anew = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i))
    logs = logs.withColumn("base", F.coalesce(F.array_max(anew), F.lit(-1)))
    tail = F.expr("slice(log, greatest(base, 0) + 1, size(log))")
    said = F.filter(tail, lambda e: e["kind"].isin("delta", "edit"))
    return (logs.withColumn("last_kind", F.expr("if(base < 0, 'delta', log[base].kind)"))
            .filter("last_kind <> 'remove' or base < size(log) - 1")
            .select("conv_id", "message", F.expr("element_at(log, -1).role").alias("role"),
                    F.array_join(F.transform(said, lambda e: e["body"]), "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (code points, end exclusive)."""
    role = F.regexp_replace(F.regexp_replace(F.coalesce("role", F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    body = escape(F.coalesce("text", F.lit("")))
    answering = F.coalesce(F.col("role") == ANSWERING, F.lit(False))
    turn = F.struct("message", answering.alias("loss"), F.when(
        answering, F.concat(F.lit(ANSWER_OPEN), body, F.lit(ANSWER_SHUT))).otherwise(
        F.concat(F.lit(OPEN), escape(role), F.lit("\n"), body, F.lit(SHUT))).alias("text"))
    chats = (messages.select("conv_id", turn.alias("turn"))
             .groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")))
    chats = chats.select("conv_id", F.col("turns.loss").alias("loss"), F.col("turns.text").alias("texts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):  # a chat may be long: one at a time
                texts, at, spans = batch.column("texts")[k].as_py(), 0, []
                for loss, text in zip(batch.column("loss")[k].as_py(), texts):
                    if loss:
                        spans.append({"start": at + len(ANSWER_OPEN), "end": at + len(text) - len(ANSWER_SHUT)})
                    at += len(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").slice(k, 1), pa.array([len(texts)], pa.int64()),
                     pa.array(["".join(texts)], pa.string()), pa.array([spans], span)],
                    names=["conv_id", "n_turns", "formatted", "loss_spans"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(joined, f"conv_id {kind}, n_turns bigint, formatted string, "
                                    "loss_spans array<struct<start: bigint, end: bigint>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted chat: role and text, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith(OPEN, at):
            end = formatted.index(SHUT, at + len(OPEN))
            role, _, text = formatted[at + len(OPEN):end].partition("\n")
            role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))
            at = end + len(SHUT)
        else:
            end = formatted.index(ANSWER_SHUT, at + len(ANSWER_OPEN))
            role, text = ANSWERING, formatted[at + len(ANSWER_OPEN):end]
            at = end + len(ANSWER_SHUT)
        turns.append((role, unescape(text)))
    return turns


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from formatted text and loss spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a chat may be long: one at a time
                formatted = batch.column("formatted")[k].as_py()
                turns = [{"role": r, "text": t} for r, t in parse(formatted)]
                loss = "".join(unescape(formatted[s["start"]:s["end"]])
                               for s in batch.column("loss_spans")[k].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").slice(k, 1),
                     pa.array([turns], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                     pa.array([loss], pa.string()), pa.array([len(formatted)], pa.int64())],
                    names=["conv_id", "turns", "loss_text", "formatted_chars"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, turns array<struct<role: string, text: string>>, loss_text string, "
             "formatted_chars bigint")


def events_of(rows: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log that yields the given turns.

    A turn is a draft that is regenerated, then its text in deltas; every third turn is sent as a
    draft and an edit instead. Rows with equal ``turn`` are turns of their own, ordered by role and
    a hash of the text; equal rows follow each other.
    """
    text = F.coalesce("text", F.lit(""))
    rows = (rows.groupBy("conv_id", "turn", "role", text.alias("text")).agg(F.count("*").alias("copies"))
            .withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))))
    message = F.struct("turn", "role", F.xxhash64("text").alias("hash"), "copy")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(
        (F.length(text) - 1) / delta_chars).cast("int"))),
        lambda i: F.struct(F.lit("delta").alias("kind"),
                           F.substring(text, i * delta_chars + 1, F.lit(delta_chars)).alias("body")))
    draft = F.struct(F.lit("delta").alias("kind"), F.lit("draft ").alias("body"))
    again = F.struct(F.lit("regenerate").alias("kind"), F.lit("").alias("body"))
    edited = F.struct(F.lit("edit").alias("kind"), text.alias("body"))
    log = F.when(F.coalesce(F.col("turn"), F.lit(0)) % 3 == 2, F.array(draft, edited)).otherwise(
        F.concat(F.array(draft, again), chunks))
    return (rows.select("conv_id", message.alias("message"), "role", F.posexplode(log).alias("seq", "e"))
            .select("conv_id", "seq", "message", F.col("e.kind").alias("kind"), "role",
                    F.col("e.body").alias("body")))


def of_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Every conversation and conversation -7, rendered and read back."""
    rows = spark.read.parquet(path).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                           "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ANSWERING).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = read_back(render(fold(events_of(rows.unionByName(probe)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
