"""Quoted multi-line CSV read by many tasks per file: a quote-parity scan over byte ranges.

Spark's CSV reader must give a whole file to one task when fields may hold line feeds
(``multiLine``), since a task that starts in the middle of a file cannot tell whether a line feed
ends a record or stands inside quotes. With ``"`` as both quote and escape (doubled quotes), that
state is the parity of the quotes read since the start of the file. So:

1. The file is read as ``\\n``-separated lines by the splittable text source; each task reads its
   byte range (``_metadata.file_block_start``). Per range, the parity of its quotes is all that a
   range contributes: the state after it is the state before it, flipped or not, for both entry
   states. One aggregate gives one row per range.
2. A running sum over the ranges of a file (a small table, one row per range) gives each range's
   entry state; it is joined to the lines (broadcast below ``broadcast_ranges`` ranges, else by
   shuffle).
3. Each task walks its lines in order with the known entry state and cuts records at line feeds
   outside quotes. Records that start and end in a range are finished in that task; only the piece
   before the range's first record start (the end of a record begun earlier) and the piece after its
   last one travel: at most two pieces a range, joined to their record by a second small scan.
4. Records are parsed by ``from_csv`` with the header's column names, all strings.

Records are ordered by (file, range start, line in range), the order of their bytes in the file, so
"last row wins" keeps working. A line's trailing ``\\r`` outside quotes is dropped (CRLF files);
lines that are empty outside quotes are no records. The first record of each file is its header.
Bytes inside quotes are kept as they are; Spark's one-task reader, in a file of CRLF lines, also
turns a quoted CRLF into LF, which this reader does not.
"""

from __future__ import annotations

import csv
import io as _io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most ranges whose entry states are broadcast to the lines; beyond, both sides are shuffled.
BROADCAST_RANGES = 1_000_000

PIECES = "file string, block long, seq long, kind string, text string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files, each with its file, the start of its byte range, its order and quote parity."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("int").alias("flip"))


def entry_states(lined: DataFrame) -> DataFrame:
    """One row per byte range: whether it starts inside quotes (1) or not (0)."""
    ranges = lined.groupBy("file", "block").agg((F.sum("flip") % 2).cast("int").alias("flip"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("file", "block", (F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2).cast("int").alias("entry"))


def _cut(batches):
    """Records of each range, walking its lines in order from the range's entry state."""
    open_ = {}  # (file, block) -> [state, seq of the record's first line or None, lines, carry]
    out = []

    def flush(key, kind, seq, parts):
        out.append((key[0], key[1], seq, kind, "\n".join(parts)))

    for pdf in batches:
        for value, file, block, seq, flip, entry in zip(pdf["value"], pdf["file"], pdf["block"], pdf["seq"],
                                                         pdf["flip"], pdf["entry"]):
            key = (file, block)
            st = open_.get(key)
            if st is None:
                st = open_[key] = [int(entry), None, [], True, seq]
            state, first, parts, carry = st[0], st[1], st[2], st[3]
            if state == 0 and not carry and first is None:
                first = seq
            if state == 0 and carry:  # the first record start of the range
                if parts:
                    flush(key, "tail", st[4], parts)
                carry, parts, first = False, [], seq
            after = state ^ int(flip)
            parts.append(value[:-1] if after == 0 and value.endswith("\r") else value)
            if after == 0 and not carry:
                text = "\n".join(parts)
                if text != "":
                    out.append((file, block, first, "whole", text))
                parts, first = [], None
            st[0], st[1], st[2], st[3] = after, first, parts, carry
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "text"])
            out = []
    for key, (state, first, parts, carry, seq0) in open_.items():
        if carry and parts:
            flush(key, "tail", seq0, parts)  # a whole range inside one record
        elif parts:
            flush(key, "head", first, parts)
    if out:
        yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, text: the CSV records of all files, header rows included, in file order."""
    lined = lines(spark, path)
    states = entry_states(lined)
    few = states.count() <= BROADCAST_RANGES
    walked = lined.join(F.broadcast(states) if few else states, ["file", "block"]).mapInPandas(_cut, PIECES)
    walked = walked.persist()
    whole = walked.where("kind = 'whole'").select("file", "block", "seq", "text")
    pieces = walked.where("kind <> 'whole'")
    # a tail belongs to the latest head before its range: a scan over at most two rows a range
    heads = F.when(F.col("kind") == "head", F.struct("block", "seq"))
    order = Window.partitionBy("file").orderBy("block", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    owner = pieces.select("file", "block", "seq", "kind", F.last(heads, ignorenulls=True).over(order).alias("owner"))
    joined = (pieces.join(owner, ["file", "block", "seq", "kind"]).where(F.col("owner").isNotNull())
              .groupBy("file", F.col("owner.block").alias("block"), F.col("owner.seq").alias("seq"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))),
                                            lambda p: p["text"]), "\n").alias("text")))
    return whole.unionByName(joined).where(F.col("text") != "")


def _names(header: str) -> list[str]:
    return next(csv.reader(_io.StringIO(header), quotechar='"', doublequote=True))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The files as all-string columns named by the first file's header, with x_file and x_order."""
    recs = records(spark, path)
    starts = recs.groupBy("file").agg(F.min(F.struct("block", "seq")).alias("h"))
    tagged = recs.join(F.broadcast(starts), "file").withColumn(
        "x_header", (F.col("block") == F.col("h.block")) & (F.col("seq") == F.col("h.seq")))
    header = tagged.where("x_header").orderBy("file").select("text").limit(1).collect()
    if not header:
        return spark.createDataFrame([], "x_file string, x_order struct<block:long,seq:long>")
    names = _names(header[0]["text"])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("text", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return tagged.where(~F.col("x_header")).select(
        parsed.alias("r"), F.col("file").alias("x_file"), F.struct("block", "seq").alias("x_order")).select(
        *[F.col("r").getField(n).alias(n) for n in names], "x_file", "x_order")
