"""A top-level JSON array read by many tasks per file: composable state tables over byte ranges.

``multiLine`` JSON gives each file to one task, since a task that starts inside an array cannot tell
whether a comma separates records, stands inside a nested object, or inside a string. The state that
decides it is (inside a string, nesting depth); at a comma, no escape is pending in valid JSON.

1. The file is read as pieces between commas (the splittable text source with ``lineSep=","``); each
   task reads its byte range. For each range, one walk over its pieces gives its transition table:
   for both entry values of "inside a string", the exit value and the change of depth. Tables
   compose; a range's table is the composition of its pieces'.
2. Per file, the ranges' tables are folded in byte order (one small row per range, in one task per
   file) into each range's entry state, which is broadcast to the pieces.
3. Each task walks its pieces from the known state; a comma outside strings at depth 1 ends a record.
   Records that start and end in a range are finished there; at most a head and a tail piece a range
   travel and are joined to their record, as for CSV (``csv_split``).
4. Records are parsed by ``from_json`` with the given schema.

Records keep the order of their bytes (file, range start, piece in range). The array's own brackets
and the white space around records are dropped; an empty array has no records. The top level of
every file must be one array.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from expband.sources.csv_split import BROADCAST_RANGES, PIECES

SPECIAL = re.compile(r'\\.|["\[\]{}]', re.S)


def step(piece: str, inside: int, depth: int) -> tuple[int, int]:
    """State after a piece of text, from (inside a string, depth) before it."""
    for m in SPECIAL.finditer(piece):
        c = m.group()
        if inside:
            if c == '"':
                inside = 0
        elif c == '"':
            inside = 1
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
    return inside, depth


def pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", ",").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _tables(batches):
    """Per range: for entry inside = 0 and 1, the exit inside and the change of depth."""
    got = {}
    for pdf in batches:
        for value, file, block in zip(pdf["value"], pdf["file"], pdf["block"]):
            t = got.setdefault((file, block), [0, 0, 1, 0])  # exit0, delta0, exit1, delta1
            t[0], t[1] = step(value, t[0], t[1])
            t[2], t[3] = step(value, t[2], t[3])
    if got:
        yield pd.DataFrame([(f, b, *t) for (f, b), t in got.items()],
                           columns=["file", "block", "exit0", "delta0", "exit1", "delta1"])


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry state of each range of one file, folding the ranges' tables in byte order."""
    pdf = pdf.sort_values("block")
    inside, depth, rows = 0, 0, []
    for block, e0, d0, e1, d1 in zip(pdf["block"], pdf["exit0"], pdf["delta0"], pdf["exit1"], pdf["delta1"]):
        rows.append((pdf["file"].iloc[0], block, inside, depth))
        inside, depth = (int(e1), depth + int(d1)) if inside else (int(e0), depth + int(d0))
    return pd.DataFrame(rows, columns=["file", "block", "inside", "depth"])


def entry_states(parts: DataFrame) -> DataFrame:
    tables = parts.mapInPandas(_tables, "file string, block long, exit0 int, delta0 long, exit1 int, delta1 long")
    return tables.groupBy("file").applyInPandas(_fold, "file string, block long, inside int, depth long")


def _strip(text: str, start_depth: int, end_depth: int) -> str:
    text = text.strip()
    if start_depth == 0 and text.startswith("["):
        text = text[1:]
    if end_depth == 0 and text.endswith("]"):
        text = text[:-1]
    return text.strip()


def _tail(text: str, inside: int, depth: int) -> str:
    """A piece that ends a record begun in an earlier range; the array's closing bracket is dropped."""
    if inside == 0 and depth == 0:
        text = text.rstrip()
        return text[:-1] if text.endswith("]") else text
    return text


def _head(text: str, depth: int) -> str:
    """A record's beginning that a later range ends; the array's opening bracket is dropped."""
    if depth == 0:
        text = text.lstrip()
        return text[1:] if text.startswith("[") else text
    return text


def _cut(batches):
    """Records of each range, walking its pieces from the range's entry state."""
    open_ = {}  # (file, block) -> [inside, depth, first seq, parts, carry, seq0, depth at record start]
    out = []
    for pdf in batches:
        for value, file, block, seq, inside, depth in zip(pdf["value"], pdf["file"], pdf["block"], pdf["seq"],
                                                           pdf["inside"], pdf["depth"]):
            key = (file, block)
            st = open_.get(key)
            if st is None:
                st = open_[key] = [int(inside), int(depth), None, [], True, seq, None]
            at_start = st[0] == 0 and st[1] <= 1
            if at_start and st[4]:  # the first record start of the range
                if st[3]:
                    out.append((file, block, st[5], "tail", _tail(",".join(st[3]), st[0], st[1])))
                st[4], st[3] = False, []
            if at_start and st[2] is None:
                st[2], st[6] = seq, st[1]
            st[3].append(value)
            st[0], st[1] = step(value, st[0], st[1])
            if st[0] == 0 and st[1] <= 1 and not st[4]:
                text = _strip(",".join(st[3]), st[6], st[1])
                if text:
                    out.append((file, block, st[2], "whole", text))
                st[2], st[3] = None, []
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "text"])
            out = []
    for (file, block), st in open_.items():
        if st[4] and st[3]:
            out.append((file, block, st[5], "tail", _tail(",".join(st[3]), st[0], st[1])))
        elif st[3]:
            out.append((file, block, st[2], "head", _head(",".join(st[3]), st[6])))
    if out:
        yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, text: the records of the files' top-level arrays, in file order."""
    parts = pieces(spark, path)
    states = entry_states(parts)
    few = states.count() <= BROADCAST_RANGES
    walked = parts.join(F.broadcast(states) if few else states, ["file", "block"]).mapInPandas(_cut, PIECES).persist()
    whole = walked.where("kind = 'whole'").select("file", "block", "seq", "text")
    ends = walked.where("kind <> 'whole'")
    heads = F.when(F.col("kind") == "head", F.struct("block", "seq"))
    order = Window.partitionBy("file").orderBy("block", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    owner = ends.select("file", "block", "seq", "kind", F.last(heads, ignorenulls=True).over(order).alias("owner"))
    joined = (ends.join(owner, ["file", "block", "seq", "kind"]).where(F.col("owner").isNotNull())
              .groupBy("file", F.col("owner.block").alias("block"), F.col("owner.seq").alias("seq"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))),
                                            lambda p: p["text"]), ",").alias("text")))
    return whole.unionByName(joined.withColumn("text", F.trim("text"))).where(F.col("text") != "")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records as columns of ``schema``, with x_file and x_order."""
    return records(spark, path).select(F.from_json("text", schema).alias("r"), F.col("file").alias("x_file"),
                                       F.struct("block", "seq").alias("x_order")).select("r.*", "x_file", "x_order")
