"""Filter interaction audit: how five document filters overlap, in every order they can be applied.

Each document is reduced to a mask of the filters it fails (5 bits), and documents are counted per
(part, mask) cell, with how many of them are good or toxic. Nothing else is ever moved: at most 32
cells per part reach the fold. Each cell then folds, in SQL higher-order
functions, across the constant array of all 120 orders: ``transform`` over the orders and
``aggregate`` over the five steps of one order carry the bits removed so far and emit one struct per
step, 600 structs a cell, weighted by the cell's count. The cells of a part are merged by
elementwise sums (``zip_with`` inside ``aggregate``) and the 600 sums come out as rows.

Filters (words: maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive; a null text counts as empty):

* A: fewer than 100 words;
* B: 100 * distinct words < 80 * words (so an empty text never fails B);
* C: 100 * ``[A-Z]`` characters > 10 * code points;
* D: holds any of ``#$%&*|``;
* E: the same text as a row with a smaller doc_id, anywhere in the table (removed or not). A row
  with a null doc_id is smaller than nothing and fails E never; repeated rows of one doc_id do not
  fail E by each other.

Defined cases: an empty table gives no rows; a part (``lang``, null as '') gets all 600 rows, zeros
included; repeated rows are counted each; ``labels`` may repeat a doc_id (a document is good or toxic
if any of its label rows says 1) and documents without labels are neither. Extra columns of the
inputs are not read.

Scale: the regex work is one narrow pass; the texts never cross the network. E needs the smallest
doc_id per text: one aggregate on the text's SHA-256 with map-side combine (a text standing in a
third of all rows is one partial row per task), joined back to narrow rows, a join that adaptive
execution can split. The label join and the cell aggregate move only narrow rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: the letters of the filters, in the order of their bits (A = 1, ..., E = 16).
LETTERS = "ABCDE"
#: All 120 orders, applied left to right; listed by rule, in lexicographic order.
ORDERS = ["".join(p) for p in permutations(LETTERS)]

WORD = "[^\\x20\\x09-\\x0D]+"


def failures(docs: DataFrame) -> DataFrame:
    """Narrow rows: part, doc_id, the text's digest and bits A-D; the text itself is dropped here."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    n = F.size(words)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    bits = (F.when(n < 100, 1).otherwise(0)
            + F.when(F.size(F.array_distinct(words)) * 100 < n * 80, 2).otherwise(0)
            + F.when(upper * 100 > F.length(text) * 10, 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.sha2(text, 256).alias("digest"), bits.alias("bits"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds bit E (16): the same text as a smaller doc_id somewhere in the table."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    e = F.when(F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)), 16).otherwise(0)
    return rows.join(first, "digest").select("part", "doc_id", (F.col("bits") + e).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1); labels are reduced to one row per doc_id first."""
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return rows.join(flags, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """Documents per (part, mask), with how many of them are good or toxic."""
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g"),
                                            F.sum("toxic").alias("t"))


def _bit(letter: str) -> str:
    return f"shiftleft(1, ascii({letter}) - 65)"


#: One cell folded across all orders: 600 structs (kept, removed, redundant, unique, good, toxic).
FOLD = f"""flatten(transform(orders, o -> aggregate(sequence(1, 5),
    named_struct('gone', 0, 'out', cast(array() AS array<struct<kept:bigint,removed:bigint,redundant:bigint,
                 unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>>)),
    (acc, s) -> named_struct(
      'gone', acc.gone | {_bit('substr(o, s, 1)')},
      'out', concat(acc.out, array(named_struct(
        'kept', if((mask & (acc.gone | {_bit('substr(o, s, 1)')})) = 0, n, 0L),
        'removed', if((mask & acc.gone) = 0 AND (mask & {_bit('substr(o, s, 1)')}) != 0, n, 0L),
        'redundant', if((mask & acc.gone) != 0 AND (mask & {_bit('substr(o, s, 1)')}) != 0, n, 0L),
        'unique_fails', if(mask = {_bit('substr(o, s, 1)')}, n, 0L),
        'good_lost', if((mask & acc.gone) = 0 AND (mask & {_bit('substr(o, s, 1)')}) != 0, g, 0L),
        'toxic_lost', if((mask & acc.gone) = 0 AND (mask & {_bit('substr(o, s, 1)')}) != 0, t, 0L))))),
    acc -> acc.out)))"""

#: Elementwise sum of the 600-struct arrays of a part's cells.
MERGE = """aggregate(slice(cells, 2, size(cells)), cells[0], (acc, x) -> zip_with(acc, x, (a, b) -> named_struct(
    'kept', a.kept + b.kept, 'removed', a.removed + b.removed, 'redundant', a.redundant + b.redundant,
    'unique_fails', a.unique_fails + b.unique_fails, 'good_lost', a.good_lost + b.good_lost,
    'toxic_lost', a.toxic_lost + b.toxic_lost)))"""


def folded(counted: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step) from the cells; shapley sums a filter's removals over all orders."""
    orders = F.array(*[F.lit(o) for o in ORDERS]).alias("orders")
    per_cell = counted.select("part", F.col("mask").cast("int").alias("mask"), F.col("n").cast("long").alias("n"),
                              F.col("g").cast("long").alias("g"), F.col("t").cast("long").alias("t"), orders)
    per_cell = per_cell.select("part", F.expr(FOLD).alias("steps"))
    # at most 32 cells a part, each an array of 600 structs: a bounded list to merge
    merged = per_cell.groupBy("part").agg(F.collect_list("steps").alias("cells")).select(
        "part", F.expr(MERGE).alias("steps"))
    rows = merged.select("part", F.posexplode("steps").alias("i", "c")).select(
        "part", F.element_at(orders, (F.col("i") / 5).cast("int") + 1).alias("filter_order"),
        (F.col("i") % 5 + 1).cast("int").alias("step"), "c.*")
    letter = F.expr("substr(filter_order, step, 1)")
    removed_by = rows.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return (rows.withColumn("letter", letter).join(removed_by, ["part", "letter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                    "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic); see the module."""
    return folded(cells(with_labels(with_copies(failures(docs)), labels)))


def of_documents(spark: SparkSession, documents: str, labels: str) -> DataFrame:
    return audit(spark.read.parquet(documents), spark.read.parquet(labels))
