"""The exact vocabulary (most frequent terms) without shuffling every rare term.

A plain aggregate sends, from every task, one row per distinct term it saw: with n-grams most of
them occur once and can never reach the vocabulary. Here a bound on the k-th count decides what
travels (a threshold algorithm):

1. Each task counts its terms exactly, in sites: a site ends when it holds ``site_terms`` distinct
   terms, so a task's memory does not grow with its input. The local counts are written once to
   the shared folder, and all later steps read them instead of the texts.
2. Each site's ``max_terms`` most frequent terms are summed: a term's sums are lower bounds of its
   true counts; the k-th largest lower bound among terms whose document lower bound already
   reaches ``min_df`` is a lower bound ``L`` of the k-th count of the vocabulary.
3. A term with at least ``L`` occurrences in all has at least ``ceil(L / n)`` in one of the ``n``
   sites. Each site sends the terms it holds that often, with their local counts. A term's upper
   bound is what was sent for it plus ``ceil(L / n) - 1`` for every site that did not send it;
   terms whose bound reaches ``L`` form the set S of terms that can reach the vocabulary (every
   term tied with the k-th one included).
4. The local counts of the terms of S (broadcast when at most ``sent_terms`` of them, else joined
   by shuffle) are added up; the vocabulary is their top ``max_terms`` by occurrences, ties by
   term, among those in ``min_df`` documents or more.

Sites hold a fixed number of distinct terms, so ``L`` and ``n`` grow alike and the bound stays as
sharp on a larger table. When it proves nothing (``ceil(L / n) <= 1``, e.g. fewer than
``max_terms`` candidates), all local counts are added up: the result is the same.

Defined cases: null arrays and null terms count nothing; an empty input gives an empty vocabulary;
repeated rows count as often as they occur. The result equals
``textfeat.vocabulary(textfeat.term_statistics(...))`` row for row; only the cost differs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expband.operators import textfeat
from expband.sources import io

#: Most terms of S that are broadcast to the tasks (about 60 MB); beyond, S is joined by shuffle.
SENT_TERMS = 1_000_000
#: Most distinct terms of a site (about 100 MB of a worker with the buffers).
SITE_TERMS = 1 << 19
#: Occurrences that are buffered before they are added to the site's counts.
BUFFERED = 1 << 19


def local_counts(df: DataFrame, column: str, max_terms: int, site_terms: int = SITE_TERMS) -> DataFrame:
    """``site, term, cf, df, top``: exact counts of every site; ``top`` on its ``max_terms`` most frequent."""
    marked = textfeat.marked_terms(df, column)
    buffered = min(BUFFERED, site_terms)

    def added(parts: list[pa.Table], sums: list[tuple[str, str]]) -> pa.Table:
        got = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate(sums)
        return got.select(["term"] + ["_".join(x) for x in sums]).rename_columns(["term", "cf", "df"])

    def closed(counts: pa.Table, site: int) -> list[pa.RecordBatch]:
        cf, top = counts["cf"].to_numpy(), np.zeros(counts.num_rows, bool)
        top[np.argpartition(-cf, max_terms)[:max_terms] if len(cf) > max_terms else slice(None)] = True
        table = pa.table([pa.array(np.full(len(cf), site)), *counts.columns, pa.array(top)],
                         names=["site", "term", "cf", "df", "top"])
        return table.to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, counts, waiting, rows = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= buffered:
                new = added(waiting, [("first", "count"), ("first", "sum")])
                counts = [added(counts + [new], [("cf", "sum"), ("df", "sum")])]
                waiting, rows = [], 0
                if counts[0].num_rows >= site_terms:
                    yield from closed(counts[0], site)
                    site, counts = site + 1, []
        if waiting:
            counts.append(added(waiting, [("first", "count"), ("first", "sum")]))
        if counts:
            yield from closed(added(counts, [("cf", "sum"), ("df", "sum")]), site)

    return io.written(marked.mapInArrow(run, "site long, term string, cf long, df long, top boolean"), "counts")


def bounds(df: DataFrame, column: str, max_terms: int) -> DataFrame:
    """Each site's ``max_terms`` most frequent terms with their local counts."""
    return local_counts(df, column, max_terms).where("top").select("term", "cf", "df")


def floor_count(sent: DataFrame, min_df: int, max_terms: int) -> int:
    """``L``: the k-th largest lower bound of occurrences among terms surely in ``min_df`` documents.

    1 when fewer than ``max_terms`` terms qualify (then nothing can be ruled out).
    """
    sums = sent.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    kth = (sums.where(F.col("df") >= min_df).orderBy(F.desc("cf")).limit(max_terms)
           .agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first())
    return int(kth["cf"]) if kth["n"] == max_terms else 1


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(df: DataFrame, column: str, min_df: int, max_terms: int,
               sent_terms: int = SENT_TERMS, site_terms: int = SITE_TERMS) -> DataFrame:
    """``term, df, cf`` of the ``max_terms`` most frequent terms of the arrays in ``column``; see the module."""
    counts = local_counts(df, column, max_terms, site_terms)
    sites = max(1, counts.select("site").distinct().count())
    low = floor_count(counts.where("top"), min_df, max_terms)
    need = math.ceil(low / sites)
    if need <= 1:
        return _eager(textfeat.vocabulary(_added(counts), min_df, max_terms))
    # upper bound: what was sent, plus need - 1 from every site that did not send the term
    upper = F.sum("cf") + (F.lit(sites) - F.count("*")) * (need - 1)
    may = (counts.where(F.col("cf") >= need).groupBy("term").agg(upper.alias("x_upper"))
           .where(F.col("x_upper") >= low).select("term"))
    may = io.written(may, "terms")
    may = F.broadcast(may) if may.count() <= sent_terms else may
    return _eager(textfeat.vocabulary(_added(counts.join(may, "term", "left_semi")), min_df, max_terms))


def _eager(vocab: DataFrame) -> DataFrame:
    """The vocabulary (at most ``max_terms`` rows, bounded by the caller) as a table of its own."""
    return vocab.sparkSession.createDataFrame(vocab.collect(), vocab.schema)
