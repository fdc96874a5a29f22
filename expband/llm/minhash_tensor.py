"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``bands`` small keys are computed, each key from ``rows`` minhashes. Every pair
of a key of the first and a key of the second collection is a table key: 2 * bands * rows minhashes
serve bands * bands tables of 2 * rows minhashes each, where plain banding would need
2 * rows * bands * bands. Two documents with similarity s miss all tables with a probability of
about 2 * (1 - s ** rows) ** bands: 0.0015 at s = 0.8 and 0.00001 at 0.9 with the defaults.

Documents with equal shingle sets are one node. In each table a node is compared with the least
node of its bucket; links are confirmed on the full sets and give components. Nodes that share a
bucket but not a component with its least node are then compared with the whole bucket, so no
candidate pair between different components is left unconfirmed, and pairs inside a component,
which can't change the result, are never formed.

Defined cases: null and empty texts have an empty set and are linked with nothing; a text of fewer
words than a shingle has one shingle, its whole word sequence; rows with a null doc_id link with
nothing and are kept; rows that repeat a doc_id share its component. Whole texts are read; extra
columns are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from expband.llm import blocks, shared
from expband.llm.components import components


@dataclass(frozen=True)
class Banding:
    words: int = 2        #: words of a shingle
    percent: int = 80     #: least similarity, 100 * intersection / union
    rows: int = 3         #: minhashes of a small key
    bands: int = 10       #: small keys of each of the two collections


def shingle_sets(words: blocks.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, joined, and the rows + 1 offsets."""
    hashes, rows = words.hashes(), len(words.counts)
    starts, key = blocks.windows(hashes, words.first, size)
    row = words.row[starts]
    for k in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        own = hashes[words.first[k]:words.first[k + 1]]
        whole = blocks.mix(np.cumsum(own * blocks.BASE + blocks.GOLDEN)[-1:] + np.uint64(len(own)))
        key, row = np.concatenate((key, whole)), np.concatenate((row, [k]))
    return blocks.distinct_by_row(key, row, rows)


def signatures(df: DataFrame, banding: Banding) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit key of the set) and the small keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_keys = 2 * banding.bands
        factor = blocks.seeds(n_keys * banding.rows, 1) | np.uint64(1)
        shift = blocks.seeds(n_keys * banding.rows, 2)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text"):
                    words = blocks.Words(part.column("text"), lower=True)
                    values, at = shingle_sets(words, banding.words)
                    size = np.diff(at)
                    filled = np.flatnonzero(size)
                    keys = np.zeros((len(size), n_keys), np.uint64)
                    sums = np.zeros((len(size), 2), np.uint64)
                    if len(filled):
                        begin = at[:-1][filled]
                        sums[filled, 0] = np.add.reduceat(values, begin)
                        sums[filled, 1] = np.add.reduceat(blocks.mix(values ^ shift[0]), begin)
                        for k in range(n_keys):
                            key = np.full(len(filled), k + 1, np.uint64)
                            for r in range(k * banding.rows, (k + 1) * banding.rows):
                                x = (values ^ shift[r]) * factor[r]
                                x ^= x >> np.uint64(29)
                                least = np.minimum.reduceat(x * blocks.BASE, begin)
                                key = blocks.mix(key * blocks.BASE + least)
                            keys[filled, k] = key
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(blocks.signed(keys.ravel())), n_keys)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(size.astype(np.int64)),
                         pa.array(blocks.signed(sums[:, 0])), pa.array(blocks.signed(sums[:, 1])),
                         lists.cast(pa.list_(pa.int64()))],
                        names=["doc_id", "n_shingles", "set_a", "set_b", "small_keys"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, small_keys array<bigint>")


def table_keys(nodes: DataFrame, banding: Banding) -> DataFrame:
    """node, key: one row for each pair of small keys, first with second collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = banding.bands, banding.bands ** 2
        with np.errstate(over="ignore"):
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    small = part.column("small_keys").flatten().to_numpy(zero_copy_only=False)
                    small = small.view(np.uint64).reshape(-1, 2 * n)
                    key = blocks.mix(small[:, :n, None] * blocks.BASE + small[:, None, n:]).ravel()
                    node = np.repeat(part.column("node").to_numpy(), m)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(blocks.signed(key))],
                                                     names=["node", "key"])

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "small_keys").mapInArrow(run, f"node {kind}, key bigint")


def confirm(docs: DataFrame, pairs: DataFrame, banding: Banding) -> DataFrame:
    """The pairs a, b whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = shared.matching(docs.select("doc_id", "text"), ids, "doc_id", "left_semi")
    texts = texts.select(F.col("doc_id").alias("id"), "text")
    both = (pairs.join(texts.withColumnRenamed("text", "text_a"), F.col("a") == F.col("id")).drop("id")
            .join(texts.withColumnRenamed("text", "text_b"), F.col("b") == F.col("id")).drop("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text_a"):
                    for start in range(0, part.num_rows, 512):
                        some = part.slice(start, 512)
                        left, at_l = shingle_sets(blocks.Words(some.column("text_a"), lower=True), banding.words)
                        right, at_r = shingle_sets(blocks.Words(some.column("text_b"), lower=True), banding.words)
                        n, m = np.diff(at_l), np.diff(at_r)
                        _, at_u = blocks.distinct_by_row(
                            np.concatenate((left, right)),
                            np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m))), len(n))
                        union = np.diff(at_u)
                        good = pa.array(100 * (n + m - union) >= banding.percent * union)
                        yield pa.RecordBatch.from_arrays([some.column("a").filter(good),
                                                          some.column("b").filter(good)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


#: Counters of the shingle sketch; only the order of shingles depends on them.
SKETCH = 1 << 18


def pairs_by_prefix(docs: DataFrame, apart: DataFrame, banding: Banding) -> DataFrame:
    """Pairs a, b of different components that can be similar enough.

    Two sets of the wanted similarity share one of their first n - ceil(percent * n / 100) + 1
    shingles, whatever the common order of shingles is. Here rare shingles come first, by a sketch of
    fixed size, so that what many texts share doesn't pair them. Where the first shared shingle stands
    at places p and q, no more than the shorter of the rests can be shared; that must be enough too.
    Shingles of one component only, such as those of a large group of copies, are left out first.
    """
    few = apart.count() <= shared.BROADCAST_KEYS
    texts = docs.select("doc_id", "text").join(F.broadcast(apart) if few else apart, "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text"):
                    values, _ = shingle_sets(blocks.Words(part.column("text"), lower=True), banding.words)
                    total += np.bincount((values % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    sums = texts.select("text").mapInArrow(sketch, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(SKETCH, np.int64)
    seen[sums["at"].to_numpy()] = sums["n"].to_numpy()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text"):
                    values, at = shingle_sets(blocks.Words(part.column("text"), lower=True), banding.words)
                    n = np.diff(at)
                    row = np.repeat(np.arange(len(n)), n)
                    order = np.lexsort((values, seen[(values % np.uint64(SKETCH)).astype(np.int64)], row))
                    length = n + (-banding.percent * n // 100) + 1
                    place = np.arange(len(values)) - at[row]
                    keep = place < length[row]
                    row, values, rest = row[keep], values[order][keep], (n[row] - place)[keep]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(blocks.signed(values)), part.column("doc_id").take(take), part.column("comp").take(take),
                         pa.array(n[row].astype(np.int32)), pa.array(rest.astype(np.int32))],
                        names=["shingle", "node", "comp", "n", "rest"])

    kind = apart.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(prefixes, f"shingle bigint, node {kind}, comp {kind}, n int, rest int")
    between = rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    rows = shared.written(rows.join(between, "shingle", "left_semi"), "prefixes")
    other = rows.withColumnsRenamed({c: f"{c}_b" for c in ("node", "comp", "n", "rest")})
    enough = (100 + banding.percent) * F.least("rest", "rest_b") >= banding.percent * (F.col("n") + F.col("n_b"))
    return (rows.join(other, "shingle").filter((F.col("comp") < F.col("comp_b")) & enough)
            .select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    signed = shared.written(signatures(shared.long_texts(docs), banding), "signatures")
    nodes = (signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles")
             .agg(F.min("doc_id").alias("node"), F.first("small_keys").alias("small_keys")))
    nodes = shared.written(nodes, "nodes")
    keys = table_keys(nodes, banding)
    # Buckets with two nodes or more; the aggregate combines map-side, the join can be split.
    buckets = (keys.groupBy(F.col("key").alias("bucket")).agg(F.min("node").alias("least"), F.max("node").alias("most"))
               .filter("least < most").drop("most"))
    members = shared.written(keys.join(buckets, F.col("key") == F.col("bucket"))
                             .select("key", "node", "least"), "members")
    first = shared.written(members.filter("node <> least")
                           .select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = shared.written(confirm(docs, first, banding), "confirmed")
    found = components(links, "a", "b")

    # Second pass: nodes in buckets of more than one component, paired by rare shingles.
    label = F.coalesce("component", "node")
    placed = members.join(found, "node", "left").withColumn("comp", label).drop("component")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    apart = shared.written(placed.join(mixed, "key", "left_semi").select(F.col("node").alias("doc_id"), "comp").distinct(),
                           "apart")
    second = pairs_by_prefix(docs, apart, banding).join(first, ["a", "b"], "left_anti")
    second = shared.written(second, "pairs")
    more = shared.written(confirm(docs, second, banding), "confirmed")
    if not more.isEmpty():
        found = components(links.unionByName(more), "a", "b")

    of_set = nodes.select("set_a", "set_b", "n_shingles", "node").join(found, "node", "left").select(
        "set_a", "set_b", "n_shingles", label.alias("component_id"))
    out = signed.drop("small_keys").join(of_set, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def of_documents(spark: SparkSession, path: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(path).select("doc_id", "text"))


def first_of_each_id(docs: DataFrame) -> DataFrame:
    """One row per doc_id, the one with the least text; rows without an id all stay.

    Ids are counted on their own; only rows with a repeated id are moved.
    """
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = shared.written(repeated, "repeated")
    if repeated.isEmpty():
        return docs
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    once = (shared.matching(docs, repeated, "doc_id", "left_semi").withColumn("_rank", rank)
            .filter("_rank = 1").drop("_rank"))
    return shared.matching(docs, repeated, "doc_id", "left_anti").unionByName(once)
