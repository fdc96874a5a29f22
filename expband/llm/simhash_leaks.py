"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact check.

Built-in functions only. Texts are lower-cased and split into runs of letters and digits.

1. A window can be similar to an item only if they share a shingle, so windows are laid where a
   document's shingle stands at its place in an item: as long as the item, moved inside the
   document, and as long as the document if that is shorter.
2. Windows and items get a 64-bit SimHash of their words, weighted by length.
3. Fingerprints are cut into four blocks of 16 bits. If two differ in at most ``radius`` bits, some
   block differs in at most radius // 4. Half of these bits are turned on either side: the index holds
   every item under all block values up to half that far, windows look up their own value and those
   the other half away, so an equi-join on block and value finds all items within the radius.
4. Candidates are verified on their shingles: the length of the words in shared shingles over that
   of all shingles of either must reach ``similarity``.

The benchmark is counted first and broadcast up to BROADCAST_ITEMS items; a larger one is joined by
shuffle. Of documents only those with a shared shingle are read a second time.

Defined cases: null and empty texts have no words and match nothing; items with fewer words than a
shingle match nothing; equal items are all reported; rows that repeat a doc_id and text are one
document, different texts under one doc_id are judged together by the best window; rows with a null
doc_id or item_id are left out. Extra columns are not read. Whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.llm import shared

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ITEMS = 20_000
BLOCKS, BLOCK_BITS = 4, 16


@dataclass(frozen=True)
class Radius:
    shingle: int = 5
    similarity: float = 0.8
    bits: int = 23          #: largest Hamming distance of fingerprints


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def _shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of the runs of ``size`` words, in order; empty for fewer words."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _shingles(words: Column, size: int) -> Column:
    """Distinct shingles as (text, weight); the weight is the length of its words."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(
        F.array().cast("array<int>"))
    text = F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
    return F.transform(F.array_distinct(text), lambda s: F.struct(
        s.alias("text"), (F.length(s) - (size - 1)).alias("weight")))


def fenced(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a one-row generator, so that it is computed once and never inlined into
    the lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _weighted_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("hash"), F.length(w).alias("weight")))


def fingerprint(hashed: Column) -> Column:
    """64-bit SimHash of (hash, weight): bit b is set if the words with that bit outweigh the rest."""

    def bit(b: Column) -> Column:
        balance = F.aggregate(hashed, F.lit(0), lambda acc, w: acc + F.when(
            F.getbit(w["hash"], b) == 1, w["weight"]).otherwise(-w["weight"]))
        return F.when(balance > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(
            F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"),
                       lambda acc, x: acc.bitwiseOR(x))


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0), lambda acc, s: acc + s["weight"])


def _block(print_: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", print_, (block * BLOCK_BITS).cast("int")).bitwiseAND(
        F.lit(2 ** BLOCK_BITS - 1).cast("long"))


def leaks(docs: DataFrame, benchmark: DataFrame, limits: Radius = Radius()) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance, similarity: the best window of each leak."""
    size = limits.shingle
    items = fenced(benchmark.filter("item_id IS NOT NULL").select("item_id", "text"), "words", words_of(F.col("text")))
    items = fenced(items.filter(F.size("words") >= size).select("item_id", "words").distinct(),
                   "weighted", _weighted_words(F.col("words")))
    items = shared.written(items.select(
        "item_id", F.size("words").alias("item_size"), _shingle_hashes(F.col("words"), size).alias("hashes"),
        _shingles(F.col("words"), size).alias("item_shingles"),
        fingerprint(F.col("weighted")).alias("item_print")), "items")
    few = items.count() <= BROADCAST_ITEMS
    side = F.broadcast if few else (lambda df: df)

    # Places of shared shingles: where windows of an item's size are laid.
    known = items.select("item_size", F.posexplode("hashes").alias("at", "hash")).distinct()
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    split = fenced(texts, "words", words_of(F.col("text"))).select("doc_id", "words")
    found = (split.select("doc_id", F.size("words").alias("n_doc"),
                          F.posexplode(_shingle_hashes(F.col("words"), size)).alias("place", "hash"))
             .join(side(known), "hash"))
    length = F.least("item_size", "n_doc")
    first = F.greatest(F.lit(0), F.least(F.col("place") - F.col("at"), F.col("n_doc") - length))
    laid = found.select("doc_id", "n_doc", first.alias("first_word"), length.alias("n_words")).distinct()
    laid = shared.written(laid.groupBy("doc_id", "n_doc").agg(
        F.collect_list(F.struct("first_word", "n_words")).alias("windows")), "windows")

    # Their fingerprints and shingles, from the documents that have one.
    touched = shared.matching(texts, laid, "doc_id", "left_semi").distinct()
    windows = (fenced(touched, "words", words_of(F.col("text"))).select("doc_id", "words")
               .withColumn("n_doc", F.size("words")).join(laid, ["doc_id", "n_doc"])
               .select("doc_id", "words", F.explode("windows").alias("w")))
    windows = fenced(windows.select("doc_id", "w.first_word", "w.n_words", "words"), "own",
                     F.expr("slice(words, first_word + 1, n_words)")).drop("words")
    windows = fenced(windows, "weighted", _weighted_words(F.col("own"))).select(
        "doc_id", "first_word", "n_words", fingerprint(F.col("weighted")).alias("print"),
        _shingles(F.col("own"), size).alias("shingles"))
    windows = shared.written(windows, "fingerprints")

    # Multi-index Hamming search: items under every block value near their own.
    wide = limits.bits // BLOCKS
    half = (wide + 1) // 2
    near = F.explode(F.array(*[F.lit(m) for m in range(2 ** BLOCK_BITS) if m.bit_count() <= half]))
    far = F.explode(F.array(*[F.lit(m) for m in range(2 ** BLOCK_BITS) if m.bit_count() in (0, wide - half)]))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    index = (items.select("item_id", "item_print", blocks)
             .select("item_id", "item_print", "block", _block(F.col("item_print"), F.col("block")).alias("own"),
                     near.alias("mask"))
             .select("item_id", "item_print", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    candidates = (windows.select("doc_id", "first_word", "n_words", "print").distinct()
                  .select("*", blocks).select("*", far.alias("turned"))
                  .withColumn("value", _block(F.col("print"), F.col("block")).bitwiseXOR(F.col("turned")))
                  .join(index, ["block", "value"])
                  .filter((F.col("turned") == 0) | (F.bit_count(_block(
                      F.col("print").bitwiseXOR(F.col("item_print")), F.col("block"))) > half))
                  .withColumn("distance", distance).filter(F.col("distance") <= limits.bits)
                  .select("doc_id", "first_word", "n_words", "item_id", "distance").distinct())

    # Exact similarity of the candidates.
    shared_weight = _weight(F.array_intersect("shingles", "item_shingles"))
    total = _weight("shingles") + _weight("item_shingles") - shared_weight
    verified = (candidates.join(windows, ["doc_id", "first_word", "n_words"])
                .join(side(items.select("item_id", "item_shingles")), "item_id")
                .withColumn("similarity", shared_weight / total)
                .filter(F.col("similarity") >= limits.similarity))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n_words",
                          (-F.col("distance")).alias("near"))).alias("best")
    return verified.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("first_word"), F.col("best.n_words").alias("n_words"),
        (-F.col("best.near")).alias("distance"), F.round("best.similarity", 6).alias("similarity"))


def of_documents(spark: SparkSession, docs_path: str, benchmark_path: str) -> DataFrame:
    return leaks(spark.read.parquet(docs_path).select("doc_id", "text"),
                 spark.read.parquet(benchmark_path).select("item_id", "text"))
