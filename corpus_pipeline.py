"""From raw documents to token ids: five stages, each on all that the stage before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``, with ``text`` and ``n_chars`` as the stage has left them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.llm import line_rules, minhash_tensor, piece_codec, shared, simhash_leaks, substring_dedup

#: SQL can't express the piece encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def _with_text(df: DataFrame, columns: list[str], changed: Column, text: Column) -> DataFrame:
    """The given columns, with a new text and its length where it has changed."""
    fresh = {"text": F.when(changed, text).otherwise(F.col("text")),
             "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return df.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop failing lines; documents that the rules reject go."""
    judged = line_rules.clean_lines(docs, "text").filter("quality.kept")
    return _with_text(judged, docs.columns, F.col("quality.n_failed_lines") > 0, F.col("quality.cleaned"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least doc_id."""
    gone = minhash_tensor.near_duplicates(docs).filter("NOT kept")
    return minhash_tensor.first_of_each_id(shared.matching(docs, gone, "doc_id", "left_anti"))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; so do documents that have no word left."""
    cut = substring_dedup.remove_repeats(docs).filter("n_removed = 0 OR n_removed < n_words")
    return _with_text(cut, docs.columns, F.col("n_removed") > 0, F.col("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = simhash_leaks.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return shared.matching(docs, found, "doc_id", "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digests of ids and of the text decoded from them."""
    coded = piece_codec.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), "text",
                                          piece_codec.default_model())
    ids = coded.withColumn("ids", F.col("piece_ids"))
    return piece_codec.digests(ids)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return docs
