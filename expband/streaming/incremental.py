"""Incremental scoring of arriving posting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from expband.plans.artifacts import TrainedModel
from expband.plans.score import score
from expband.sources import io


def read_arriving(spark: SparkSession, folder: str, schema: str,
                  files_per_batch: int = 100) -> DataFrame:
    """Posting files as a stream; the schema names the columns in file order.

    A multi-line file is read by one task. Where a batch has fewer files than there are
    cores, its rows are dealt out to all of them, as parsing is a small part of scoring.
    """
    raw = (spark.readStream.schema(schema).options(**io.CSV_OPTIONS)
           .option("maxFilesPerTrigger", files_per_batch).csv(folder))
    cores = spark.sparkContext.defaultParallelism
    return io.resolve_columns(raw if files_per_batch >= cores else raw.repartition(cores))


def score_arriving(postings: DataFrame, model: TrainedModel, target: str, checkpoint: str,
                   only_flagged: bool = False) -> StreamingQuery:
    """Score what has arrived since the last run into a parquet folder, then stop.

    Scoring is narrow and stateless, so the batch expressions run unchanged and the
    file sink with its checkpoint writes every row exactly once.
    """
    predictions = score(postings, model)
    if only_flagged:
        predictions = io.review_queue(predictions)
    return (predictions.writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
