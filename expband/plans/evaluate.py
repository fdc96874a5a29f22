"""Evaluation report of a trained model's estimator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.operators import combine, metrics, models
from expband.plans import train
from expband.plans.artifacts import TrainedModel
from expband.sources import io


def evaluate(labelled: DataFrame, estimator: str, threshold: float,
             n_folds: int = train.CV_FOLDS) -> dict[str, DataFrame]:
    """All report tables, derived from one materialised out-of-fold table."""
    prepared = train.prepare(labelled)
    oof = io.checkpointed(train.out_of_fold(prepared, models.CANDIDATES[estimator], n_folds))
    at = combine.combine(oof.withColumn("threshold", F.lit(float(threshold))),
                         F.col("threshold")).withColumn("estimator", F.lit(estimator))
    ruled = prepared.withColumnRenamed("label", "truth")
    gold, silver = ruled.filter("source = 'gold'"), ruled.filter("source <> 'gold'")
    swept = train.evaluated(oof, combine.THRESHOLDS).withColumn("estimator", F.lit(estimator))
    return {
        "summary": metrics.summary(at),
        "class_report": metrics.class_report(at),
        "confusion": metrics.confusion(at),
        "confusion_kept": metrics.confusion(at.filter("NOT unsure")),
        "rules_gold_by_bucket": metrics.rule_precision_by_bucket(gold),
        "rules_gold_by_rule": metrics.rule_precision_by_rule(gold),
        "rules_silver_by_bucket": metrics.rule_precision_by_bucket(silver),
        "rules_silver_by_rule": metrics.rule_precision_by_rule(silver),
        "distribution_true": metrics.distribution(at, "truth"),
        "distribution_pred": metrics.distribution(at, "label"),
        "sweep": metrics.summary(swept),
    }


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """The evaluation tables as one nested record."""
    def gathered(name: str, order: str) -> DataFrame:
        rows = tables[name]
        return rows.agg(F.array_sort(F.collect_list(F.struct(order, *[
            c for c in rows.columns if c != order]))).alias(name))

    def counts(name: str) -> DataFrame:
        return tables[name].agg(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("label").cast("string"), "n")))).alias(name))
    summary = tables["summary"].select("estimator", "threshold", F.struct("*").alias("summary"))
    cells = F.array(*[F.col(f"pred_{b}") for b in metrics.BANDS])
    matrix = (tables["confusion"].filter("truth <> 'sum'")
              .agg(F.array_sort(F.collect_list(F.struct("truth", cells.alias("row")))).alias("m"))
              .select(F.col("m.row").alias("confusion_matrix")))
    # every part is a single row, keyed alike
    parts = [matrix,
             counts("distribution_true").withColumnRenamed(
                 "distribution_true", "label_distribution_true"),
             counts("distribution_pred").withColumnRenamed(
                 "distribution_pred", "label_distribution_pred"),
             gathered("sweep", "threshold").withColumnRenamed("sweep", "threshold_sweep")]
    out = summary.withColumn("x_one", F.lit(1))
    for part in parts:
        out = out.join(part.withColumn("x_one", F.lit(1)), "x_one")
    return out.drop("x_one")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    report(tables).coalesce(1).write.mode("overwrite").json(path)


def evaluate_files(spark: SparkSession, postings: str, gold: str, silver: str, artifacts: str,
                   target: str, n_folds: int = train.CV_FOLDS) -> dict[str, DataFrame]:
    """Evaluate a saved model's estimator at its threshold, write the report, return all tables."""
    model = TrainedModel.load(spark, artifacts)
    labelled = train.load_labelled(spark, postings, gold, silver)
    tables = evaluate(labelled, model.estimator, model.threshold, n_folds)
    write_report(tables, target)
    return tables
