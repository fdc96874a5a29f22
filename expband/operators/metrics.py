"""Evaluation aggregates, and the selection of candidate and threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = (1, 2, 3, 4)


def _tally(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _class_counts(truth: str, pred: str, prefix: str) -> list[Column]:
    """True positives, support and predicted count of every band."""
    t, p = F.col(truth), F.col(pred)
    out = []
    for band in BANDS:
        out += [_tally((t == band) & (p == band)).alias(f"{prefix}tp{band}"),
                _tally(t == band).alias(f"{prefix}n{band}"),
                _tally(p == band).alias(f"{prefix}m{band}")]
    return out


def _macro_f1(prefix: str) -> Column:
    """Mean F1 over the bands seen in truth or prediction."""
    sizes = [F.col(f"{prefix}n{b}") + F.col(f"{prefix}m{b}") for b in BANDS]
    scores = [F.when(s > 0, 2 * F.col(f"{prefix}tp{b}") / s).otherwise(0.0)
              for b, s in zip(BANDS, sizes)]
    seen = [F.when(s > 0, 1).otherwise(0) for s in sizes]
    return reduce(Column.__add__, scores) / reduce(Column.__add__, seen)


def macro_f1(df: DataFrame, by: list[str], truth: str = "truth", pred: str = "label") -> DataFrame:
    counts = df.groupBy(*by).agg(*_class_counts(truth, pred, "x_"))
    return counts.select(*by, _macro_f1("x_").alias("macro_f1"))


def summary(df: DataFrame, by: tuple[str, ...] = ("estimator", "threshold")) -> DataFrame:
    """One record per group, from ``truth, model_pred, label, unsure``; one pass.

    Fixed values: the names of the fields.
    """
    truth, label, kept = F.col("truth"), F.col("label"), ~F.col("unsure")
    hit = (truth == label).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((truth == F.col("model_pred")).cast("double")).alias("model_only_accuracy"),
        F.avg(hit).alias("hybrid_accuracy"),
        F.avg(F.abs(truth - label).cast("double")).alias("hybrid_mae"),
        F.avg(kept.cast("double")).alias("coverage"),
        F.coalesce(F.avg(F.when(kept, hit)), F.lit(0.0)).alias("kept_accuracy"),
        F.avg(F.col("unsure").cast("double")).alias("flagged_pct"),
        *_class_counts("truth", "model_pred", "x_model_"),
        *_class_counts("truth", "label", "x_hybrid_"),
    ).select(
        *by, "n", "model_only_accuracy", _macro_f1("x_model_").alias("model_only_macro_f1"),
        "hybrid_accuracy", _macro_f1("x_hybrid_").alias("hybrid_macro_f1"), "hybrid_mae",
        "coverage", "kept_accuracy", "flagged_pct",
    )


def confusion(df: DataFrame, truth: str = "truth", pred: str = "label") -> DataFrame:
    """4 x 4 counts with zero cells, row sums, and a last row of column sums; one aggregate."""
    t, p = F.col(truth), F.col(pred)
    counts = df.groupBy().agg(*[_tally((t == a) & (p == b)).alias(f"n{a}{b}") for a in BANDS for b in BANDS])

    def row(name: str, cells: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("truth"),
                        *[c.alias(f"pred_{b}") for b, c in zip(BANDS, cells)],
                        reduce(Column.__add__, cells).alias("total"))
    rows = [row(str(a), [F.col(f"n{a}{b}") for b in BANDS]) for a in BANDS]
    sums = row("sum", [reduce(Column.__add__, [F.col(f"n{a}{b}") for a in BANDS]) for b in BANDS])
    return counts.select(F.inline(F.array(*rows, sums)))


def class_report(df: DataFrame, truth: str = "truth", pred: str = "label") -> DataFrame:
    """Precision, recall, F1 and support by band, then accuracy, macro and weighted means.

    One aggregate gives a single row; all lines are arithmetic on it.
    """
    counts = df.groupBy().agg(*_class_counts(truth, pred, ""))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    def total(columns: list[Column]) -> Column:
        return reduce(Column.__add__, columns)
    tp, n, m = ([F.col(f"{x}{b}") for b in BANDS] for x in ("tp", "n", "m"))
    scores = {"precision": [ratio(x, y) for x, y in zip(tp, m)],
              "recall": [ratio(x, y) for x, y in zip(tp, n)],
              "f1": [ratio(2 * x, y + z) for x, y, z in zip(tp, n, m)]}

    def line(name: str, values: list[Column], support: Column) -> Column:
        return F.struct(F.lit(name).alias("row"), *[v.alias(c) for c, v in zip(scores, values)],
                        support.alias("support"))
    lines = [line(str(b), [s[i] for s in scores.values()], n[i]) for i, b in enumerate(BANDS)]
    lines += [line("accuracy", [total(tp) / total(n)] * 3, total(n)),
              line("macro avg", [total(s) / len(BANDS) for s in scores.values()], total(n)),
              line("weighted avg", [total([v * k / total(n) for v, k in zip(s, n)]) for s in scores.values()],
                   total(n))]
    return counts.select(F.inline(F.array(*lines)))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))


def rule_precision(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Fired count, correct count and precision of the rules alone, most fired first.

    Reads ``hit`` and ``truth``; ``fired_share`` is relative to all rows.
    """
    fired = F.col("hit").isNotNull()
    counts = (df.groupBy(F.when(fired, by).alias(name))
              .agg(F.count("*").alias("rows"), _tally(fired).alias("fired"),
                   _tally(fired & (F.col("hit.label") == F.col("truth"))).alias("correct")))
    # one row per rule from here on
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return (counts.withColumn("total", total).filter(F.col("fired") > 0)
            .select(name, "fired", "correct", (F.col("correct") / F.col("fired")).alias("precision"),
                    (F.col("fired") / F.col("total")).alias("fired_share"))
            .orderBy(F.desc("fired"), name))


def rule_precision_by_bucket(df: DataFrame) -> DataFrame:
    """The names of the two buckets."""
    high = F.col("hit.confidence") >= 0.9
    return rule_precision(df, F.when(high, "high (>=0.9)").otherwise("low (<0.9)"), "bucket")


def rule_precision_by_rule(df: DataFrame) -> DataFrame:
    return rule_precision(df, F.col("hit.decided_by"), "decided_by")


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """The smallest threshold that keeps accuracy, else the best trade-off.

    First tier: kept accuracy >= 0.95 and flagged <= 0.30; second: >= 0.90 and <= 0.40;
    else the largest kept accuracy times root of coverage (lowest threshold on ties).
    """
    kept, flagged = F.col("kept_accuracy"), F.col("flagged_pct")
    tier = (F.when((kept >= 0.95) & (flagged <= 0.30), 1)
            .when((kept >= 0.90) & (flagged <= 0.40), 2).otherwise(3))
    trade = F.when(tier == 3, -kept * F.sqrt("coverage")).otherwise(0.0)
    return (sweep.withColumns({"x_tier": tier, "x_trade": trade})
            .orderBy("x_tier", "x_trade", "threshold").limit(1).drop("x_tier", "x_trade"))


def choose_winner(summaries: DataFrame, order: Column) -> DataFrame:
    """The candidate with the best hybrid macro-F1; registry order decides ties."""
    return (summaries.withColumn("x_order", order)
            .orderBy(F.desc("hybrid_macro_f1"), "x_order").limit(1).drop("x_order"))
