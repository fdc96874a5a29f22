"""The threshold sweep without one row per row and threshold.

Of the combiner's outputs only ``unsure`` depends on the threshold, and it can only turn on as the
threshold grows: a row without a rule is unsure once ``t > model_conf``, an agreeing rule with a
small margin once ``t > model_conf + AGREEMENT_BONUS``, every other row is unsure at all
thresholds or at none. So each row has one breakpoint ``b`` (``-inf``: always unsure, ``+inf``:
never) and is kept at ``t`` exactly when ``t <= b``.

The sweep is then one aggregate: rows are grouped by how many grid thresholds lie at or below their
breakpoint (``k``, at most ``len(grid) + 1`` groups per estimator, combined map-side), and the kept
counts at the j-th threshold are running sums over ``k > j``. Cost does not grow with the grid
beyond one comparison per grid value and row; 1,001 thresholds cost what 7 do.

Defined cases: the breakpoint is read off the combiner itself at ``t = -inf`` and ``t = +inf``,
so it can't drift from ``combine``; a row whose ``unsure`` is null at either end counts in ``n``
and the threshold-free rates but, like ``avg`` in ``metrics.summary``, not in the coverage rates;
repeated grid values are swept once; an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expband.operators import combine, metrics

INF = float("inf")


def with_breakpoint(df: DataFrame) -> DataFrame:
    """Add ``label`` (the combiner's, threshold-free) and ``x_b``: the largest threshold still kept."""
    ranked = combine.top2(df)
    low = combine._decided(ranked, F.lit(-INF)).withColumnRenamed("unsure", "x_lo")
    both = combine._decided(low.drop("label", "confidence", "decided_by", "evidence_snippet",
                                     "evidence_source"), F.lit(INF))
    lo, hi = F.col("x_lo"), F.col("unsure")
    b = (F.when(lo.isNull() | hi.isNull(), F.lit(None).cast("double"))
         .when(lo, F.lit(-INF)).when(~hi, F.lit(INF))
         .when(F.col("hit").isNull(), F.col("model_conf"))
         .otherwise(F.col("model_conf") + combine.AGREEMENT_BONUS))
    return both.withColumn("x_b", b).drop("x_lo", "unsure")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def sweep_summary(df: DataFrame, thresholds=combine.THRESHOLDS, by: tuple[str, ...] = ("estimator",)) -> DataFrame:
    """``metrics.summary(combine.sweep(df, thresholds))`` from ``truth, model_pred`` and the combiner's inputs."""
    grid = sorted(set(float(t) for t in thresholds))
    lits = F.array(*[F.lit(t) for t in grid])
    rows = with_breakpoint(df).withColumn("x_k", F.size(F.filter(lits, lambda t: t <= F.col("x_b"))))
    rows = rows.withColumn("x_k", F.when(F.col("x_b").isNotNull(), F.col("x_k")))
    truth, label = F.col("truth"), F.col("label")
    hit = (truth == label).cast("double")
    model_hit = (truth == F.col("model_pred")).cast("double")
    err = F.abs(truth - label).cast("double")
    sums = {"n": F.count("*"), "s_model": F.sum(model_hit), "c_model": F.count(model_hit),
            "s_hit": F.sum(hit), "c_hit": F.count(hit), "s_err": F.sum(err), "c_err": F.count(err)}
    counts = metrics._class_counts("truth", "model_pred", "x_model_") + \
        metrics._class_counts("truth", "label", "x_hybrid_")
    parts = rows.groupBy(*by, "x_k").agg(*[v.alias(k) for k, v in sums.items()], *counts,
                                          F.sum(F.when(F.col("x_b").isNotNull(), hit)).alias("s_kept_hit"))
    names = list(sums) + [f"{p}{kind}{band}" for p in ("x_model_", "x_hybrid_")
                          for band in metrics.BANDS for kind in ("tp", "n", "m")]
    whole = parts.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in names],
        F.collect_list(F.struct("x_k", "n", F.coalesce("s_kept_hit", F.lit(0.0)).alias("h"))).alias("x_parts"))

    def kept_over(j, field):
        chosen = F.filter("x_parts", lambda p: p["x_k"] > j)
        return F.aggregate(chosen, F.lit(0.0), lambda a, p: a + p[field].cast("double"))

    valid = F.aggregate(F.filter("x_parts", lambda p: p["x_k"].isNotNull()), F.lit(0.0),
                        lambda a, p: a + p["n"].cast("double"))
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), kept_over(j, "n").alias("kept"),
                                      kept_over(j, "h").alias("kept_hits")) for j, t in enumerate(grid)]))
    swept = whole.select("*", valid.alias("x_valid"), at.alias("x_at"))
    kept = F.col("x_at.kept")
    return swept.select(
        *by, F.col("x_at.threshold").alias("threshold"), "n",
        _ratio(F.col("s_model"), F.col("c_model")).alias("model_only_accuracy"),
        metrics._macro_f1("x_model_").alias("model_only_macro_f1"),
        _ratio(F.col("s_hit"), F.col("c_hit")).alias("hybrid_accuracy"),
        metrics._macro_f1("x_hybrid_").alias("hybrid_macro_f1"),
        _ratio(F.col("s_err"), F.col("c_err")).alias("hybrid_mae"),
        _ratio(kept, F.col("x_valid")).alias("coverage"),
        F.coalesce(_ratio(F.col("x_at.kept_hits"), kept), F.lit(0.0)).alias("kept_accuracy"),
        _ratio(F.col("x_valid") - kept, F.col("x_valid")).alias("flagged_pct"))
