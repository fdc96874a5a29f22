"""Hybrid combiner: rule hit and class probabilities to one prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RULE_HIGH_CONFIDENCE = 0.90
SMALL_MARGIN = 0.12
AGREEMENT_BONUS = 0.10
THRESHOLDS = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
DEFAULT_THRESHOLD = 0.55


def ranked(proba: Column) -> Column:
    """``struct(p, label)`` from the most to the least likely; ties favour high labels."""
    pairs = F.transform(proba, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("label")))
    return F.sort_array(pairs, asc=False)


def top2(df: DataFrame, proba: str = "proba") -> DataFrame:
    """Add ``model_label``, ``model_conf`` and ``margin``."""
    df = df.withColumn("x_ranked", ranked(F.col(proba)))
    best, second = F.col("x_ranked")[0], F.col("x_ranked")[1]
    return df.withColumns({
        "model_label": best["label"],
        "model_conf": best["p"],
        "margin": best["p"] - second["p"],
    }).drop("x_ranked")


def argmax_low_tie(proba: Column) -> Column:
    """Most likely label; ties favour the low label."""
    return F.array_position(proba, F.array_max(proba)).cast("int")


def combine(df: DataFrame, threshold: Column | float) -> DataFrame:
    """Add ``label, confidence, decided_by, evidence_snippet, evidence_source, unsure``.

    Reads ``title, hit, proba`` and ``executive`` (the title names an executive). The
    threshold may be a column, so that a sweep uses these same expressions.
    """
    if not isinstance(threshold, Column):
        threshold = F.lit(float(threshold))
    return _decided(top2(df), threshold)


def _decided(df: DataFrame, threshold: Column) -> DataFrame:
    """The combiner on rows that have ``model_label, model_conf, margin``."""
    hit, model_label, model_conf = F.col("hit"), F.col("model_label"), F.col("model_conf")
    no_rule = hit.isNull()
    strong = F.coalesce(hit["confidence"] >= RULE_HIGH_CONFIDENCE, F.lit(False))
    agrees = F.coalesce(hit["label"] == model_label, F.lit(False))
    boosted = model_conf + AGREEMENT_BONUS
    small_margin = F.col("margin") < SMALL_MARGIN
    snippet = F.coalesce(hit["evidence_snippet"], F.lit(""))
    df = df.withColumns({
        "x_label": F.when(strong, hit["label"]).otherwise(model_label),
        "x_unsure": (
            F.when(strong, F.abs(hit["label"] - model_label) >= 2)
            .when(no_rule, (model_conf < threshold) | small_margin)
            .when(agrees, (boosted < threshold) & small_margin)
            .otherwise(F.lit(True))),
        "x_by": (F.when(strong, hit["decided_by"])
                 .when(agrees, F.concat(hit["decided_by"], F.lit("+model")))
                 .otherwise(F.lit("model"))),
        "confidence": (F.when(strong, hit["confidence"])
                       .when(agrees, F.least(F.lit(1.0), boosted))
                       .otherwise(model_conf)),
        "x_snippet": snippet,
        "x_source": (F.when(no_rule, F.lit("none"))
                     .when(strong | agrees | (snippet != ""), hit["evidence_source"])
                     .otherwise(F.lit("none"))),
    })
    lifted = (F.col("x_label") == 1) & F.col("executive") & ~strong
    bare = F.col("x_snippet") == ""
    title = F.coalesce(F.col("title"), F.lit(""))
    return df.withColumns({
        "label": F.when(lifted, 4).otherwise(F.col("x_label")),
        "decided_by": F.when(lifted, F.concat("x_by", F.lit("+executive_guardrail")))
        .otherwise(F.col("x_by")),
        "evidence_snippet": F.when(lifted & bare, title).otherwise(F.col("x_snippet")),
        "evidence_source": F.when(lifted & bare, "title").otherwise(F.col("x_source")),
        "unsure": lifted | F.col("x_unsure"),
    }).drop("x_label", "x_unsure", "x_by", "x_snippet", "x_source")


def sweep(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """The combiner at every threshold of a small grid: one row per row and threshold.

    Probabilities are ranked once, and they and the description stay behind.
    """
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    narrow = top2(df).drop("proba", "description")
    return _decided(narrow.withColumn("threshold", F.explode(grid)), F.col("threshold"))
