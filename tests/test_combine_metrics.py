"""Combiner branches, evaluation aggregates and the published reference numbers."""

import itertools

import pytest
from pyspark.sql import functions as F

from expband.operators import combine, metrics

# Published results: confusion matrix, candidate scores and threshold sweep.
CONFUSION = [[48, 0, 0, 0], [4, 15, 5, 0], [0, 2, 18, 1], [0, 0, 1, 6]]
CANDIDATE_F1 = [("logreg_C0.5", 0.837212543554007), ("logreg_C1.0", 0.8166990226268577),
                ("logreg_C2.0", 0.8166990226268577), ("linsvc_C0.5", 0.7890151515151516),
                ("linsvc_C1.0", 0.7890151515151516), ("boosted_trees", 0.7916864003259236)]
SWEEP = [(0.40, 0.91, 0.8571428571428571), (0.45, 0.90, 0.8666666666666667),
         (0.50, 0.89, 0.8764044943820225), (0.55, 0.88, 0.8863636363636364),
         (0.60, 0.83, 0.891566265060241), (0.65, 0.77, 0.8961038961038961),
         (0.70, 0.67, 0.8955223880597015)]

HIT = ("struct<label: int, confidence: double, decided_by: string, evidence_snippet: string, "
       "evidence_source: string>")


def expected(hit, proba, title, executive, threshold):
    """Branch by branch, in plain Python."""
    ranked = sorted(((p, i + 1) for i, p in enumerate(proba)), reverse=True)
    (conf, model), margin = ranked[0], ranked[0][0] - ranked[1][0]
    strong = hit is not None and hit[1] >= 0.9
    snippet, source = (hit[3], hit[4]) if hit else ("", "none")
    if strong:
        out = [hit[0], hit[1], hit[2], abs(hit[0] - model) >= 2]
    elif hit is None:
        out = [model, conf, "model", conf < threshold or margin < 0.12]
    elif hit[0] == model:
        up = min(1.0, conf + 0.10)
        out = [model, up, hit[2] + "+model", up < threshold and margin < 0.12]
    else:
        out = [model, conf, "model", True]
        source = source if snippet else "none"
    if out[0] == 1 and executive and not strong:
        out = [4, out[1], out[2] + "+executive_guardrail", True]
        if not snippet:
            snippet, source = title, "title"
    return (out[0], pytest.approx(out[1]), out[2], snippet, source, out[3])


def test_combiner_equals_plain_branches(spark):
    probas = [[.25, .25, .25, .25], [.4, .35, .15, .1], [.6, .2, .1, .1], [.1, .1, .2, .6],
              [.97, .01, .01, .01], [.3, .4, .2, .1], [.44, .42, .1, .04]]
    cases = [None] + [(label, conf, "r", snip, "title") for label, conf, snip in
                      itertools.product((1, 2, 4), (0.95, 0.9, 0.65), ("s", ""))]
    rows = [(i, "CEO", e, p, h) for i, (p, h, e) in enumerate(
        itertools.product(probas, cases, (True, False)))]
    df = spark.createDataFrame(
        rows, f"id int, title string, executive boolean, proba array<double>, hit {HIT}")
    for threshold in (0.40, 0.55, 0.70):
        got = combine.combine(df, threshold).select(
            "id", "label", "confidence", "decided_by", "evidence_snippet", "evidence_source",
            "unsure").collect()
        for r in got:
            _, title, executive, proba, hit = rows[r.id]
            assert tuple(r)[1:] == expected(hit, proba, title, executive, threshold)


def test_tie_directions(spark):
    df = spark.createDataFrame([([.25, .25, .25, .25],)], "proba array<double>")
    r = combine.top2(df).withColumn("low", combine.argmax_low_tie(F.col("proba"))).first()
    assert (r.model_label, r.margin, r.low) == (4, 0.0, 1)


def test_flagged_share_never_falls_with_the_threshold(spark):
    df = spark.range(200).select(
        F.lit("x").alias("title"), F.lit(False).alias("executive"),
        F.expr("array((id % 10) / 10D, 1 - (id % 10) / 10D, 0D, 0D)").alias("proba"),
        F.lit(None).cast(HIT).alias("hit"))
    shares = [r.f for r in combine.sweep(df).groupBy("threshold").agg(
        F.avg(F.col("unsure").cast("int")).alias("f")).orderBy("threshold").collect()]
    assert shares == sorted(shares) and len(shares) == 7


def golden(spark):
    rows = [(t + 1, p + 1) for t in range(4) for p in range(4) for _ in range(CONFUSION[t][p])]
    return spark.createDataFrame(rows, "truth int, label int").withColumns({
        "model_pred": F.col("label"), "unsure": F.lit(False), "estimator": F.lit("x"),
        "threshold": F.lit(0.55)})


def test_published_metrics_follow_from_the_confusion_matrix(spark):
    df = golden(spark)
    s = metrics.summary(df).first()
    assert s.n == 100
    assert s.hybrid_accuracy == pytest.approx(0.87)
    assert s.hybrid_macro_f1 == pytest.approx(0.837212543554007, abs=1e-12)
    assert s.hybrid_mae == pytest.approx(0.13)
    table = {r.truth: [r.pred_1, r.pred_2, r.pred_3, r.pred_4, r.total]
             for r in metrics.confusion(df).collect()}
    assert [table[str(b)][:4] for b in metrics.BANDS] == CONFUSION
    assert table["sum"] == [52, 17, 24, 7, 100]
    report = {r.row: r for r in metrics.class_report(df).collect()}
    assert [round(report[str(b)].f1, 4) for b in metrics.BANDS] == [0.96, 0.7317, 0.8, 0.8571]
    assert report["macro avg"].f1 == pytest.approx(s.hybrid_macro_f1)
    truth = {r.label: r.n for r in metrics.distribution(df, "truth").collect()}
    assert truth == {1: 48, 2: 24, 3: 21, 4: 7}


def test_published_winner_and_threshold(spark):
    c = spark.createDataFrame(CANDIDATE_F1, "estimator string, hybrid_macro_f1 double")
    order = F.array_position(F.array(*[F.lit(n) for n, _ in CANDIDATE_F1]), F.col("estimator"))
    assert metrics.choose_winner(c, order).first().estimator == "logreg_C0.5"
    s = spark.createDataFrame([(t, c, k, 1 - c) for t, c, k in SWEEP],
                              "threshold double, coverage double, kept_accuracy double, flagged_pct double")
    assert metrics.choose_threshold(s).first().threshold == 0.55
    for kept, flagged, want in ((0.96, 0.2, 0.40), (0.91, 0.35, 0.40)):
        better = s.withColumns({"kept_accuracy": F.lit(kept), "flagged_pct": F.lit(flagged)})
        assert metrics.choose_threshold(better).first().threshold == want


def test_empty_and_single_class_summaries(spark):
    df = golden(spark).filter("truth = 1").withColumn("unsure", F.lit(True))
    s = metrics.summary(df).first()
    assert (s.kept_accuracy, s.coverage, s.hybrid_macro_f1) == (0.0, 0.0, 1.0)
