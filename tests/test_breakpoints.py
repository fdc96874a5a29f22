"""The sweep by breakpoints equals the sweep with one row per row and threshold."""

from pyspark.sql import functions as F

from expband.operators import breakpoints, combine, metrics
from expband.plans import catalog


def _expanded(df, grid):
    return metrics.summary(combine.sweep(df, grid))


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                  for r in df.select(*sorted(df.columns)).collect())


def test_equal_on_7_and_1001_thresholds(spark, sf):
    df = catalog._labelled(spark, sf).withColumn("estimator", F.lit("synthetic")).cache()
    for grid in (combine.THRESHOLDS, tuple(i / 1000 for i in range(1001))):
        assert _rows(breakpoints.sweep_summary(df, grid)) == _rows(_expanded(df, grid))
    df.unpersist()


def test_breakpoint_meaning(spark, sf):
    df = catalog._labelled(spark, sf).limit(200).cache()
    rows = breakpoints.with_breakpoint(df).select("x_b", "label").collect()
    for t in (0.3, 0.55, 0.9):
        unsure = [r.unsure for r in combine.combine(df, t).select("unsure").collect()]
        assert [not (t <= r.x_b) for r in rows] == unsure
    df.unpersist()


def test_empty_input(spark, sf):
    df = catalog._labelled(spark, sf).withColumn("estimator", F.lit("e")).limit(0)
    assert breakpoints.sweep_summary(df).collect() == []
