"""The rule functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from expband.functions import rules


def register(spark: SparkSession) -> None:
    """Create ``yoe_band(years)``, ``yoe_mentions(text)`` and ``yoe_hit(title, description)``.

    They are SQL functions over built-in expressions, so the optimizer sees through them.
    """
    mentions = rules.as_scalar(rules.mention_stages("text"), "x_mentions")
    hit = rules.as_scalar(rules.signal_stages() + rules.hit_stages(), "hit")
    for name, arguments, returns, body in (
            ("yoe_band", "years DOUBLE", "INT", rules.years_to_band("years")),
            ("yoe_mentions", "text STRING", rules.MENTION_TYPE, mentions),
            ("yoe_hit", "title STRING, description STRING", rules.HIT_TYPE, hit)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) "
                  f"RETURNS {returns} RETURN {body}")
