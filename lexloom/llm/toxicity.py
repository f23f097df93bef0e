"""Toxicity: expected severity from an ordinal regression on sparse text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import ordinal


def toxicity(
    spark: SparkSession, docs: DataFrame, ratings: DataFrame, *, grade: str = "toxic", severe: int = 1, threshold: float = 0.5, fit_rows: int = ordinal.FIT_ROWS,
    screen: float = ordinal.SCREEN, min_df: int = ordinal.MIN_DF,
) -> DataFrame:
    """All columns of ``docs`` with ``toxicity_expected``, ``toxicity_tail`` and ``rejected``.

    Severities may have any number of ordered grades.  ``rejected`` holds where
    ``P(grade >= severe) >= threshold``; without ratings of two grades at least
    the scores are null and nothing is rejected.  An empty text has the base
    rates and repeated rows get equal scores.
    """
    model = ordinal.fit(spark, docs, ratings, grade, fit_rows=fit_rows, screen=screen, min_df=min_df)
    scored = ordinal.score(spark, docs, model, tail_grade=severe, prefix="toxicity")
    return scored.withColumn("rejected", F.coalesce(F.col("toxicity_tail") >= threshold, F.lit(False)))
