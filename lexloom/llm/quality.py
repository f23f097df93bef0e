"""Quality: expected grade and tail probability from an ordinal regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import ordinal


def quality(
    spark: SparkSession, docs: DataFrame, ratings: DataFrame, *, grade: str = "quality", least_grade: int = 1, threshold: float = 0.5, fit_rows: int = ordinal.FIT_ROWS,
    screen: float = ordinal.SCREEN, min_df: int = ordinal.MIN_DF,
) -> DataFrame:
    """All columns of ``docs`` with ``quality_expected``, ``quality_tail`` and ``selected``.

    Ratings may have any number of ordered grades.  ``selected`` holds where
    ``P(grade >= least_grade) >= threshold``; without ratings of two grades at
    least nothing is known, scores are null and every document is selected.
    An empty text has the base rates; repeated rows get equal scores.
    """
    model = ordinal.fit(spark, docs, ratings, grade, fit_rows=fit_rows, screen=screen, min_df=min_df)
    scored = ordinal.score(spark, docs, model, tail_grade=least_grade, prefix="quality")
    return scored.withColumn("selected", F.coalesce(F.col("quality_tail") >= threshold, F.lit(True)))
