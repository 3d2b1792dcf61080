"""Fusing the scores of two scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_scores(scores: DataFrame) -> DataFrame:
    """Scores by id; an id that occurs twice fails the job."""
    return scores.groupBy("cluster_id").agg(
        F.when(F.count(F.lit(1)) == 1, F.max("score"))
        .otherwise(
            F.raise_error(F.concat(F.lit("duplicate cluster id: "), F.col("cluster_id")))
            .cast("double")
        )
        .alias("score")
    )


def dedup_last(scores: DataFrame, order_column: str) -> DataFrame:
    """Scores by id; of an id that occurs more than once the last record counts."""
    return scores.groupBy("cluster_id").agg(
        F.max_by("score", order_column).alias("score")
    )


def both_agree(first: Column, second: Column, threshold: float = 0.5) -> Column:
    """Both below or both above; a score on the threshold never agrees."""
    return ((first < threshold) & (second < threshold)) | (
        (first > threshold) & (second > threshold)
    )


def matched(
    primary: DataFrame, secondary: DataFrame, order_column: str | None = None
) -> DataFrame:
    """All primary records with ``second_score``, null where there is none.

    Of a secondary id that repeats the last record by ``order_column`` counts; without an
    order a repeated id fails the job.  So no primary record is multiplied, and one that
    repeats can be split over tasks by the skew handling of the join.
    """
    single = dedup_last(secondary, order_column) if order_column else unique_scores(secondary)
    return primary.join(
        single.select("cluster_id", F.col("score").alias("second_score")),
        "cluster_id",
        "left",
    )


def fuse(
    primary: DataFrame, secondary: DataFrame, order_column: str | None = None
) -> DataFrame:
    """Mean of both scores, or the primary one alone; other fields are kept."""
    fused = F.when(
        F.col("second_score").isNotNull(), 0.5 * (F.col("score") + F.col("second_score"))
    ).otherwise(F.col("score"))
    return (
        matched(primary, secondary, order_column)
        .withColumn("score", fused)
        .select(*primary.columns)
    )


def agreement(
    primary: DataFrame, secondary: DataFrame, order_column: str | None = None
) -> DataFrame:
    """Records in all, records without a partner, partners that agree before fusion."""
    pairs = matched(primary, secondary, order_column)
    return pairs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("second_score").isNull()).alias("missed"),
        F.count_if(both_agree(F.col("score"), F.col("second_score"))).alias("agreed"),
    )
