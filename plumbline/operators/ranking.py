"""Average precision, overall and per key, and its summary over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import known
from plumbline.operators.running import running


def _descending(score: Column) -> Column:
    """Ascending sort key for a descending score; missing scores come last."""
    return -F.coalesce(known(score.cast("double")), F.lit(float("-inf")))


def average_precision(
    df: DataFrame,
    label: str,
    score: str,
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Sum of precision times recall step over the distinct scores of each key.

    Equal scores are one threshold. Rows without a label are left out; a key without a
    positive label has no average precision (NULL).
    """
    keys = list(keys)
    thresholds = (
        df.where(F.col(label).isNotNull())
        .select(*keys, _descending(F.col(score)).alias("_rank"), F.col(label).cast("long").alias("_y"))
        .groupBy(*keys, "_rank")
        .agg(F.sum("_y").alias("_tp"), F.count(F.lit(1)).alias("_n"))
    )
    # Hashing every column keeps all uses of the aggregate identical, so Spark shuffles it once.
    curve = running(
        thresholds,
        keys=keys,
        order=["_rank"],
        sums={"_tp_sum": F.col("_tp"), "_n_sum": F.col("_n")},
        sample_by=thresholds.columns,
        buckets=buckets,
    )
    precision = F.col("_tp_sum") / F.col("_n_sum")
    return curve.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_tp") * precision), F.sum("_tp")).alias("ap"),
        F.sum("_n").alias("n"),
        F.sum("_tp").alias("positives"),
    )


def flag_average_precision(
    df: DataFrame, label: str, flag: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Average precision of a 0/1 score: two thresholds, so one grouped count is enough."""
    keys = list(keys)
    counted = (
        df.where(F.col(label).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(label).cast("long")).alias("positives"),
            F.sum(F.coalesce(F.col(flag).cast("long"), F.lit(0))).alias("flagged"),
            F.sum(
                F.coalesce(F.col(flag).cast("long"), F.lit(0)) * F.col(label).cast("long")
            ).alias("hits"),
        )
    )
    return counted.select(*keys, flag_ap().alias("ap"), "n", "positives", "flagged", "hits")


def flag_ap() -> Column:
    """The two-threshold formula over the counts ``n positives flagged hits``."""
    recall = F.try_divide(F.col("hits"), F.col("positives"))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("flagged")), F.lit(0.0))
    prevalence = F.try_divide(F.col("positives"), F.col("n"))
    return recall * precision + (F.lit(1.0) - recall) * prevalence


def fold_summary(scores: DataFrame, keys: Sequence[str] = (), value: str = "ap") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("mean_score"),
        F.stddev_pop(value).alias("std_score"),
        F.count(value).alias("folds"),
    )


def prevalence(df: DataFrame, label: str) -> DataFrame:
    """Share of positive labels."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("prevalence"))
