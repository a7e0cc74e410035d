"""Standardisation with statistics of the fit part only, for all folds in one scan."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The statistics row that uses the whole search part, for the final fit before the holdout.
WHOLE_SEARCH = -1


def fit_statistics(
    df: DataFrame, features: Sequence[str], target: str, folds: int, fold: str = "fold"
) -> DataFrame:
    """Mean and population deviation per feature over the rows outside each fold.

    One grouped scan gives size, mean and squared deviation per fold. Each fit part then
    combines the other folds' rows pairwise, which loses no digits to cancellation. The
    result has ``folds + 1`` rows keyed by ``scaler_fold``; the last is ``WHOLE_SEARCH``.
    """
    per_fold = (
        df.where(F.col(fold).isNotNull())
        .groupBy(F.col(fold).alias("_fold"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum(F.col(target).cast("long")).alias("_ones"),
            *[F.count(x).alias(f"n_{x}") for x in features],
            *[F.avg(x).alias(f"mean_{x}") for x in features],
            *[(F.var_pop(x) * F.count(x)).alias(f"m2_{x}") for x in features],
        )
    )
    parts = per_fold.withColumn(
        "scaler_fold", F.explode(F.array(*[F.lit(k) for k in range(WHOLE_SEARCH, folds)]))
    ).where(F.col("scaler_fold") != F.col("_fold"))
    fit_part = Window.partitionBy("scaler_fold")
    parts = parts.withColumns(
        {
            f"mu_{x}": F.sum(F.col(f"n_{x}") * F.col(f"mean_{x}")).over(fit_part)
            / F.sum(f"n_{x}").over(fit_part)
            for x in features
        }
    )
    combined = parts.groupBy("scaler_fold").agg(
        F.sum("_rows").alias("fit_rows"),
        F.sum("_ones").alias("fit_ones"),
        *[F.first(f"mu_{x}").alias(f"mu_{x}") for x in features],
        *[
            F.sqrt(
                F.sum(
                    F.col(f"m2_{x}")
                    + F.col(f"n_{x}") * F.pow(F.col(f"mean_{x}") - F.col(f"mu_{x}"), 2)
                )
                / F.sum(f"n_{x}")
            ).alias(f"sd_{x}")
            for x in features
        ],
    )
    return combined


def views(df: DataFrame, part: str, folds: int, fold: str = "fold") -> DataFrame:
    """Rows paired with the fold whose statistics scale them.

    ``validation``: search rows with their own fold. ``fit``: search rows with every other
    fold. ``holdout``: holdout rows with every fold.
    """
    search = F.col(fold).isNotNull()
    if part == "validation":
        return df.where(search).withColumn("scaler_fold", F.col(fold))
    every = F.explode(F.array(*[F.lit(k) for k in range(folds)]))
    if part == "fit":
        return (
            df.where(search)
            .withColumn("scaler_fold", every)
            .where(F.col("scaler_fold") != F.col(fold))
        )
    if part == "holdout":
        return df.where(~search).withColumn("scaler_fold", every)
    raise ValueError(f"unknown part {part!r}")


def standardised(value: Column, mean: Column, deviation: Column) -> Column:
    """``(x - mean) / deviation``; a zero deviation divides by one."""
    return (value - mean) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def balanced_weight(target: Column, fit_rows: Column, fit_ones: Column) -> Column:
    """Class weight over a fit part with the given counts."""
    return fit_rows / (2.0 * F.when(target == 1, fit_ones).otherwise(fit_rows - fit_ones))


def scale(df: DataFrame, statistics: DataFrame, features: Sequence[str]) -> DataFrame:
    """Standardise features with the statistics of each row's ``scaler_fold``.

    The statistics have one row per fold, so sending them to every task is safe.
    """
    scaled = {x: standardised(F.col(x), F.col(f"mu_{x}"), F.col(f"sd_{x}")) for x in features}
    used = [c for x in features for c in (f"mu_{x}", f"sd_{x}")]
    return df.join(F.broadcast(statistics), "scaler_fold").withColumns(scaled).drop(*used)


def with_fit_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Balanced class weight over the fit part, from the counts that :func:`scale` attached."""
    weight = balanced_weight(F.col(target), F.col("fit_rows"), F.col("fit_ones"))
    return df.withColumn(name, weight)


def with_interactions(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the product of every pair of features, without squares or a constant."""
    products = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(features, 2)}
    return df.withColumns(products), [*features, *products]
