"""Feature table, target and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CATEGORIES = 1000


def category_values(df: DataFrame, category: str, most: int = MAX_CATEGORIES) -> list[str]:
    """Sorted distinct values of a column, refused beyond ``most``: each becomes a column."""
    found = (
        df.select(category)
        .where(F.col(category).isNotNull())
        .distinct()
        .limit(most + 1)
        .collect()
    )
    if len(found) > most:
        raise ValueError(f"{category} has more than {most} values")
    return sorted(row[0] for row in found)


def make_features(
    df: DataFrame,
    row_id: str,
    numeric: Sequence[str],
    category: str,
    prefix: str = "type",
    categories: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Numeric columns as doubles and one 0/1 double per category; nothing else but ``keep``.

    Without ``categories`` they are taken from the whole frame, before any split. A missing
    or unlisted category is 0 in every column.
    """
    values = category_values(df, category) if categories is None else categories
    return df.select(
        row_id,
        *[F.col(name).cast("double").alias(name) for name in numeric],
        *[
            F.coalesce((F.col(category) == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}")
            for v in values
        ],
        *keep,
    )


def make_target(df: DataFrame, target: str) -> DataFrame:
    """Cast the target to int; a missing one fails the job."""
    value = F.col(target).cast("int")
    missing = F.raise_error(F.lit(f"{target} has missing values")).cast("int")
    return df.withColumn(target, F.when(value.isNull(), missing).otherwise(value))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def with_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Weight ``n / (2 * rows of the class)``, so that both classes weigh the same in total."""
    counts = df.agg(
        F.struct(
            F.count(target).alias("n"),
            F.sum(F.col(target).cast("long")).alias("ones"),
        ).alias("counts")
    ).scalar()
    return (
        df.withColumn("_counts", counts)
        .withColumn(
            name,
            F.col("_counts.n")
            / (
                2.0
                * F.when(F.col(target) == 1, F.col("_counts.ones")).when(
                    F.col(target) == 0, F.col("_counts.n") - F.col("_counts.ones")
                )
            ),
        )
        .drop("_counts")
    )
