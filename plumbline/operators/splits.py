"""Reproducible stratified holdouts, folds and samples.

Rows are ordered by class, then by a salted digest of their id, and numbered from zero
across classes. Taking every d-th number gives parts whose sizes, in total and per class,
differ by at most one. The digest depends on nothing but the id, so a row lands in the same
part on any cluster, in any file order. Ids must be unique and not null, also between classes;
anything else fails the job, since the copies of a row could land in different parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import salted_digest
from plumbline.operators.running import default_buckets, running

# The digest's first 60 bits as a number sort faster than its text; the id settles ties.
DIGEST_DIGITS = 15


def _guarded(df: DataFrame, row_id: str) -> DataFrame:
    """Fail the job if an id is missing or stands on several rows, whatever their class."""
    repeats = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("_n"))
    worst = repeats.agg(
        F.struct(F.max("_n").alias("most"), F.max(F.col(row_id).isNull()).alias("missing"))
    ).scalar()
    fault = F.when(F.col("_worst.missing"), f"{row_id} has missing values").when(
        F.col("_worst.most") > 1, f"{row_id} is not unique"
    )
    return (
        df.withColumn("_worst", worst)
        .where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True)))
        .drop("_worst")
    )


def _numbered(df: DataFrame, row_id: str, target: str, salt: str) -> DataFrame:
    """Add ``_g``, numbering rows from zero in the order of class, digest and id.

    The leading bits of the digest are the buckets: uniform by construction, so no class is
    one task's work however large it is.
    """
    bits = default_buckets(df).bit_length() + 1
    head = F.substring(salted_digest(salt, F.col(row_id)), 1, DIGEST_DIGITS)
    digest = _guarded(df, row_id).withColumn("_digest", F.conv(head, 16, 10).cast("long"))
    return (
        running(
            digest.withColumn("_lead", F.shiftright("_digest", 4 * DIGEST_DIGITS - bits)),
            order=["_digest", row_id],
            sums={"_g": F.lit(1)},
            bucket=[target, "_lead"],
        )
        .withColumn("_g", F.col("_g") - 1)
        .drop("_digest", "_lead")
    )


def _times(number: Column, factor: Column | int) -> Column:
    """A product of row numbers in decimals, since 64 bits are soon too few."""
    whole = F.lit(factor) if isinstance(factor, int) else factor
    return number.cast("decimal(19,0)") * whole.cast("decimal(19,0)")


def _held(numerator: int, denominator: int) -> Column:
    return _times(F.col("_g"), numerator) % denominator < numerator


def _held_before(numerator: int, denominator: int) -> Column:
    """Whole part of the share of the row number."""
    product = _times(F.col("_g"), numerator)
    return ((product - product % denominator) / denominator).cast("long")


def _attach(df: DataFrame, parts: DataFrame, row_id: str, target: str) -> DataFrame:
    """Bring split columns to the other columns of the frame, which were not shuffled so far."""
    if set(df.columns) <= {row_id, target}:
        return parts
    return df.join(parts.drop(target), row_id)


def stratified_holdout(
    df: DataFrame,
    row_id: str,
    target: str,
    numerator: int = 1,
    denominator: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Add ``is_holdout``; by default one row in five."""
    number = _numbered(df.select(row_id, target), row_id, target, str(seed))
    held = _held(numerator, denominator).alias("is_holdout")
    return _attach(df, number.select(row_id, target, held), row_id, target)


def stratified_folds(
    df: DataFrame, row_id: str, target: str, folds: int = 5, seed: int = 0
) -> DataFrame:
    """Add ``fold`` from 0 to ``folds - 1``."""
    number = _numbered(df.select(row_id, target), row_id, target, str(seed))
    fold = (F.col("_g") % folds).cast("int").alias("fold")
    return _attach(df, number.select(row_id, target, fold), row_id, target)


def assign_splits(
    df: DataFrame,
    row_id: str,
    target: str,
    folds: int = 5,
    numerator: int = 1,
    denominator: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Add ``is_holdout`` and, on the remaining rows, ``fold``.

    Both come from one numbering: a search row's number, less the holdout rows up to it,
    counts the search rows without gaps. For folds with a seed of their own, call
    :func:`stratified_folds` on the search part.
    """
    number = _numbered(df.select(row_id, target), row_id, target, str(seed))
    held = _held(numerator, denominator)
    held_so_far = _held_before(numerator, denominator) + 1
    fold = F.when(~held, ((F.col("_g") - held_so_far) % folds).cast("int"))
    parts = number.select(row_id, target, held.alias("is_holdout"), fold.alias("fold"))
    return _attach(df, parts, row_id, target)


def stratified_sample(
    df: DataFrame, row_id: str, target: str, size: int, seed: int = 0
) -> DataFrame:
    """Keep exactly ``size`` rows (or all, if fewer), spread evenly over the numbered order."""
    narrow = df.select(row_id, target)
    number = _numbered(narrow, row_id, target, str(seed))
    total = narrow.agg(F.count(F.lit(1))).scalar()
    share = F.least(F.lit(size).cast("long"), total)
    taken = number.where(_times(F.col("_g"), share) % total.cast("decimal(19,0)") < share)
    if set(df.columns) <= {row_id, target}:
        return taken.drop("_g")
    return df.join(taken.select(row_id), row_id, "left_semi")
