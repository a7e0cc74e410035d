"""Running sums and maxima that never sort one whole group in one task.

A plain ordered window puts every row of a group into one task. Here the order is cut into
buckets first. Each bucket's total is a small partial aggregate; a window over those totals
gives what precedes each bucket, and that carry enters the bucket as its first row. Window
groups are then one bucket of one key, however large the key is, and no join is needed.

Bucket edges decide only how the work is spread, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"
_IS_ROW = "_is_row"
_REPEATED = "_repeated"
_OTHERS = "_others"


def default_buckets(df: DataFrame) -> int:
    """A power of two, at least sixteen times the session's shuffle parallelism.

    Several buckets per task even out what hashing buckets to tasks leaves uneven.
    """
    wanted = max(128, 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (wanted - 1).bit_length()


def with_range_bucket(
    df: DataFrame,
    order: Sequence[str],
    sample_by: Sequence[str],
    buckets: int | None = None,
    name: str = _BUCKET,
) -> DataFrame:
    """Tag rows with a bucket number that ascends with ``order``.

    Edges are the order values of the rows whose hash falls below a threshold set by the
    row count: an unbiased sample of about ``buckets`` rows that a recomputed task finds
    again, unlike a random one. Only that sample is brought together.
    """
    size = buckets or default_buckets(df)
    value = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    positive = F.shiftrightunsigned(F.xxhash64(*sample_by), 1)
    # Counting alone reads no columns. But where all of them are hashed, a shuffle lies below
    # that the other uses read whole: asking for the largest hash lets this one share it.
    shared = [F.max(positive)] if set(sample_by) == set(df.columns) else []
    extent = df.agg(F.struct(F.count(F.lit(1)).alias("rows"), *shared)).scalar()
    limit = F.try_divide(F.lit(2.0**63 * size), extent["rows"])
    edges = (
        df.select(value.alias("_edge"), positive.alias("_hash"))
        .where(F.col("_hash") < limit)
        .orderBy("_hash", "_edge")
        .limit(2 * size)
        .agg(F.sort_array(F.collect_list("_edge")).alias("_edges"))
        .scalar()
    )
    tagged = df.withColumns({"_value": value, "_edges": edges, name: F.lit(0)})
    step = 2 * size
    while step:
        passed = F.get("_edges", F.col(name) + F.lit(step - 1)) <= F.col("_value")
        tagged = tagged.withColumn(name, F.col(name) + F.when(passed, step).otherwise(0))
        step //= 2
    return tagged.drop("_value", "_edges")


def running(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    totals: Mapping[str, str] | None = None,
    bucket: Sequence[str] | None = None,
    sample_by: Sequence[str] | None = None,
    buckets: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add running sums and maxima per key, up to and including each row.

    Args:
        order: Ascending order columns, unique within a key.
        sums, maxima: Output name to input expression.
        totals: Output name to the name of a running sum whose whole-key total is wanted.
        bucket: Existing columns that ascend with the order; by default buckets are sampled.
        sample_by: Columns hashed for the sample, by default the keys and the order.
        unique: Fail the job if two rows of a bucket have the same order values.
    """
    sums, maxima, totals = dict(sums or {}), dict(maxima or {}), dict(totals or {})
    keys, order, columns = list(keys), list(order), df.columns
    if bucket is None:
        df = with_range_bucket(df, order, sample_by or [*keys, *order], buckets)
        bucket = [_BUCKET]
    df = df.withColumns({f"_in_{n}": e for n, e in {**sums, **maxima}.items()})

    per_bucket = df.groupBy(*keys, *bucket).agg(
        *[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_in_{n}") for n in maxima],
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(*bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # A key's first bucket has nothing to carry, and a key's only bucket holds its total.
    whole = Window.partitionBy(*keys)
    carry = (
        per_bucket.select(
            *keys,
            *bucket,
            F.lit(False).alias(_IS_ROW),
            *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_in_{n}") for n in sums],
            *[F.max(f"_in_{n}").over(earlier).alias(f"_in_{n}") for n in maxima],
            *[F.sum(f"_in_{source}").over(whole).alias(n) for n, source in totals.items()],
            F.count(F.lit(1)).over(whole if totals else earlier).alias(_OTHERS),
        )
        .where(F.col(_OTHERS) > (1 if totals else 0))
        .drop(_OTHERS)
    )
    in_order = Window.partitionBy(*keys, *bucket).orderBy(_IS_ROW, *order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_bucket = Window.partitionBy(*keys, *bucket)
    repeated = F.lit(False)
    if unique:
        place = F.struct(_IS_ROW, *order)
        repeated = F.coalesce(F.lag(place).over(in_order) == place, F.lit(False))
    return (
        df.withColumn(_IS_ROW, F.lit(True))
        .unionByName(carry, allowMissingColumns=True)
        .select(
            *columns,
            _IS_ROW,
            repeated.alias(_REPEATED),
            *[F.sum(f"_in_{n}").over(so_far).alias(n) for n in sums],
            *[F.max(f"_in_{n}").over(so_far).alias(n) for n in maxima],
            *[
                F.coalesce(F.max(n).over(so_far), F.sum(f"_in_{source}").over(in_bucket)).alias(n)
                for n, source in totals.items()
            ],
        )
        .where(
            F.when(F.col(_REPEATED), F.raise_error(F.lit(f"{order} is not unique")).cast("boolean"))
            .otherwise(F.col(_IS_ROW))
        )
        .drop(_IS_ROW, _REPEATED)
    )
