"""Reading the raw sensor table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.schemas import RAW_TYPES, REQUIRED_COLUMNS, SHORT_NAMES

LINE = "_line"


def require_columns(present: Iterable[str], required: Iterable[str] = REQUIRED_COLUMNS) -> None:
    """Raise with the sorted missing names if a required column is absent."""
    missing = sorted(set(required) - set(present))
    if missing:
        raise ValueError(f"table is missing columns: {missing}")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """All rows; ``_line`` holds the text of those that don't fit the types or the header.

    The header is read on its own first: a given schema would otherwise hide absent names. The
    header of every further file is compared with it when that file is read, names and order,
    and a difference fails the job. Columns beyond the known ones come as strings.
    """
    header = spark.read.option("header", True).csv(path).columns
    require_columns(header)
    fields = [T.StructField(n, RAW_TYPES.get(n, T.StringType())) for n in header]
    rows = (
        spark.read.schema(T.StructType([*fields, T.StructField(LINE, T.StringType())]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", LINE)
        .csv(path)
    )
    # Spark checks only the cells that a query reads, so this always reads all of them.
    return rows.where(F.xxhash64(*[F.col(f"`{n}`") for n in header]) >= F.lit(-(2**63)))


def read_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a headed CSV with explicit types.

    A cell of another type, a line with more or fewer cells and a file with another header fail
    the job; an empty cell is a missing value.
    """
    rows = _read(spark, path)
    wrong = F.concat(F.lit("not a row of the table: "), F.col(LINE))
    fine = F.when(F.col(LINE).isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))
    return rows.where(fine).drop(LINE)


def sensor_rows_and_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows that :func:`read_sensor_csv` would return, and ``file, line`` of the others."""
    rows = _read(spark, path)
    rejects = rows.where(F.col(LINE).isNotNull())
    return rows.where(F.col(LINE).isNull()).drop(LINE), rejects.select(
        F.col("_metadata.file_name").alias("file"), F.col(LINE).alias("line")
    )


def short_names(df: DataFrame) -> DataFrame:
    """Names without blanks and brackets."""
    return df.withColumnsRenamed(SHORT_NAMES)
