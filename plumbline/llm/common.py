"""What several operators share: tables, training folds, words and batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space is 0x20 and 0x09-0x0D; a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text falls in the fold; a missing key is never learned from."""
    inside = F.crc32(key.cast("string").cast("binary")) % folds == fold
    return F.coalesce(inside, F.lit(True))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, missing ones as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of one column, or a single row.

    This bounds what a task holds, however long the texts are; nothing is dropped.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        start = total = 0
        for i, n in enumerate(lengths.to_pylist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
