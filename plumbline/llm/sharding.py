"""Extendible hashing into shards of a bounded number of bytes.

A row's hash is 60 bits of the MD5 of key and text. A bucket is a hash prefix; the bucket of
the empty prefix holds everything. A bucket that is larger than the limit splits on one more
bit, others stay, and the buckets that no longer split are the shards. All candidate buckets
are sums over one narrow table, rolled up from the cells of a fine prefix, so the number of
passes doesn't depend on the number of splits; only where a cell is still too large do its own
rows alone go through another round with more bits.

Defined results: missing keys and texts count as empty; rows that are equal in key and text
share their whole hash and can't be told apart by bits, so a shard of such rows is cut into
numbered pieces that fit; a row larger than the limit is a shard of its own. An empty table has
no shards. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import cut_lineage

LIMIT = 64 << 20
BITS = 60
CELLS_PER_SHARD = 64


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, size in bytes and hash of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digest = F.md5(F.concat(name, F.lit(":"), body).cast("binary"))
    return docs.select(
        F.col(key).alias("key"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"),
    )


def prefix(depth: Column | int) -> Column:
    """The first ``depth`` bits of the hash."""
    shift = F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth)
    return F.call_function("shiftrightunsigned", F.col("hash"), shift.cast("int"))


def buckets(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Sizes of all buckets between two depths, from the cells of the deeper one."""
    deep = F.col("depth")
    return (
        cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        .groupBy("depth", F.call_function("shiftrightunsigned", F.col("cell"), (F.lit(high) - deep).cast("int")).alias("bits"))
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    )


def split_round(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The shards found between two depths with their rows' cells, and the rows that must go deeper."""
    cells = rows.groupBy(prefix(high).alias("cell")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"), F.min("hash").alias("least"), F.max("hash").alias("most")
    )
    cells = cut_lineage(cells, "cells")
    sizes = buckets(cells, low, high)
    splits = (F.col("n_bytes") > limit) & (F.col("least") < F.col("most"))
    # A cell's shard is the first bucket on its path that doesn't split.
    path = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "bits", F.call_function("shiftrightunsigned", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int"))
    )
    stays = sizes.filter(~splits).select("depth", "bits", "n_bytes", "n_rows", "least", "most")
    first = (
        path.join(stays, ["depth", "bits"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "bits", "n_bytes", "n_rows", "least", "most")).alias("shard"))
        .select("cell", F.col("shard.depth").alias("depth"), F.col("shard.bits").alias("bits"), F.col("shard.n_bytes").alias("shard_bytes"), F.col("shard.n_rows").alias("shard_rows"), (F.col("shard.least") == F.col("shard.most")).alias("alike"))
    )
    placed = rows.withColumn("cell", prefix(high)).join(first, "cell", "left")
    return placed.filter(F.col("depth").isNotNull()), placed.filter(F.col("depth").isNull()).select("key", "n_bytes", "hash")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every row's shard: ``key``, ``n_bytes``, ``depth``, ``prefix``, ``piece``, ``shard_bytes``, ``shard_rows``.

    ``depth`` and ``prefix`` are the number and the value of the hash bits that index the shard,
    ``piece`` numbers the parts of a shard of equal rows. ``shard_bytes`` is at most ``limit``
    unless the shard is one row.
    """
    if limit < 1:
        raise ValueError("the limit is at least one byte")
    spark = docs.sparkSession
    rows = cut_lineage(hashed(docs, key, text), "hashes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, found = 0, []
    while True:
        high = min(BITS, low + max(8, (CELLS_PER_SHARD * total // limit).bit_length()))
        placed, rest = split_round(rows, low, high, limit)
        found.append(placed)
        if high == BITS:
            break
        rows = cut_lineage(rest, "deeper")
        total = rows.agg(F.sum("n_bytes")).first()[0] or 0
        if not total:
            break
        low = high
    placed = reduce(DataFrame.unionByName, found)
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    over = F.col("alike") & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    plain = placed.filter(~over).select("key", "n_bytes", "depth", "bits", F.lit(0).cast("long").alias("piece"), "shard_bytes", "shard_rows")
    # Equal rows are counted and dealt out again, so none of them meet in one task's sort.
    cut = (
        placed.filter(over)
        .groupBy("key", "n_bytes", "depth", "bits")
        .agg(F.count("*").alias("copies"))
        .withColumn("fits", fits)
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("piece", F.floor(F.col("i") / F.col("fits")))
        .withColumn("shard_rows", F.least(F.col("fits"), F.col("copies") - F.col("piece") * F.col("fits")))
        .select("key", "n_bytes", "depth", "bits", "piece", (F.col("n_bytes") * F.col("shard_rows")).alias("shard_bytes"), "shard_rows")
    )
    return plain.unionByName(cut).select(
        F.col("key").alias(key), "n_bytes", F.col("depth").cast("long").alias("depth"), F.col("bits").alias("prefix"), "piece", "shard_bytes", "shard_rows"
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of at most 64 MiB of text."""
    return assign_shards(table(spark, sf_dir, "documents"))


def shard_sql(limit: int = LIMIT) -> str:
    """The same rows in DuckDB, for any limit."""
    return f"""
    WITH rows AS (
      SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
      FROM documents),
    path AS (SELECT *, depth, hash >> ({BITS} - depth) AS bits FROM rows, unnest(range({BITS + 1})) AS t(depth)),
    sizes AS (
      SELECT depth, bits, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows, min(hash) = max(hash) AS alike
      FROM path GROUP BY ALL),
    shards AS (
      SELECT p.doc_id, p.hash, p.n_bytes, s.*, row_number() OVER (PARTITION BY p.hash, p.doc_id, s.depth) - 1 AS i
      FROM path p JOIN sizes s USING (depth, bits) WHERE s.shard_bytes <= {limit} OR s.alike),
    placed AS (
      SELECT *, alike AND shard_bytes > {limit} AND shard_rows > 1 AS over, greatest(1, {limit} // greatest(1, n_bytes)) AS fits
      FROM (SELECT *, min(depth) OVER (PARTITION BY hash) AS least FROM shards) WHERE depth = least),
    pieces AS (SELECT *, CASE WHEN over THEN i // fits ELSE 0 END AS piece FROM placed)
    SELECT doc_id, n_bytes::BIGINT AS n_bytes, depth::BIGINT AS depth, bits::BIGINT AS prefix, piece::BIGINT AS piece,
           (CASE WHEN over THEN n_bytes * least(fits, shard_rows - piece * fits) ELSE shard_bytes END)::BIGINT AS shard_bytes,
           (CASE WHEN over THEN least(fits, shard_rows - piece * fits) ELSE shard_rows END)::BIGINT AS shard_rows
    FROM pieces"""
