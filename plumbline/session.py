"""Session helpers: a local session for tests and bench, and tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "plumbline", **conf: str) -> SparkSession:
    """A local session; on a cluster the session comes from spark-submit instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by the driver and all executors.

    It is the one the cluster names in ``spark.checkpoint.dir``; where that is unset, a folder
    inside the warehouse, which every executor reaches as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/plumbline-work"


def file_system(spark: SparkSession, path: str):
    """A path as Hadoop sees it, and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_exists(spark: SparkSession, path: str) -> bool:
    target, files = file_system(spark, path)
    return files.exists(target)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables by the paths that ``written_table`` gave."""
    for path in paths:
        target, files = file_system(spark, path)
        files.delete(target, True)


def written_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a written Parquet table, read back, and its path.

    Later jobs read files instead of repeating the work, and an executor that is lost takes
    nothing with it. Schema, column pruning and statistics survive, unlike with a checkpoint.
    """
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table in the shared folder."""
    return written_table(df, name)[0]
