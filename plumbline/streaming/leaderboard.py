"""Leaderboard over a folder of logs to which batches are still being committed.

The stream follows the commit files, not the data: a batch counts from its commit on, whole, and
one that never gets there doesn't. Its checkpoint remembers the commits it has seen, so a batch
counts once. The board is one row per log, written whole for each step of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import known
from plumbline.session import file_exists
from plumbline.sources.commits import COMMIT, commits, live_folders, read_folders
from plumbline.sources.trial_logs import records_only

BOARD = "log string, n long, best_score double, best_index long"


def board_of(records: DataFrame) -> DataFrame:
    """Records, best score and its index per log; the earliest of equal scores."""
    score = known(F.col("mean_score"))
    best = F.max_by(F.struct(score.alias("s"), "trial_index"), F.struct(score, -F.col("trial_index")))
    return (
        records.groupBy("log")
        .agg(F.count(F.lit(1)).alias("n"), best.alias("b"))
        .select("log", "n", F.col("b.s").alias("best_score"), F.col("b.trial_index").alias("best_index"))
    )


def merged(boards: DataFrame) -> DataFrame:
    """Boards of different records of the same logs as one."""
    best = F.max_by(F.struct("best_score", "best_index"), F.struct("best_score", -F.col("best_index")))
    return (
        boards.groupBy("log")
        .agg(F.sum("n").alias("n"), best.alias("b"))
        .select("log", "n", "b.best_score", "b.best_index")
    )


def latest_board(spark: SparkSession, board: str, before: int | None = None) -> DataFrame:
    """The board as the last step (before a given one) left it."""
    if not file_exists(spark, board):
        return spark.createDataFrame([], BOARD)
    versions = spark.read.schema(f"{BOARD}, version long").parquet(board)
    if before is not None:
        versions = versions.where(F.col("version") < before)
    newest = versions.agg(F.max("version").alias("v"))
    return versions.where(F.col("version") == newest.scalar()).drop("version")


def follow(spark: SparkSession, folder: str, state: str, board: str):
    """Start a stream that brings ``board`` up to the commits of ``folder`` and then stops.

    A step reads only the folders of its own batches and adds them to the board before it; logs
    that a batch has replaced are counted anew. Repeating a step writes the same version again.
    """

    def step(rows: DataFrame, version: int) -> None:
        # A row for each batch that arrived since the last step, not for its records.
        new = sorted((r.asDict() for r in rows.collect()), key=lambda c: (c["sequence"], c["batch"]))
        before = latest_board(spark, board, version)
        gone = sorted({log for c in new if c["replaces"] for log in c["logs"]})
        every = [c for c in commits(spark, folder) if c["sequence"] <= new[-1]["sequence"]] if gone else []
        anew = [path for path in live_folders(every) if path.partition("/")[2] in gone]
        added = [f"{c['folder']}/{log}" for c in new for log in c["logs"] if log not in gone]
        names = [log.partition("=")[2] for log in gone]
        fresh = board_of(records_only(read_folders(spark, folder, "log", anew + added)))
        whole = merged(before.where(~F.col("log").isin(*names) if names else F.lit(True)).unionByName(fresh))
        whole.write.mode("overwrite").parquet(f"{board}/version={version}")

    arrived = spark.readStream.schema(COMMIT).json(f"{folder}/commits")
    return (
        arrived.writeStream.foreachBatch(step)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def live_leaderboard(spark: SparkSession, folder: str, state: str, board: str) -> DataFrame:
    """Bring the board up to date and return it: ``log, n, best_score, best_index``."""
    follow(spark, folder, state, board).awaitTermination()
    return latest_board(spark, board)
