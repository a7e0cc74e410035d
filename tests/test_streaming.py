from pyspark.sql import functions as F

from plumbline.sources import commits
from plumbline.sources.trial_logs import append_trials, record_lines, replace_trials
from plumbline.streaming.leaderboard import live_leaderboard


def batch(spark, rows):
    return spark.createDataFrame(rows, "log string, trial_index long, mean_score double").withColumns(
        {
            "arm": F.col("log"),
            "params": F.parse_json(F.lit("{}")),
            "payload": F.parse_json(F.lit("{}")),
            "fold_scores": F.array("mean_score"),
            "timestamp": F.current_timestamp(),
            **{c: F.lit(1.0) for c in ("std_score", "wall_clock_s", "cumulative_s")},
        }
    )


def test_board_follows_commits(spark, tmp_path):
    folder, state, board = (str(tmp_path / n) for n in ("logs", "state", "board"))

    def now():
        return {r["log"]: tuple(r)[1:] for r in live_leaderboard(spark, folder, state, board).collect()}

    append_trials(batch(spark, [("a", 0, 0.2), ("a", 1, 0.7), ("b", 0, 0.1)]), folder, "one")
    assert now() == {"a": (2, 0.7, 1), "b": (1, 0.1, 0)}
    append_trials(batch(spark, [("a", 2, 0.7), ("b", 1, 0.9)]), folder, "two")
    append_trials(batch(spark, [("a", 2, 0.7), ("b", 1, 0.9)]), folder, "two")
    # A batch without a commit, as a writer that died would leave it.
    half = record_lines(batch(spark, [("a", 3, 5.0)]))
    half.write.partitionBy("log").text(f"{folder}/batches/batch=three-x")
    assert now() == {"a": (3, 0.7, 1), "b": (2, 0.9, 1)}
    assert now() == {"a": (3, 0.7, 1), "b": (2, 0.9, 1)}
    replace_trials(batch(spark, [("a", 0, 0.3), ("c d/e", 4, 0.0)]), folder)
    append_trials(batch(spark, [("a", 1, float("nan"))]), folder)
    assert now() == {"a": (2, 0.3, 0), "b": (2, 0.9, 1), "c d/e": (1, 0.0, 4)}
    assert len(commits.commits(spark, folder)) == 4
