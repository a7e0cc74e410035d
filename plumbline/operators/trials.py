"""Analytics over trial logs.

A log is the set of records with one ``log`` name; ``trial_index`` counts its records from
zero. First-wins and last-wins choices use ``trial_index``, since files keep no order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import display, known
from plumbline.functions.params import param, params_text, repaired, usage
from plumbline.operators.running import running
from plumbline.session import cut_lineage

# Records of one log handled by one task in running totals. Indices are dense, so blocks of
# them are balanced without sampling.
BLOCK = 100_000

TOKEN_COUNTERS = {
    "input": "input_tokens",
    "output": "output_tokens",
    "reasoning": "output_reasoning_tokens",
}


def _first_best(score: Column) -> Column:
    """Ordering key: highest score, then lowest index."""
    return F.struct(known(score), -F.col("trial_index"))


def _by_index(trials: DataFrame, block: int, **running_args) -> DataFrame:
    """Running values in the order of the index; the columns given are written and read from there."""
    blocked = cut_lineage(trials.withColumn("_block", F.floor(F.col("trial_index") / block)), "trials")
    return running(
        blocked, keys=["log"], order=["trial_index"], bucket=["_block"], **running_args
    ).drop("_block")


def repair_params(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decode parameters stored as JSON text; records whose text does not parse come second."""
    decoded = trials.withColumn("_decoded", repaired(F.col("params")))
    good = decoded.where(F.col("_decoded").isNotNull()).withColumn("params", F.col("_decoded"))
    return good.drop("_decoded"), decoded.where(F.col("_decoded").isNull()).drop("_decoded")


def log_summary(trials: DataFrame) -> DataFrame:
    """Records, best score and elapsed minutes per log."""
    return trials.groupBy("log").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(known(F.col("mean_score"))).alias("best"),
        (F.max("cumulative_s") / 60).alias("minutes"),
    )


def best_so_far(trials: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``best_score``, the highest score of the log up to each record."""
    return _by_index(trials, block, maxima={"best_score": known(F.col("mean_score"))})


def elapsed_minutes(best: DataFrame) -> DataFrame:
    """Add ``cumulative_min`` for curves over time instead of index."""
    return best.withColumn("cumulative_min", F.col("cumulative_s") / 60)


def time_lines(best: DataFrame, prefix: str, others: Sequence[str]) -> DataFrame:
    """Curves over time for one chart: every seed under one label, the other logs under their own."""
    label = F.when(F.col("log").startswith(prefix), "optuna seed").when(
        F.col("log").isin(*others), F.col("log")
    )
    lines = elapsed_minutes(best).select("log", "cumulative_min", "best_score", label.alias("label"))
    return lines.where(F.col("label").isNotNull())


def numbered(records: DataFrame, order: Sequence[str], keys: Sequence[str] = ("log",)) -> DataFrame:
    """Add ``trial_index``, counting each log's records from zero in the given order.

    The records are written once, so that what they come from is read once.
    """
    counted = running(
        cut_lineage(records, "records"), keys=keys, order=order, sums={"trial_index": F.lit(1)}
    )
    return counted.withColumn("trial_index", F.col("trial_index") - 1)


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median, minimum and maximum per key.

    Equal values are counted first and the counts accumulated in buckets, so that a key
    with any number of rows needs no task to hold them.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(
        counted,
        keys=keys,
        order=["_v"],
        sums={"_upto": F.col("_n")},
        totals={"_all": "_upto"},
        sample_by=counted.columns,
    )
    twice = 2 * F.col("_upto")
    lower = F.min(F.when(twice >= F.col("_all"), F.col("_v")))
    upper = F.min(F.when(twice > F.col("_all"), F.col("_v")))
    return ranked.groupBy(*keys).agg(
        ((lower + upper) / 2).alias("median"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
    )


def seed_band(best: DataFrame, prefix: str) -> DataFrame:
    """Median, lowest and highest best-so-far score per index over the seed logs."""
    seeds = best.where(F.col("log").startswith(prefix))
    # One row for a seed and index: an index never has more rows than there are seed logs.
    return seeds.groupBy("trial_index").agg(
        F.median("best_score").alias("median"),
        F.min("best_score").alias("low"),
        F.max("best_score").alias("high"),
    )


def comparison_lines(best: DataFrame, prefix: str, others: Sequence[str]) -> DataFrame:
    """Curves for one chart: the seeds' median and the other logs, labelled."""
    median = seed_band(best, prefix).select(
        "trial_index", F.col("median").alias("y"), F.lit("median of seeds").alias("label")
    )
    rest = best.where(F.col("log").isin(*others)).select(
        "trial_index", F.col("best_score").alias("y"), F.col("log").alias("label")
    )
    return median.unionByName(rest)


def final_best(trials: DataFrame) -> DataFrame:
    """The last best-so-far score of each log, which is its highest score."""
    return trials.groupBy("log").agg(F.max(known(F.col("mean_score"))).alias("best_score"))


def best_log(trials: DataFrame, prefix: str) -> DataFrame:
    """The seed log with the highest final score; the first name wins a tie."""
    finals = final_best(trials.where(F.col("log").startswith(prefix)))
    return finals.orderBy(F.desc("best_score"), "log").limit(1)


def best_records(trials: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The best record of each log, the earliest among equals."""
    record = F.max_by(F.struct(*columns), _first_best(F.col("mean_score")))
    return trials.groupBy("log").agg(record.alias("_r")).select("log", "_r.*")


def band_membership(summary: DataFrame, prefix: str) -> DataFrame:
    """For every other arm, whether its scores lie within the range of the seeds.

    ``summary`` has ``arm, cv_mean, holdout_ap``.
    """
    seeds = (
        summary.where(F.col("arm").startswith(prefix))
        .agg(
            F.struct(
                F.min("cv_mean").alias("cv_low"),
                F.max("cv_mean").alias("cv_high"),
                F.min("holdout_ap").alias("holdout_low"),
                F.max("holdout_ap").alias("holdout_high"),
            )
        )
        .scalar()
    )
    return (
        summary.where(~F.col("arm").startswith(prefix))
        .withColumn("_b", seeds)
        .select(
            "arm",
            "cv_mean",
            "holdout_ap",
            "_b.*",
            F.col("cv_mean").between(F.col("_b.cv_low"), F.col("_b.cv_high")).alias("cv_inside"),
            F.col("holdout_ap")
            .between(F.col("_b.holdout_low"), F.col("_b.holdout_high"))
            .alias("holdout_inside"),
        )
    )


def budget_status(trials: DataFrame, budget: int) -> DataFrame:
    """Best score so far and evaluations left, per log."""
    return trials.groupBy("log").agg(
        F.max(known(F.col("mean_score"))).alias("best"),
        (F.lit(budget) - F.count(F.lit(1))).alias("remaining"),
    )


def expression_records(trials: DataFrame) -> DataFrame:
    """Flatten the records of an expression log."""
    return trials.select(
        "log",
        "trial_index",
        "mean_score",
        param(F.col("params"), "complexity").alias("complexity"),
        param(F.col("params"), "expression").alias("expression"),
        F.try_variant_get("payload", "$.fold", "int").alias("fold"),
        F.try_variant_get("payload", "$.holdout_ap", "double").alias("holdout_ap"),
    )


def pareto(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean scores and record count per complexity."""
    return records.groupBy(*keys, "complexity").agg(
        F.avg(known(F.col("mean_score"))).alias("cv"),
        F.avg(known(F.col("holdout_ap"))).alias("holdout"),
        F.count(F.lit(1)).alias("folds"),
    )


def top_expressions(records: DataFrame, n: int = 8) -> DataFrame:
    """Complexities by mean score, each with the expression of its lowest score.

    Among equal lowest scores the latest record's expression is shown.
    """
    lowest = F.min_by("expression", F.struct(known(F.col("mean_score")), -F.col("trial_index")))
    grouped = records.groupBy("complexity").agg(
        F.avg(known(F.col("mean_score"))).alias("cv"),
        F.count(F.lit(1)).alias("folds"),
        lowest.alias("expression"),
    )
    return grouped.orderBy(F.desc("cv"), "complexity").limit(n)


def latest_expressions(records: DataFrame, n: int = 6) -> DataFrame:
    """Complexities by mean score, each with its latest expression."""
    grouped = records.groupBy("complexity").agg(
        F.avg(known(F.col("mean_score"))).alias("cv"),
        F.count(F.lit(1)).alias("folds"),
        F.max_by("expression", "trial_index").alias("expression"),
    )
    return grouped.orderBy(F.desc("cv"), "complexity").limit(n)


def full_coverage(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, the best mean among the complexities with the most records.

    Only complexities found in every fold compete. The complexity seen first wins a tie;
    missing holdout scores are left out of their mean, which is NULL if all are missing.
    """
    keys = list(keys)
    groups = records.groupBy(*keys, "complexity").agg(
        F.count(F.lit(1)).alias("folds_present"),
        F.avg(known(F.col("mean_score"))).alias("cv_mean"),
        F.avg(known(F.col("holdout_ap"))).alias("holdout_ap"),
        F.max_by("expression", "trial_index").alias("expression"),
        F.min("trial_index").alias("_first"),
    )
    chosen = F.max_by(
        F.struct("complexity", "expression", "cv_mean", "holdout_ap", "folds_present"),
        F.struct("folds_present", "cv_mean", -F.col("_first")),
    )
    return (
        groups.groupBy(*keys)
        .agg(chosen.alias("_g"))
        .where(F.col("_g").isNotNull())
        .select(*keys, "_g.*")
    )


def full_coverage_entry(records: DataFrame):
    """The selected row, or an error when there are no records."""
    rows = full_coverage(records).head(1)
    if not rows:
        raise ValueError("no expression records found")
    return rows[0]


def compare_iterations(records: DataFrame) -> DataFrame:
    """One row per ``iteration``: the full-coverage choice and the highest score of any record."""
    peak = records.groupBy("iteration").agg(F.max(known(F.col("mean_score"))).alias("peak_cv"))
    chosen = full_coverage(records, ["iteration"]).select(
        "iteration",
        F.col("complexity").alias("best_complexity"),
        F.col("folds_present").alias("folds"),
        F.col("cv_mean").alias("cv"),
        F.col("holdout_ap").alias("holdout"),
    )
    return chosen.join(peak, "iteration")


def cumulative_usage(trials: DataFrame, block: int = BLOCK) -> DataFrame:
    """Token counters summed up to each record, with the record's latency."""
    return _by_index(
        trials.select(
            "log",
            "trial_index",
            F.try_variant_get("payload", "$.latency_s", "double").alias("latency_s"),
            *[usage(F.col("payload"), c).alias(f"_{n}") for n, c in TOKEN_COUNTERS.items()],
        ),
        block,
        sums={n: F.col(f"_{n}") for n in TOKEN_COUNTERS},
    ).select("log", "trial_index", "latency_s", *TOKEN_COUNTERS)


def usage_long(cumulative: DataFrame) -> DataFrame:
    """One row per record and token kind."""
    return cumulative.unpivot(
        ["log", "trial_index"], list(TOKEN_COUNTERS), "kind", "cumulative_tokens"
    )


def numeric_params(trials: DataFrame, extra: Sequence[str] = ("log", "trial_index")) -> DataFrame:
    """One row per numeric parameter of each record; C on a log10 scale.

    Text and booleans are skipped.
    """
    exploded = trials.select(*extra, "params").lateralJoin(
        trials.sparkSession.tvf.variant_explode(F.col("params").outer())
    )
    kind = F.schema_of_variant("value")
    number = F.try_variant_get("value", "$", "double")
    is_c = F.col("key") == "C"
    return exploded.where(
        (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    ).select(
        *extra,
        F.when(is_c, "log10 C").otherwise(F.col("key")).alias("param"),
        F.when(is_c, F.log10(number)).otherwise(number).alias("value"),
    )


def trajectories(trials: DataFrame, prefix: str, other: str) -> DataFrame:
    """Records of the best seed and of one other log, labelled."""
    seed = best_log(trials.select("log", "mean_score"), prefix).select("log").scalar()
    label = F.when(F.col("log") == other, other).when(F.col("log") == seed, "best seed")
    return trials.withColumn("label", label).where(F.col("label").isNotNull())


def decision_trail(trials: DataFrame) -> DataFrame:
    """Per record: branch, remaining parameters as text, rounded score and latency, rationale."""
    payload = F.col("payload")
    return trials.select(
        "log",
        F.col("trial_index").alias("trial"),
        param(F.col("params"), "estimator").alias("estimator"),
        params_text(F.col("params"), without=("estimator",)).alias("params"),
        display(F.col("mean_score"), 4).alias("ap"),
        display(F.try_variant_get(payload, "$.latency_s", "double"), 1).alias("latency_s"),
        F.try_variant_get(payload, "$.rationale", "string").alias("rationale"),
    )


def history_lines(trials: DataFrame) -> DataFrame:
    """One text line per record."""
    line = F.format_string(
        "t%02d | %s | AP=%.4f (+-%.4f) | %.1fs",
        F.col("trial_index"),
        params_text(F.col("params")),
        F.col("mean_score"),
        F.col("std_score"),
        F.col("wall_clock_s"),
    )
    return trials.select("log", "trial_index", line.alias("line"))


def with_reference_row(scores: DataFrame, prevalence: DataFrame) -> DataFrame:
    """Append the score of no skill to ``arm, mean_score`` rows."""
    return scores.unionByName(
        prevalence.select(
            F.lit("prevalence (no skill)").alias("arm"), F.col("prevalence").alias("mean_score")
        )
    )


def combine_entries(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Summary rows of all arms in one table; a column an arm lacks is NULL."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def leaderboard(summary: DataFrame) -> DataFrame:
    """Arms by holdout score, rounded for display."""
    return summary.select(
        "arm",
        display(F.col("cv_mean"), 4).alias("cv_mean"),
        display(F.col("holdout_ap"), 4).alias("holdout_ap"),
        "folds_present",
    ).orderBy(F.desc_nulls_last("holdout_ap"), "arm")
