"""Whole evaluation jobs: baselines, candidate configurations, and the final report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.functions.params import CONFIG_FIELDS, params_text, reasons, typed_params
from plumbline.operators.configs import validate_configs
from plumbline.operators.models import (
    Evaluation,
    Model,
    as_records,
    build_model,
    default_forest,
    default_logistic,
    settled,
)
from plumbline.operators.ranking import flag_average_precision
from plumbline.operators.trials import (
    best_records,
    combine_entries,
    expression_records,
    full_coverage,
)
from plumbline.sources.trial_logs import BASELINE_LOG, log_kind

# How the rules are named in records.
RULES_ARM = "ground_truth_rules"
RULES_EXPRESSION = "hdf | pwf | osf"

# Configurations taken to the driver to be fitted. Every one means several fits of the whole
# table, so a longer list is a mistake to report, not data to process.
MAX_FITS = 10_000
# Configurations whose scores are one query.
BATCH = 16

RECORD = (
    "arm string, trial_index long, params string, fold_scores array<double>, "
    "mean_score double, std_score double, wall_clock_s double, cumulative_s double"
)


def _json(**fields: str):
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))


def rule_records(df: DataFrame, flag: str, target: str) -> DataFrame:
    """Fold scores of a rule used as the score, as one trial record."""
    search = df.where(~F.col("is_holdout"))
    by_fold = flag_average_precision(search, target, flag, ["fold"])
    return as_records(by_fold.withColumn("arm", F.lit(RULES_ARM)), ["arm"])


def baseline_records(
    evaluation: Evaluation, flag: str, models: Sequence[Model] | None = None
) -> DataFrame:
    """Trial records of the default models and the rules on the shared folds.

    ``flag`` is a 0/1 column kept by the evaluation: the rules' verdict. Times run from the
    start of a record's own work to its end, the cumulative ones from the start of the call.
    """
    origin = time.perf_counter()
    models = models or [default_logistic(), default_forest()]
    fitted = evaluation.cross_validate(models).withColumn(
        "params", F.to_json(F.struct(F.col("arm").alias("estimator")))
    )
    start = time.perf_counter()
    rules = settled(rule_records(evaluation.table, flag, evaluation.target))
    end = time.perf_counter()
    rules = rules.withColumns(
        {
            "wall_clock_s": F.lit(end - start),
            "cumulative_s": F.lit(end - origin),
            "params": _json(expression=RULES_EXPRESSION),
        }
    )
    return (
        fitted.drop("trial_index")
        .unionByName(rules)
        .withColumns(
            {
                "log": F.lit(BASELINE_LOG),
                "trial_index": F.lit(0).cast("long"),
                "params": F.parse_json("params"),
                "payload": F.parse_json(F.lit("{}")),
                "timestamp": F.current_timestamp(),
            }
        )
    )


def rule_entry(evaluation: Evaluation, flag: str) -> DataFrame:
    """The holdout row of the rules."""
    held = evaluation.table.where("is_holdout")
    return flag_average_precision(held, evaluation.target, flag).select(
        F.lit(RULES_ARM).alias("arm"),
        F.col("ap").alias("holdout_ap"),
        F.parse_json(_json(expression=RULES_EXPRESSION)).alias("best_params"),
    )


def baseline_entries(
    evaluation: Evaluation, flag: str, models: Sequence[Model] | None = None
) -> DataFrame:
    """Holdout rows of the default models and the rules; they have no ``cv_mean``."""
    models = models or [default_logistic(), default_forest()]
    params = F.parse_json(_json(estimator="default"))
    fitted = evaluation.holdout_ap(models).withColumn("best_params", params)
    return fitted.unionByName(settled(rule_entry(evaluation, flag))).withColumn(
        "cv_mean", F.lit(None).cast("double")
    )


def evaluate_configs(
    evaluation: Evaluation,
    configs: DataFrame,
    row_id: str,
    arm: str,
    seed: int = 0,
    on_batch: Callable[[DataFrame], None] | None = None,
    batch: int = BATCH,
    max_fits: int = MAX_FITS,
) -> DataFrame:
    """Cross-validate a table of configurations: one trial record per valid one, in id order.

    The configurations go to the driver, which starts the fits; invalid rows are left out
    (``validate_configs`` tells why). Records come back a batch at a time, and ``on_batch``
    may append each batch to a log, so that a long run can be followed and resumed. A record's
    times are its own: from its first fit's start, and from the start of the call, to its last
    fit's end.
    """
    spark = configs.sparkSession
    valid = validate_configs(configs).where("is_valid").select(row_id, *CONFIG_FIELDS)
    rows = _bounded(valid.orderBy(row_id), "configurations to fit", max_fits)
    if not rows:
        raise ValueError("no valid configuration")
    models = [build_model(row.asDict(), seed, arm) for row in rows]

    origin, done = time.perf_counter(), []
    for first in range(0, len(models), batch):
        ahead = time.perf_counter() - origin
        found = [
            (
                arm,
                first + r["trial_index"],
                _params_json(rows[first + r["trial_index"]]),
                r["fold_scores"],
                r["mean_score"],
                r["std_score"],
                r["wall_clock_s"],
                ahead + r["cumulative_s"],
            )
            for r in evaluation.cross_validate(models[first : first + batch]).collect()
        ]
        if on_batch is not None:
            on_batch(_trial_columns(spark.createDataFrame(found, RECORD)))
        done += found
    return _trial_columns(spark.createDataFrame(done, RECORD))


def _trial_columns(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "log": F.col("arm"),
            "params": F.parse_json("params"),
            "payload": F.parse_json(F.lit("{}")),
            "timestamp": F.current_timestamp(),
        }
    )


def _bounded(df: DataFrame, what: str, most: int) -> list[Row]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def _params_json(row: Row) -> str:
    return json.dumps({f: row[f] for f in CONFIG_FIELDS if row[f] is not None})


def best_configurations(trials: DataFrame) -> DataFrame:
    """The best record of every parametric log with its parameters typed and checked.

    ``log, trial_index, mean_score, params, p, reasons``: ``params`` is the whole text of the record,
    ``reasons`` names the fields that put it outside the space.
    """
    parametric = trials.where(log_kind(F.col("log")) == "parametric")
    best = best_records(parametric, ["trial_index", "mean_score", "params"])
    return best.withColumn("p", typed_params(F.col("params"))).select(
        "log",
        "trial_index",
        "mean_score",
        params_text(F.col("params")).alias("params"),
        "p",
        reasons({f: F.col(f"p.{f}") for f in CONFIG_FIELDS}).alias("reasons"),
    )


def parametric_entries(
    evaluation: Evaluation,
    trials: DataFrame,
    seed: int = 0,
    batch: int = BATCH,
    max_fits: int = MAX_FITS,
) -> DataFrame:
    """Refit the best record of every parametric log on the search part, score the holdout.

    A best record outside the search space is an error that names the log and the fields.
    """
    spark = trials.sparkSession
    rows = _bounded(best_configurations(trials).orderBy("log"), "logs to refit", max_fits)
    wrong = [f"{r['log']} {r['trial_index']}: {', '.join(r['reasons'])}" for r in rows if r["reasons"]]
    if wrong:
        raise ValueError(f"configurations outside the search space: {'; '.join(wrong)}")
    entries = []
    for first in range(0, len(rows), batch):
        part = rows[first : first + batch]
        models = [build_model(row["p"].asDict(), seed, row["log"]) for row in part]
        scores = {r["arm"]: r["holdout_ap"] for r in evaluation.holdout_ap(models).collect()}
        entries += [(row["log"], row["params"], row["mean_score"], scores[row["log"]]) for row in part]
    schema = "arm string, best_params string, cv_mean double, holdout_ap double"
    return spark.createDataFrame(entries, schema).withColumn(
        "best_params", F.parse_json("best_params")
    )


def expression_entries(trials: DataFrame) -> DataFrame:
    """Summary row of every expression log by full coverage."""
    records = expression_records(trials.where(log_kind(F.col("log")) == "expression"))
    return full_coverage(records, ["log"]).select(
        F.col("log").alias("arm"),
        F.parse_json(F.to_json(F.struct("complexity", "expression"))).alias("best_params"),
        "cv_mean",
        "holdout_ap",
        "folds_present",
    )


def report(
    evaluation: Evaluation,
    flag: str,
    trials: DataFrame,
    models: Sequence[Model] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Baseline records, and the holdout summary of all arms."""
    baselines = baseline_records(evaluation, flag, models)
    summary = combine_entries(
        baseline_entries(evaluation, flag, models),
        parametric_entries(evaluation, trials),
        expression_entries(trials),
    )
    return baselines, summary
