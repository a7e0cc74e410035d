"""Registered queries: every operator run over the given tables.

Doubles are rounded where the order of additions may differ between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.expressions import logistic_loss
from plumbline.functions.params import typed_params
from plumbline.functions.rules import any_rule, heat_rule, power_rule, process_power, strain_rule
from plumbline.operators import candidates as expressions
from plumbline.operators import scaling, splits, trials
from plumbline.operators.configs import sample_configs, validate_configs
from plumbline.operators.features import class_counts, with_class_weights
from plumbline.operators.logistic import first_step
from plumbline.operators.models import Evaluation, default_logistic, forest_model
from plumbline.operators.ranking import (
    average_precision,
    flag_ap,
    flag_average_precision,
    fold_summary,
    prevalence,
)
from plumbline.plans import report as reports
from plumbline.plans.tables import (
    CANDIDATES,
    LINE_LIMITS,
    LINE_SENSORS,
    document_features,
    events_as_trials,
    labelled_documents,
    table,
)
from plumbline.session import cut_lineage, remove_tables, work_folder
from plumbline.sources import trial_logs
from plumbline.sources.sensor_table import sensor_rows_and_rejects, short_names
from plumbline.streaming import leaderboard as live

SEEDS = "optuna_seed"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named columns."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Rules over lineitem.


def _line_flags(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        *keep,
        F.col("l_returnflag").alias("variant"),
        (F.col("l_linestatus") == "F").cast("int").alias("target"),
        heat_rule(LINE_SENSORS, LINE_LIMITS).alias("heat"),
        power_rule(LINE_SENSORS, LINE_LIMITS).alias("power"),
        strain_rule(LINE_SENSORS, LINE_LIMITS).alias("strain"),
        any_rule(LINE_SENSORS, LINE_LIMITS).alias("failure"),
    )


def rule_flags(spark, folder):
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return _line_flags(spark, folder, *keys)


def process_power_by_variant(spark, folder):
    power = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("variant"), process_power(LINE_SENSORS).alias("watts")
    )
    return rounded(
        power.groupBy("variant").agg(
            F.min("watts").alias("low"), F.avg("watts").alias("mean"), F.max("watts").alias("high")
        ),
        3,
        "low",
        "mean",
        "high",
    )


def rule_counts_by_variant(spark, folder):
    flags = _line_flags(spark, folder)
    return flags.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("heat", "power", "strain", "failure")],
    )


def rule_average_precision(spark, folder):
    """Rule as the score, per variant and over all rows, in one scan."""
    counts = (
        flag_average_precision(_line_flags(spark, folder), "target", "failure", ["variant"])
        .rollup("variant")
        .agg(*[F.sum(c).alias(c) for c in ("n", "positives", "flagged", "hits")])
    )
    return rounded(
        counts.select(
            F.coalesce("variant", F.lit("all")).alias("variant"),
            flag_ap().alias("ap"),
            "n",
            "positives",
            "flagged",
            "hits",
        ),
        9,
        "ap",
    )


# Average precision of continuous scores.


def price_average_precision(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("variant"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_linestatus") == "F").cast("int").alias("target"),
    )
    return rounded(average_precision(lines, "target", "score", ["variant"]), 9, "ap")


def _events_scored(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
        F.col("value").alias("score"),
        (F.col("event_type") == "error").cast("int").alias("target"),
    )


def event_average_precision(spark, folder):
    return rounded(average_precision(_events_scored(spark, folder), "target", "score"), 9, "ap")


def ap_by_event_hour(spark, folder):
    scored = _events_scored(spark, folder)
    return rounded(average_precision(scored, "target", "score", ["hour"]), 9, "ap")


# Splits.


def stratified_holdout(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return splits.stratified_holdout(labels, "doc_id", "toxic")


def stratified_folds(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return splits.stratified_folds(labels, "doc_id", "toxic")


def split_assignment(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return splits.assign_splits(labels, "doc_id", "toxic")


def _split_events(spark, folder) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("target")
    )
    return splits.assign_splits(events, "event_id", "target")


def split_sizes(spark, folder):
    """Sizes, positives and id sums of the parts of ``events``."""
    return (
        _split_events(spark, folder)
        .groupBy("is_holdout", F.coalesce("fold", F.lit(-1)).alias("fold"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("target").alias("positives"),
            F.sum("event_id").alias("id_sum"),
        )
    )


def two_fold_sizes(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return (
        splits.stratified_folds(labels, "doc_id", "toxic", folds=2)
        .groupBy("fold")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("positives"))
    )


def stratified_sample(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("target")
    )
    return splits.stratified_sample(events, "event_id", "target", 600)


# Features and fold scores.


def _split_documents(spark, folder) -> tuple[DataFrame, list[str]]:
    features, names = document_features(spark, folder)
    return splits.assign_splits(features, "doc_id", "toxic"), names


def _written_documents(spark, folder) -> tuple[DataFrame, list[str]]:
    """The split feature table, written once because several branches of a job read it."""
    documents, names = _split_documents(spark, folder)
    return cut_lineage(documents), names


def features_onehot(spark, folder):
    return document_features(spark, folder)[0]


def target_prevalence(spark, folder):
    return rounded(prevalence(table(spark, folder, "labels"), "toxic"), 9, "prevalence")


def target_counts(spark, folder):
    return class_counts(table(spark, folder, "labels"), "toxic")


def class_weights(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return rounded(with_class_weights(labels, "toxic"), 9, "weight")


def _length_by_fold(spark, folder) -> DataFrame:
    documents = labelled_documents(spark, folder).select("doc_id", "toxic", "n_chars")
    folds = splits.assign_splits(documents, "doc_id", "toxic").where(~F.col("is_holdout"))
    return average_precision(folds, "toxic", "n_chars", ["fold"])


def ap_per_fold(spark, folder):
    return rounded(_length_by_fold(spark, folder), 9, "ap")


def cv_mean_std(spark, folder):
    summary = fold_summary(_length_by_fold(spark, folder))
    return rounded(summary, 9, "mean_score", "std_score")


def rule_ap_per_fold(spark, folder):
    """A threshold rule over document lengths as the score, per fold."""
    documents = labelled_documents(spark, folder).select(
        "doc_id", "toxic", (F.col("n_words") > 400).cast("int").alias("flag")
    )
    folds = splits.assign_splits(documents, "doc_id", "toxic").where(~F.col("is_holdout"))
    return rounded(flag_average_precision(folds, "toxic", "flag", ["fold"]), 9, "ap")


def fold_statistics(spark, folder):
    documents, names = _split_documents(spark, folder)
    statistics = scaling.fit_statistics(documents, names, "toxic", 5)
    return rounded(statistics, 6, *[f"{p}_{x}" for x in names for p in ("mu", "sd")])


def _scaled_validation(spark, folder) -> tuple[DataFrame, list[str]]:
    documents, names = _written_documents(spark, folder)
    statistics = scaling.fit_statistics(documents, names, "toxic", 5)
    rows = scaling.views(documents, "validation", 5)
    return scaling.scale(rows, statistics, names), names


def fold_scaling(spark, folder):
    scaled, names = _scaled_validation(spark, folder)
    return rounded(scaled.select("doc_id", "fold", *names), 6, *names)


def fold_weights(spark, folder):
    """Balanced weights of each fold's fit part."""
    documents, _ = _written_documents(spark, folder)
    statistics = scaling.fit_statistics(documents, ["n_chars"], "toxic", 5)
    rows = scaling.scale(scaling.views(documents, "fit", 5), statistics, ["n_chars"])
    weighted = scaling.with_fit_weights(rows, "toxic")
    return rounded(weighted.select("doc_id", "scaler_fold", "toxic", "weight"), 9, "weight")


def interactions(spark, folder):
    widened, names = scaling.with_interactions(*_scaled_validation(spark, folder))
    return rounded(widened.select("doc_id", "fold", *names), 6, *names)


def expression_scores(spark, folder):
    documents, names = _written_documents(spark, folder)
    scores = expressions.score_candidates(documents, CANDIDATES, names, "toxic")
    return rounded(scores, 9, "ap", "holdout_ap")


def expression_losses(spark, folder):
    documents, names = _written_documents(spark, folder)
    losses = expressions.candidate_losses(documents, CANDIDATES, names, "toxic")
    return rounded(losses, 6, "loss")


def expression_logistic_losses(spark, folder):
    documents, names = _written_documents(spark, folder)
    losses = expressions.candidate_losses(documents, CANDIDATES, names, "toxic", loss=logistic_loss)
    return rounded(losses, 6, "loss")


def _candidate_records(spark, folder) -> DataFrame:
    documents, names = _written_documents(spark, folder)
    return trials.expression_records(
        expressions.candidate_trials(documents, CANDIDATES, names, "toxic")
    )


def expression_trials(spark, folder):
    """Every candidate and fold as a trial record, flattened."""
    flat = _candidate_records(spark, folder).withColumnRenamed("mean_score", "ap")
    return rounded(flat, 9, "ap", "holdout_ap")


def expression_selection(spark, folder):
    """The candidates' own trial records, selected by full coverage."""
    best = trials.full_coverage(_candidate_records(spark, folder))
    return rounded(best, 9, "cv_mean", "holdout_ap")


# Trial logs.


def trial_log_summary(spark, folder):
    return rounded(trials.log_summary(events_as_trials(spark, folder)), 9, "best", "minutes")


def _best(spark, folder, *extra: str) -> DataFrame:
    records = events_as_trials(spark, folder)
    return trials.best_so_far(records.select("log", "trial_index", "mean_score", *extra))


def best_so_far(spark, folder):
    return _best(spark, folder)


def best_by_time(spark, folder):
    """Curves over time, the seeds under one label."""
    lines = trials.time_lines(_best(spark, folder, "cumulative_s"), SEEDS, ["agent", "pysr"])
    return rounded(lines, 9, "cumulative_min")


def seed_band(spark, folder):
    return rounded(trials.seed_band(_best(spark, folder), SEEDS), 6, "median", "low", "high")


def score_spread(spark, folder):
    """Median, minimum and maximum score of whole logs."""
    records = events_as_trials(spark, folder).select("log", "mean_score")
    return rounded(trials.spread(records, ["log"], "mean_score"), 6, "median", "low", "high")


def comparison_lines(spark, folder):
    lines = trials.comparison_lines(_best(spark, folder), SEEDS, ["agent", "pysr"])
    return rounded(lines, 6, "y")


def _arm_summary(spark, folder) -> DataFrame:
    records = events_as_trials(spark, folder)
    best = trials.best_records(records, ["mean_score", "holdout_ap"])
    return best.select(
        F.col("log").alias("arm"), F.col("mean_score").alias("cv_mean"), "holdout_ap"
    )


def band_membership(spark, folder):
    return trials.band_membership(_arm_summary(spark, folder), SEEDS)


def best_record(spark, folder):
    return trials.best_records(
        events_as_trials(spark, folder), ["trial_index", "mean_score", "std_score", "event_id"]
    )


def best_seed(spark, folder):
    return trials.best_log(events_as_trials(spark, folder), SEEDS)


def budget_status(spark, folder):
    return trials.budget_status(events_as_trials(spark, folder), 1_000_000)


def cumulative_usage(spark, folder):
    records = events_as_trials(spark, folder).where(F.col("log") == "agent")
    return trials.cumulative_usage(records)


def usage_long(spark, folder):
    records = events_as_trials(spark, folder).where(F.col("log") == "agent")
    return trials.usage_long(trials.cumulative_usage(records))


def param_long(spark, folder):
    records = events_as_trials(spark, folder).where(F.col("log") != "pysr")
    return rounded(trials.numeric_params(records), 9, "value")


def param_trajectories(spark, folder):
    """Numeric parameters of the best seed and of the agent."""
    chosen = trials.trajectories(events_as_trials(spark, folder), SEEDS, "agent")
    return rounded(trials.numeric_params(chosen, ["label", "trial_index"]), 9, "value")


def branch_trajectories(spark, folder):
    chosen = trials.trajectories(events_as_trials(spark, folder), SEEDS, "agent")
    return chosen.select(
        "label", "trial_index", typed_params(F.col("params"))["estimator"].alias("estimator")
    )


def decision_trail(spark, folder):
    records = events_as_trials(spark, folder).where(F.col("log") == "agent")
    return trials.decision_trail(records)


def decision_trail_head(spark, folder):
    return decision_trail(spark, folder).orderBy("trial").limit(12)


def history_lines(spark, folder):
    records = events_as_trials(spark, folder).where(F.col("log") == "agent")
    return trials.history_lines(records)


def _expression_log(spark, folder) -> DataFrame:
    records = events_as_trials(spark, folder).where(F.col("log") == "pysr")
    return trials.expression_records(records)


def pareto_by_complexity(spark, folder):
    return rounded(trials.pareto(_expression_log(spark, folder)), 6, "cv", "holdout")


def full_coverage_best(spark, folder):
    best = trials.full_coverage(_expression_log(spark, folder))
    return rounded(best, 6, "cv_mean", "holdout_ap")


def top_expressions(spark, folder):
    return rounded(trials.top_expressions(_expression_log(spark, folder)), 6, "cv")


def latest_expressions(spark, folder):
    return rounded(trials.latest_expressions(_expression_log(spark, folder)), 6, "cv")


def iteration_compare(spark, folder):
    """All events as expression records, in two iterations."""
    records = events_as_trials(spark, folder).select(
        (F.col("user_id") % 2 + 1).alias("iteration"),
        F.col("event_id").alias("trial_index"),
        "mean_score",
        F.col("k").alias("complexity"),
        "holdout_ap",
        F.col("log").alias("expression"),
    )
    return rounded(trials.compare_iterations(records), 6, "cv", "holdout")


def reference_rows(spark, folder):
    """Best score per log, with the score of no skill appended."""
    scores = trials.final_best(events_as_trials(spark, folder)).select(
        F.col("log").alias("arm"), F.col("best_score").alias("mean_score")
    )
    no_skill = prevalence(_events_scored(spark, folder), "target")
    return rounded(trials.with_reference_row(scores, no_skill), 6, "mean_score")


def leaderboard(spark, folder):
    """Summary rows of all arms, the expression log by full coverage."""
    parametric = _arm_summary(spark, folder).where(F.col("arm") != "pysr")
    chosen = trials.full_coverage(_expression_log(spark, folder)).select(
        F.lit("pysr").alias("arm"), "cv_mean", "holdout_ap", "folds_present"
    )
    return trials.leaderboard(trials.combine_entries(parametric, chosen))


# Configurations.


def config_candidates(spark, folder):
    ids = table(spark, folder, "part").select("p_partkey")
    return rounded(sample_configs(ids, "p_partkey"), 6, "C")


def config_validate(spark, folder):
    """Configurations built from ``part``, many of them outside the space."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    kind = F.col("p_partkey") % 5
    raw = table(spark, folder, "part").select(
        "p_partkey",
        F.when(kind < 2, "logistic")
        .when(kind < 4, "random_forest")
        .otherwise("gradient_boosting")
        .alias("estimator"),
        F.when(kind == 0, size > 25).alias("use_interactions"),
        ((price - 900) * (size - 1)).alias("C"),
        F.when(size % 7 == 0, "elastic").otherwise("l1").alias("penalty"),
        (size * 10).cast("int").alias("n_estimators"),
        size.cast("int").alias("max_depth"),
        (size % 23).cast("int").alias("min_samples_leaf"),
        F.when(size % 11 == 0, F.lit(None)).otherwise(F.lit("sqrt")).alias("max_features"),
        F.when(size % 13 == 0, "heavy").otherwise("balanced").alias("class_weight"),
    )
    return validate_configs(raw).select(
        "p_partkey", "is_valid", F.concat_ws(",", "reasons").alias("reasons")
    )


def params_repair(spark, folder):
    """Event properties, some stored as a JSON string that holds the object, some broken."""
    props = F.col("props")
    twice = F.concat(F.lit('"'), F.replace(props, F.lit('"'), F.lit('\\"')), F.lit('"'))
    stored = (
        F.when(F.col("event_id") % 3 == 0, twice)
        .when(F.col("event_id") % 3 == 1, props)
        .otherwise(F.lit('"{not json"'))
    )
    records = table(spark, folder, "events").select("event_id", F.parse_json(stored).alias("params"))
    good, rejects = trials.repair_params(records)
    k = F.try_variant_get("params", "$.k", "int").alias("k")
    return good.select("event_id", k, F.lit(False).alias("rejected")).unionByName(
        rejects.select("event_id", k, F.lit(True).alias("rejected"))
    )


# Sources and sinks: the given tables written as files, some of them broken, and read back.


@contextmanager
def _scratch(spark, name: str) -> Iterator[str]:
    """A folder of its own among the intermediate tables, deleted at the end."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove_tables(spark, [path])


def sensor_rows(spark, folder):
    """lineitem as a headed CSV with some bad cells and cut lines: rows and rejects per variant."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    sensors = table(spark, folder, "lineitem").select(
        line.alias("UDI"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("Product ID"),
        F.col("l_returnflag").alias("Type"),
        F.col("l_discount").alias("Air temperature [K]"),
        F.col("l_tax").alias("Process temperature [K]"),
        F.when(line % 40 == 1, "fast").otherwise(F.col("l_extendedprice").cast("string")).alias("Rotational speed [rpm]"),
        F.when(line % 40 != 2, F.col("l_quantity")).alias("Torque [Nm]"),
        F.col("l_linenumber").alias("Tool wear [min]"),
        F.when(line % 40 == 3, "0.5").otherwise((F.col("l_linestatus") == "F").cast("int").cast("string")).alias("Machine failure"),
        *[F.lit(0).alias(n) for n in ("TWF", "HDF", "PWF", "OSF", "RNF")],
    )
    with _scratch(spark, "sensors") as path:
        sensors.write.option("header", True).csv(path)
        good, rejects = sensor_rows_and_rejects(spark, path)
        counted = short_names(good).groupBy(F.col("type").alias("variant")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count("torque").alias("torques"),
            F.sum("machine_failure").alias("failures"),
            F.sum("udi").alias("id_sum"),
        )
        variant = F.split("line", ",")[2].alias("variant")
        bad = rejects.groupBy(variant).agg(F.count(F.lit(1)).alias("rejected"))
        return reports.settled(counted.join(bad, "variant", "full"))


def _whole_records(spark, folder) -> DataFrame:
    """Events as trial records with every field."""
    return events_as_trials(spark, folder).withColumns(
        {"fold_scores": F.array("mean_score"), "timestamp": F.current_timestamp()}
    )


def _event_lines(spark, folder) -> DataFrame:
    """Events as lines of trial logs; five in a hundred aren't records."""
    written = trial_logs.record_lines(_whole_records(spark, folder), "event_id")
    value, case = F.col("value"), F.col("event_id") % 100
    changed = (
        F.when(case == 1, F.substring(value, F.lit(1), F.length(value) - 1))
        .when(case == 2, F.replace(value, F.lit('"arm":'), F.lit('"Arm":')))
        .when(case == 3, F.concat(F.lit('{"seed":1,"budget":2,'), F.substring(value, 2, 1_000_000)))
        .when(case == 4, F.regexp_replace(value, '"trial_index":([0-9]+)', '"trial_index":"#$1"'))
        .when(case == 5, F.lit(""))
        .otherwise(value)
    )
    return written.select(changed.alias("value"), "log")


def log_rejects(spark, folder):
    """Lines of trial logs by what is wrong with them."""
    lines = _event_lines(spark, folder)
    with _scratch(spark, "lines") as path:
        lines.write.partitionBy("log").text(path)
        back = spark.read.schema("value string, log string").text(path)
        good, rejects = trial_logs.records_and_rejects(back)
        counted = good.groupBy("log", F.lit("none").alias("reason")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("trial_index").alias("index_sum")
        )
        bad = rejects.groupBy("log", "reason").agg(
            F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("index_sum")
        )
        return reports.settled(counted.unionByName(bad))


def committed_logs(spark, folder):
    """Events appended in two batches, the first one twice, then the agent's log replaced."""
    records = cut_lineage(_whole_records(spark, folder))
    early = F.col("trial_index") < 100
    with _scratch(spark, "logs") as path:
        trial_logs.append_trials(records.where(early), path, "early")
        trial_logs.append_trials(records.where(early), path, "early")
        trial_logs.append_trials(records.where(~early), path, "late")
        agent = records.where((F.col("log") == "agent") & (F.col("trial_index") % 2 == 0))
        trial_logs.replace_trials(agent, path, "agent again")
        back = trial_logs.read_log_folder(spark, path)
        counted = back.groupBy("log").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("trial_index").alias("index_sum"),
            F.max("mean_score").alias("best"),
            F.sum(F.size("fold_scores").cast("long")).alias("scores"),
            F.count(F.try_variant_get("params", "$.C", "double")).alias("with_c"),
        )
        return reports.settled(rounded(counted, 9, "best"))


def log_kinds(spark, folder):
    """Records by what their log holds."""
    kind = F.coalesce(trial_logs.log_kind(F.col("log")), F.lit("other")).alias("kind")
    return events_as_trials(spark, folder).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def summary_round_trip(spark, folder):
    """The summary rows of all arms, written and read back."""
    summary = trials.combine_entries(_arm_summary(spark, folder)).withColumns(
        {
            "best_params": F.parse_json(F.to_json(F.struct("arm"))),
            "folds_present": F.lit(None).cast("long"),
        }
    )
    with _scratch(spark, "summary") as path:
        trial_logs.write_summary(summary, path)
        back = trial_logs.read_summary(spark, path)
        name = F.try_variant_get("best_params", "$.arm", "string").alias("named")
        return reports.settled(
            rounded(back.select("arm", name, "cv_mean", "holdout_ap", "folds_present"), 9, "cv_mean", "holdout_ap")
        )


def _odd_params(spark, folder) -> DataFrame:
    """The agent's records with a field that no list names and one of another type."""
    records = events_as_trials(spark, folder).where(F.col("log") == "agent")
    text = F.to_json("params")
    odd = F.concat(
        F.lit('{"warm_start":'),
        (F.col("k") % 3 == 0).cast("string"),
        F.lit(',"max_depth":"deep","a note":null,'),
        F.substring(F.replace(text, F.lit('"max_depth"'), F.lit('"depth"')), 2, 1_000_000),
    )
    return records.withColumn("params", F.parse_json(odd))


def environment_round_trip(spark, folder):
    """An environment record whose packages are the rows of some tables, written and read back."""
    counts = [
        table(spark, folder, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).cast("string").alias("rows"))
        for n in ("documents", "events", "labels")
    ]
    packages = F.map_from_entries(F.collect_list(F.struct("name", "rows")))
    record = reduce(DataFrame.unionByName, counts).agg(packages.alias("packages")).select(
        F.lit("2026-01-02T03:04:05Z").alias("timestamp"), "packages", F.lit(1).alias("threads")
    )
    with _scratch(spark, "environment") as path:
        record.coalesce(1).write.json(path)
        back = trial_logs.read_environment(spark, path)
        return reports.settled(
            back.select("threads", F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("at"), F.explode("packages").alias("name", "rows"))
        )


def whole_params(spark, folder):
    """The trail and the history line of records with odd parameters."""
    odd = _odd_params(spark, folder)
    trail = trials.decision_trail(odd).select(F.col("trial").alias("trial_index"), "estimator", "params")
    return trail.join(trials.history_lines(odd).select("trial_index", "line"), "trial_index")


def best_configurations(spark, folder):
    """Of every parametric log the record to refit, with the fields that forbid it."""
    records = events_as_trials(spark, folder)
    spoiled = F.parse_json(
        F.replace(F.to_json("params"), F.lit('"class_weight":"none"'), F.lit('"class_weight":"no"'))
    )
    wrong = F.col("log") == "optuna_seed1"
    records = records.withColumn("params", F.when(wrong, spoiled).otherwise(F.col("params")))
    chosen = reports.best_configurations(records)
    return chosen.select("log", "trial_index", "mean_score", "params", F.concat_ws(",", "reasons").alias("reasons"))


def live_leaderboard(spark, folder):
    """The leaderboard of a growing folder of logs, kept by a stream over its commits."""
    records = cut_lineage(_whole_records(spark, folder))
    early = F.col("trial_index") < 100
    with _scratch(spark, "live") as path:
        places = [f"{path}/{name}" for name in ("logs", "state", "board")]
        trial_logs.append_trials(records.where(early), places[0], "early")
        live.live_leaderboard(spark, *places)
        trial_logs.append_trials(records.where(~early), places[0], "late")
        return reports.settled(live.live_leaderboard(spark, *places))


# Models. Fits have no SQL counterpart, but the sums of their first step and the rules' records have.


def _evaluation(spark, folder) -> Evaluation:
    documents, names = _split_documents(spark, folder)
    flagged = documents.withColumn("flag", (F.col("n_words") > 400).cast("int"))
    return Evaluation(flagged, names, "toxic", keep=["flag"], row_id="doc_id")


def logistic_first_step(spark, folder):
    """The sums that every fold's first Newton step is solved from."""
    with _evaluation(spark, folder) as evaluation:
        sums = first_step(evaluation.table, evaluation.features, "toxic", evaluation.statistics)
        return reports.settled(rounded(sums, 6, "value"))


def rule_record(spark, folder):
    """Fold scores of the rule as the score, one row each, beside their mean and deviation."""
    documents, _ = _split_documents(spark, folder)
    flagged = documents.withColumn("flag", (F.col("n_words") > 400).cast("int"))
    records = reports.rule_records(flagged, "flag", "toxic")
    each = records.select("arm", "mean_score", "std_score", F.posexplode("fold_scores").alias("fold", "ap"))
    return rounded(each, 9, "ap", "mean_score", "std_score")


def rule_holdout_entry(spark, folder):
    """The rule's summary row: its score on the holdout, next to those of no model."""
    with _evaluation(spark, folder) as evaluation:
        rows = reports.rule_entry(evaluation, "flag")
        return reports.settled(rounded(rows.select("arm", "holdout_ap", F.to_json("best_params").alias("best_params")), 9, "holdout_ap"))


def baseline_cv(spark, folder):
    with _evaluation(spark, folder) as evaluation:
        return reports.baseline_records(evaluation, "flag").select(
            "arm", "fold_scores", "mean_score", "std_score", "wall_clock_s"
        )


def holdout_eval(spark, folder):
    with _evaluation(spark, folder) as evaluation:
        return reports.baseline_entries(evaluation, "flag").select("arm", "holdout_ap")


def logistic_cv(spark, folder):
    with _evaluation(spark, folder) as evaluation:
        return evaluation.cross_validate([default_logistic()])


def forest_cv(spark, folder):
    small = forest_model(
        {
            "n_estimators": 50,
            "max_depth": 8,
            "min_samples_leaf": 2,
            "max_features": "all",
            "class_weight": "balanced",
        }
    )
    with _evaluation(spark, folder) as evaluation:
        return evaluation.cross_validate([small])


def candidate_eval(spark, folder):
    """A configuration drawn for every region, cross-validated."""
    regions = table(spark, folder, "region").select(F.col("r_regionkey").alias("config_id"))
    configs = sample_configs(regions, "config_id")
    with _evaluation(spark, folder) as evaluation:
        records = reports.evaluate_configs(evaluation, configs, "config_id", "optuna_seed0")
    return records.select(
        "arm", "trial_index", "mean_score", "std_score", "wall_clock_s", "cumulative_s"
    )


def report(spark, folder):
    """Holdout summary of the default models, the rule and every log."""
    records = events_as_trials(spark, folder)
    with _evaluation(spark, folder) as evaluation:
        _, summary = reports.report(evaluation, "flag", records)
        return reports.settled(summary.select("arm", "cv_mean", "holdout_ap", "folds_present"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rule_flags,
        process_power_by_variant,
        rule_counts_by_variant,
        rule_average_precision,
        price_average_precision,
        event_average_precision,
        ap_by_event_hour,
        stratified_holdout,
        stratified_folds,
        split_assignment,
        split_sizes,
        two_fold_sizes,
        stratified_sample,
        features_onehot,
        target_prevalence,
        target_counts,
        class_weights,
        ap_per_fold,
        cv_mean_std,
        rule_ap_per_fold,
        fold_statistics,
        fold_scaling,
        fold_weights,
        interactions,
        expression_scores,
        expression_losses,
        expression_logistic_losses,
        expression_trials,
        expression_selection,
        trial_log_summary,
        best_so_far,
        best_by_time,
        seed_band,
        score_spread,
        comparison_lines,
        band_membership,
        best_record,
        best_seed,
        budget_status,
        cumulative_usage,
        usage_long,
        param_long,
        param_trajectories,
        branch_trajectories,
        decision_trail,
        decision_trail_head,
        history_lines,
        pareto_by_complexity,
        full_coverage_best,
        top_expressions,
        latest_expressions,
        iteration_compare,
        reference_rows,
        leaderboard,
        config_candidates,
        config_validate,
        params_repair,
        sensor_rows,
        log_rejects,
        committed_logs,
        log_kinds,
        summary_round_trip,
        environment_round_trip,
        whole_params,
        best_configurations,
        live_leaderboard,
        logistic_first_step,
        rule_record,
        rule_holdout_entry,
        baseline_cv,
        holdout_eval,
        logistic_cv,
        forest_cv,
        candidate_eval,
        report,
    )
}
