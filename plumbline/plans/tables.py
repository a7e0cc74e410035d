"""The given tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rules import Limits, Sensors
from plumbline.operators.candidates import Candidate
from plumbline.operators.features import category_values, make_features, make_target
from plumbline.operators.trials import numbered

DOCUMENT_FEATURES = ["n_chars", "n_words", "n_lines", "n_digits", "n_commas"]

# lineitem read as sensor rows; limits chosen for the ranges of those columns.
LINE_SENSORS = Sensors(
    air_temp="l_discount",
    proc_temp="l_tax",
    rpm="l_extendedprice",
    torque="l_quantity",
    tool_wear="l_linenumber",
    variant="l_returnflag",
)
LINE_LIMITS = Limits(
    temperature_gap=-0.05,
    low_speed=10000.0,
    power_floor=3500.0,
    power_ceiling=480000.0,
    strain={"A": 200, "N": 220, "R": 240},
)

CANDIDATES = [
    Candidate("constant", "0.5", 1),
    Candidate("length", "n_chars", 1),
    Candidate("bounded", "max(n_commas, 0.4) - n_lines / 7.0", 7),
    Candidate("squeezed", "min(n_chars * n_lines, 3.5)", 5),
    Candidate("additive", "n_words + n_digits * 0.125 - n_commas", 7),
    Candidate("ratio", "n_chars / (n_lines + 11.0)", 5),
    Candidate("any_of", "logical_or(less(n_commas, 0.2), greater(n_lines, 1.5))", 7),
    Candidate("spoken", "type_de - type_fr * 1.5 + n_words", 7),
    Candidate("tongue", "logical_or(greater(type_en, 0.0), greater(type_es, 0.0)) * n_commas", 9),
    Candidate("all_of", "logical_and(less(n_chars, 2.0), greater(n_words, -1.5)) + n_digits", 9),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over each labelled document's text, its language, and ``toxic`` as target.

    Texts are reduced to counts before the join, so no text is shuffled.
    """
    text = F.col("text")

    def count_of(character: str) -> Column:
        """Occurrences of an ASCII character: one byte each, so no characters are counted."""
        without = F.replace(text, F.lit(character), F.lit(""))
        return F.octet_length(text) - F.octet_length(without)

    counts = table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        "n_chars",
        (count_of(" ") + 1).alias("n_words"),
        (count_of("\n") + 1).alias("n_lines"),
        F.regexp_count(text, F.lit("[0-9]")).alias("n_digits"),
        count_of(",").alias("n_commas"),
    )
    labels = make_target(table(spark, folder, "labels").select("doc_id", "toxic"), "toxic")
    return counts.join(labels, "doc_id")


def document_features(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Feature table of the labelled documents with the target, and the feature names."""
    languages = category_values(table(spark, folder, "documents"), "lang")
    features = make_features(
        labelled_documents(spark, folder),
        "doc_id",
        DOCUMENT_FEATURES,
        "lang",
        categories=languages,
        keep=["toxic"],
    )
    return features, [*DOCUMENT_FEATURES, *[f"type_{v}" for v in languages]]


def events_as_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trial records.

    Three event types are seed logs, one the agent's log, one the expression log. Records are
    counted per log in time order; ``value`` is the score and the counter in ``props`` gives
    parameters and payload.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    log = (
        F.when(F.col("event_type") == "click", "optuna_seed0")
        .when(F.col("event_type") == "purchase", "optuna_seed1")
        .when(F.col("event_type") == "view", "optuna_seed2")
        .when(F.col("event_type") == "error", "agent")
        .otherwise("pysr")
    )
    records = table(spark, folder, "events").select(
        log.alias("log"),
        "ts",
        "event_id",
        "user_id",
        k.alias("k"),
        F.col("value").alias("mean_score"),
    )
    counted = numbered(records, ["ts", "event_id"])
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)
    is_expression = F.col("log") == "pysr"
    is_logistic = F.col("k") % 2 == 0
    tenth = (F.col("k") + 1) / 10
    holdout = F.when(F.col("user_id") % 3 != 0, F.col("mean_score") / 2)
    expression = F.struct(
        F.col("k").alias("complexity"),
        F.concat(F.lit("expr_"), F.col("event_id").cast("string")).alias("expression"),
    )
    logistic = F.struct(
        F.lit("logistic").alias("estimator"),
        (F.col("k") % 4 == 0).alias("use_interactions"),
        tenth.alias("C"),
        F.lit("l2").alias("penalty"),
        F.lit("none").alias("class_weight"),
    )
    forest = F.struct(
        F.lit("random_forest").alias("estimator"),
        (F.col("k") + 50).alias("n_estimators"),
        (F.col("k") % 18 + 3).alias("max_depth"),
        F.lit(1).alias("min_samples_leaf"),
        F.lit("sqrt").alias("max_features"),
        F.lit("none").alias("class_weight"),
    )
    tokens = F.struct(
        F.col("k").alias("input_tokens"),
        (F.col("k") * 2).alias("output_tokens"),
        F.when(F.col("k") % 3 == 0, F.col("k") + 1).alias("output_reasoning_tokens"),
    )
    payload = F.when(
        is_expression,
        F.to_json(
            F.struct((F.col("user_id") % 5).alias("fold"), holdout.alias("holdout_ap"))
        ),
    ).otherwise(
        F.to_json(
            F.struct(
                F.concat(F.lit("rationale "), F.col("event_id").cast("string")).alias("rationale"),
                tokens.alias("usage"),
                tenth.alias("latency_s"),
            )
        )
    )
    return counted.select(
        "log",
        F.col("log").alias("arm"),
        "trial_index",
        F.parse_json(
            F.when(is_expression, F.to_json(expression))
            .when(is_logistic, F.to_json(logistic))
            .otherwise(F.to_json(forest))
        ).alias("params"),
        "mean_score",
        (F.col("k") / 1000).alias("std_score"),
        tenth.alias("wall_clock_s"),
        (elapsed / 1e6).alias("cumulative_s"),
        F.parse_json(payload).alias("payload"),
        "user_id",
        "k",
        "event_id",
        holdout.alias("holdout_ap"),
    )
