"""Reading and writing trial logs, summaries and environment records.

A log is a set of lines, one JSON record each. Readers are strict: a line that is no record, lacks a
field, has an unknown one or a value of another type fails the job, or is set apart by the
functions that return rejects. Logs written here are batches of one folder, committed one by one
and partitioned by the log's name. Line-per-record files named after their log are read as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.schemas import ENVIRONMENT, SUMMARY, TRIAL
from plumbline.sources import commits

# Log names and what they hold.
BASELINE_LOG = "baselines"
SEED_PREFIX = "optuna_seed"
AGENT_LOG = "agent"
EXPRESSION_LOG = "pysr"


def _with_defaults(trials: DataFrame) -> DataFrame:
    absent = F.col("payload").isNull() | F.is_variant_null("payload")
    empty = F.parse_json(F.lit("{}"))
    return trials.withColumn("payload", F.when(absent, empty).otherwise(F.col("payload")))


FIELDS = [f.name for f in TRIAL.fields]
#: The one field that a record may leave out.
OPTIONAL = ["payload"]
BROKEN = "_broken"


def checked(lines: DataFrame) -> DataFrame:
    """Parse ``value`` into the record's fields; ``reason`` says why a line is no record.

    Other columns stay. The reasons name missing and unknown fields in alphabetical order.
    """
    known = F.array(*[F.lit(f) for f in FIELDS])
    required = F.array(*[F.lit(f) for f in FIELDS if f not in OPTIONAL])
    schema = T.StructType([*TRIAL.fields, T.StructField(BROKEN, T.StringType())])
    parsed = lines.withColumns(
        {
            "_keys": F.map_keys(F.from_json("value", "map<string,string>")),
            "_record": F.from_json("value", schema, {"columnNameOfCorruptRecord": BROKEN}),
        }
    )
    missing, unknown = F.array_except(required, "_keys"), F.array_except("_keys", known)

    def listed(what: str, names: Column) -> Column:
        return F.concat(F.lit(f"{what}: "), F.array_join(F.sort_array(names), ", "))

    reason = (
        F.when(F.col("_keys").isNull(), "not an object")
        .when(F.size(missing) > 0, listed("missing", missing))
        .when(F.size(unknown) > 0, listed("unknown", unknown))
        .when(F.col(f"_record.{BROKEN}").isNotNull(), "value of another type")
    )
    rest = [c for c in lines.columns if c != "value"]
    return parsed.withColumn("reason", reason).select(
        *[F.col(f"_record.{f}").alias(f) for f in FIELDS], *rest, "value", "reason"
    )


def records_only(lines: DataFrame) -> DataFrame:
    """The records of ``lines``; a line that is none fails the job and is told."""
    wrong = F.concat(F.col("reason"), F.lit(" in "), F.col("value"))
    fine = F.when(F.col("reason").isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))
    return _with_defaults(checked(lines).where(fine).drop("value", "reason"))


def records_and_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of ``lines``, and the lines that are none with the reason."""
    found = checked(lines)
    rejects = found.where(F.col("reason").isNotNull()).drop(*FIELDS)
    return _with_defaults(found.where(F.col("reason").isNull()).drop("value", "reason")), rejects


def log_lines(spark: SparkSession, pattern: str, baselines: bool = False) -> DataFrame:
    """Lines of ``<log>.jsonl`` files matching a glob, with the file's stem as the log's name.

    The baseline log is left out unless asked for.
    """
    # Spark gives the name as part of a URI, where a plus stands for itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_extract(name, r"^(.*)\.jsonl?$", 1)
    lines = spark.read.text(pattern).select("value", stem.alias("log"))
    return lines if baselines else lines.where(F.col("log") != BASELINE_LOG)


def read_log_files(spark: SparkSession, pattern: str, baselines: bool = False) -> DataFrame:
    """Read ``<log>.jsonl`` files matching a glob, all of whose lines must be records.

    File order is not kept; order by ``trial_index``.
    """
    return records_only(log_lines(spark, pattern, baselines))


def read_log_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Read what :func:`append_trials` and :func:`replace_trials` have committed."""
    return records_only(commits.read_batches(spark, folder, "log"))


def record_lines(trials: DataFrame, *keep: str) -> DataFrame:
    """Records as lines of JSON beside the log's name and other columns; a field that ``trials`` lacks is null."""
    given = set(trials.columns)
    fields = F.struct(
        *[
            F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name)
            for f in TRIAL.fields
        ]
    )
    line = F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")
    return trials.select(line, "log", *keep)


def append_trials(trials: DataFrame, folder: str, batch: str | None = None) -> bool:
    """Append a batch of records to their logs, whole or not at all.

    A batch whose id is committed already is not written again; then the result is False.
    """
    return commits.write_batch(record_lines(trials), folder, "log", batch)


def replace_trials(trials: DataFrame, folder: str, batch: str | None = None) -> bool:
    """Replace the logs present in ``trials``; other logs in the folder stay."""
    return commits.write_batch(record_lines(trials), folder, "log", batch, replaces=True)


def log_kind(log: Column) -> Column:
    """``parametric`` or ``expression``, NULL for a log that takes no part in the summary."""
    return F.when(log.startswith(SEED_PREFIX) | (log == AGENT_LOG), "parametric").when(
        log == EXPRESSION_LOG, "expression"
    )


def read_summary_array(spark: SparkSession, path: str) -> DataFrame:
    """Read summary rows from a file holding one JSON array."""
    return spark.read.schema(SUMMARY).option("multiLine", True).json(path)


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Read summary rows written by :func:`write_summary`."""
    return spark.read.schema(SUMMARY).json(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    """Write the summary, one object per row."""
    summary.write.mode("overwrite").json(folder)


def read_environment(spark: SparkSession, path: str) -> DataFrame:
    """Read an environment record (one JSON object)."""
    return spark.read.schema(ENVIRONMENT).option("multiLine", True).json(path)
