"""Column names and types of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the raw sensor table and the short names used for them.
SENSOR_NAMES = {
    "Air temperature [K]": "air_temp",
    "Process temperature [K]": "proc_temp",
    "Rotational speed [rpm]": "rpm",
    "Torque [Nm]": "torque",
    "Tool wear [min]": "tool_wear",
}
FAILURE_NAMES = {
    "Machine failure": "machine_failure",
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
}
IDENTIFIER_NAMES = {"UDI": "udi", "Product ID": "product_id"}
VARIANT_NAME = {"Type": "type"}

SHORT_NAMES = {**IDENTIFIER_NAMES, **VARIANT_NAME, **SENSOR_NAMES, **FAILURE_NAMES}
REQUIRED_COLUMNS = [*SENSOR_NAMES, *FAILURE_NAMES, *VARIANT_NAME]
SENSORS = list(SENSOR_NAMES.values())

RAW_TYPES = {
    "UDI": T.LongType(),
    "Product ID": T.StringType(),
    "Type": T.StringType(),
    **{name: T.DoubleType() for name in SENSOR_NAMES},
    **{name: T.IntegerType() for name in FAILURE_NAMES},
}

TRIAL = T.StructType(
    [
        T.StructField("arm", T.StringType()),
        T.StructField("trial_index", T.LongType()),
        T.StructField("params", T.VariantType()),
        T.StructField("fold_scores", T.ArrayType(T.DoubleType())),
        T.StructField("mean_score", T.DoubleType()),
        T.StructField("std_score", T.DoubleType()),
        T.StructField("wall_clock_s", T.DoubleType()),
        T.StructField("cumulative_s", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("payload", T.VariantType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("arm", T.StringType()),
        T.StructField("best_params", T.VariantType()),
        T.StructField("cv_mean", T.DoubleType()),
        T.StructField("holdout_ap", T.DoubleType()),
        T.StructField("folds_present", T.LongType()),
    ]
)

ENVIRONMENT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("python", T.StringType()),
        T.StructField("packages", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cpu", T.StringType()),
        T.StructField("threads", T.IntegerType()),
        T.StructField("julia", T.StringType()),
        T.StructField("agent_model", T.StringType()),
    ]
)
