"""Tables of candidate configurations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import uniform_draw
from plumbline.functions.params import (
    C_SAMPLED,
    CLASS_WEIGHTS,
    FOREST,
    INTEGER_RANGES,
    LOGISTIC,
    MAX_FEATURES,
    PENALTIES,
    reasons,
)


def _choice(draw: Column, options: tuple[str, ...]) -> Column:
    position = F.floor(draw * len(options)).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), position)


def sample_configs(ids: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """One configuration per id, drawn from the space; the same id and seed give the same one.

    Branches, enumerations and integers are uniform, C is uniform in its logarithm.
    """

    def draw(name: str) -> Column:
        return uniform_draw(f"{seed}:{name}", F.col(row_id))

    low, high = (math.log(c) for c in C_SAMPLED)
    logistic = draw("estimator") < 0.5
    integers = {
        name: F.floor(draw(name) * (last - first + 1) + first).cast("int")
        for name, (first, last) in INTEGER_RANGES.items()
    }
    return ids.select(
        row_id,
        F.when(logistic, LOGISTIC).otherwise(FOREST).alias("estimator"),
        F.when(logistic, draw("use_interactions") < 0.5).alias("use_interactions"),
        F.when(logistic, F.exp(draw("C") * (high - low) + low)).alias("C"),
        F.when(logistic, _choice(draw("penalty"), PENALTIES)).alias("penalty"),
        *[F.when(~logistic, value).alias(name) for name, value in integers.items()],
        F.when(~logistic, _choice(draw("max_features"), MAX_FEATURES)).alias("max_features"),
        _choice(draw("class_weight"), CLASS_WEIGHTS).alias("class_weight"),
    )


def validate_configs(configs: DataFrame) -> DataFrame:
    """Add ``reasons`` and ``is_valid``."""
    return configs.withColumn("reasons", reasons()).withColumn(
        "is_valid", F.size("reasons") == 0
    )
