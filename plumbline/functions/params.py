"""Configuration parameters: extraction, text form, repair and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two branches of the search space.
LOGISTIC = "logistic"
FOREST = "random_forest"
PENALTIES = ("l1", "l2")
CLASS_WEIGHTS = ("none", "balanced", "balanced_subsample")
MAX_FEATURES = ("sqrt", "log2", "all")
INTEGER_RANGES = {"n_estimators": (50, 400), "max_depth": (3, 20), "min_samples_leaf": (1, 20)}
C_SAMPLED = (1e-3, 1e2)
C_CEILING = 100.0

# Every parameter field with its type, in the order records state them.
PARAM_TYPES = {
    "estimator": "string",
    "use_interactions": "boolean",
    "C": "double",
    "penalty": "string",
    "n_estimators": "int",
    "max_depth": "int",
    "min_samples_leaf": "int",
    "max_features": "string",
    "class_weight": "string",
    "complexity": "int",
    "expression": "string",
}
CONFIG_FIELDS = [f for f in PARAM_TYPES if f not in ("complexity", "expression")]


def param(params: Column, name: str, kind: str | None = None) -> Column:
    """One field of a parameter variant, NULL when absent or of another type."""
    return F.try_variant_get(params, f"$.{name}", kind or PARAM_TYPES[name])


def typed_params(params: Column) -> Column:
    """All known fields as a struct."""
    return F.struct(*[param(params, name).alias(name) for name in PARAM_TYPES])


def params_text(params: Column, without: tuple[str, ...] = ()) -> Column:
    """Compact JSON of all fields: the known ones in their usual order, then the others by name.

    Values are printed as they are, whatever their type; fractions as doubles. A null field and
    one that isn't listed stay. Parameters that are no object are printed as they are.
    """
    fields = F.filter(
        F.map_entries(F.try_variant_get(params, "$", "map<string,variant>")),
        lambda e: ~e["key"].isin(*without) if without else F.lit(True),
    )
    usual = F.array(*[F.lit(n) for n in PARAM_TYPES])

    def placed(e: Column) -> Column:
        place = F.array_position(usual, e["key"])
        return F.struct(
            F.when(place > 0, place).otherwise(len(PARAM_TYPES) + 1).alias("place"),
            e["key"].alias("key"),
            F.concat(_json_text(e["key"]), F.lit(":"), _value_text(e["value"])).alias("text"),
        )

    texts = F.transform(F.array_sort(F.transform(fields, placed)), lambda e: e["text"])
    whole = F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))
    return F.coalesce(whole, F.to_json(params))


def _json_text(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _value_text(value: Column) -> Column:
    """JSON of a variant; ``1.0`` is kept as a decimal without places, hence the way over double."""
    number = F.try_variant_get(value, "$", "double")
    fraction = F.schema_of_variant(value).startswith("DECIMAL") & (F.abs(number) < 1e15)
    return F.when(fraction, number.cast("string")).otherwise(F.coalesce(F.to_json(value), F.lit("null")))


def usage(payload: Column, name: str) -> Column:
    """A token counter of the payload, 0 when absent."""
    return F.coalesce(F.try_variant_get(payload, f"$.usage.{name}", "long"), F.lit(0))


def repaired(params: Column) -> Column:
    """Decode parameters that hold an object as a JSON string; NULL if it does not parse."""
    is_text = F.schema_of_variant(params) == "STRING"
    decoded = F.try_parse_json(F.try_variant_get(params, "$", "string"))
    return F.when(is_text, decoded).otherwise(params)


def reasons(fields: dict[str, Column] | None = None) -> Column:
    """Names of the fields that put a configuration outside the space; empty when valid.

    Reads the columns named like the fields unless given others.
    """
    f = {name: F.col(name) for name in CONFIG_FIELDS} | (fields or {})
    logistic = f["estimator"] == LOGISTIC
    forest = f["estimator"] == FOREST

    def unless(ok: Column, name: str, branch: Column) -> Column:
        return F.when(branch & ~F.coalesce(ok, F.lit(False)), F.lit(name))

    known = F.coalesce(logistic | forest, F.lit(False))
    checks = [
        F.when(~known, F.lit("estimator")),
        unless(f["use_interactions"].isNotNull(), "use_interactions", logistic),
        unless((f["C"] > 0.0) & (f["C"] <= C_CEILING), "C", logistic),
        unless(f["penalty"].isin(*PENALTIES), "penalty", logistic),
        *[
            unless(f[name].between(low, high), name, forest)
            for name, (low, high) in INTEGER_RANGES.items()
        ],
        unless(f["max_features"].isin(*MAX_FEATURES), "max_features", forest),
        unless(f["class_weight"].isin(*CLASS_WEIGHTS), "class_weight", known),
    ]
    return F.array_compact(F.array(*checks))
