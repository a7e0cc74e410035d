import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions.params import (
    CONFIG_FIELDS,
    PARAM_TYPES,
    params_text,
    repaired,
    typed_params,
    usage,
)
from plumbline.operators.configs import sample_configs, validate_configs
from plumbline.operators.trials import repair_params

LOGISTIC = {"estimator": "logistic", "use_interactions": False, "C": 2.5, "penalty": "l2", "class_weight": "none"}
FOREST = {"estimator": "random_forest", "n_estimators": 75, "max_depth": 6, "min_samples_leaf": 3,
          "max_features": "sqrt", "class_weight": "balanced"}
SCHEMA = ", ".join(f"{f} {PARAM_TYPES[f]}" for f in CONFIG_FIELDS)

CASES = [
    (LOGISTIC, []),
    (FOREST, []),
    (LOGISTIC | {"C": 1e-9}, []),
    (LOGISTIC | {"C": 100.0}, []),
    (LOGISTIC | {"C": 350.0}, ["C"]),
    (LOGISTIC | {"C": 0.0}, ["C"]),
    (LOGISTIC | {"C": float("nan")}, ["C"]),
    (LOGISTIC | {"use_interactions": None, "penalty": "l3"}, ["use_interactions", "penalty"]),
    (FOREST | {"n_estimators": 7}, ["n_estimators"]),
    (FOREST | {"max_depth": 26, "min_samples_leaf": -4}, ["max_depth", "min_samples_leaf"]),
    (FOREST | {"max_features": None, "class_weight": "x"}, ["max_features", "class_weight"]),
    ({"estimator": "gradient_boosting"}, ["estimator"]),
    ({}, ["estimator"]),
]


def test_validation(spark):
    rows = [(i, *[c.get(f) for f in CONFIG_FIELDS]) for i, (c, _) in enumerate(CASES)]
    found = {r["id"]: r for r in validate_configs(spark.createDataFrame(rows, f"id int, {SCHEMA}")).collect()}
    for i, (_, reasons) in enumerate(CASES):
        assert found[i]["reasons"] == reasons and found[i]["is_valid"] == (not reasons)


def test_samples_are_valid_reproducible_and_cover_the_space(spark):
    ids = spark.range(4000)
    drawn = sample_configs(ids, "id").cache()
    assert validate_configs(drawn).where("NOT is_valid").count() == 0
    assert drawn.exceptAll(sample_configs(ids.repartition(3), "id")).count() == 0
    assert drawn.exceptAll(sample_configs(ids, "id", seed=1)).count() > 3900
    row = drawn.agg(
        F.avg((F.col("estimator") == "logistic").cast("int")).alias("share"),
        F.min("n_estimators").alias("lo"), F.max("n_estimators").alias("hi"),
        F.min("max_depth").alias("dlo"), F.max("max_depth").alias("dhi"),
        F.median(F.log10("C")).alias("mid"), F.min("C").alias("clo"), F.max("C").alias("chi"),
        F.count_distinct("max_features", "class_weight").alias("kinds"),
    ).first()
    assert abs(row["share"] - 0.5) < 0.05
    assert (row["lo"], row["hi"], row["dlo"], row["dhi"]) == (50, 400, 3, 20)
    assert abs(row["mid"] - -0.5) < 0.2 and 1e-3 <= row["clo"] and row["chi"] <= 100
    assert row["kinds"] == 9


def variants(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").select(
        "id", F.parse_json("t").alias("p")
    )


def test_typed_params_and_text(spark):
    df = variants(spark, [json.dumps(LOGISTIC), json.dumps(FOREST)])
    rows = df.orderBy("id").select(
        typed_params(F.col("p")).alias("s"), params_text(F.col("p"), ("estimator",)).alias("t")
    ).collect()
    assert {k: v for k, v in rows[0]["s"].asDict().items() if v is not None} == LOGISTIC
    assert json.loads(rows[1]["t"]) == {k: v for k, v in FOREST.items() if k != "estimator"}
    assert " " not in rows[1]["t"]


def test_double_encoded_params_are_decoded_or_rejected(spark):
    df = variants(spark, [json.dumps(FOREST), json.dumps(json.dumps(FOREST)), json.dumps("{no json")])
    rows = df.orderBy("id").select(F.to_json(repaired(F.col("p"))).alias("p")).collect()
    assert json.loads(rows[0]["p"]) == json.loads(rows[1]["p"]) == FOREST
    assert rows[2]["p"] is None


def test_records_with_broken_params_are_set_aside(spark):
    df = variants(spark, [json.dumps(FOREST), json.dumps(json.dumps(LOGISTIC)), json.dumps("{no")])
    good, rejects = repair_params(df.withColumnRenamed("p", "params"))
    rows = good.select("id", typed_params(F.col("params"))["estimator"].alias("e")).collect()
    assert sorted(tuple(r) for r in rows) == [(0, "random_forest"), (1, "logistic")]
    assert [r["id"] for r in rejects.select("id").collect()] == [2]


@pytest.mark.parametrize("payload, expected", [('{"usage":{"a":3}}', 3), ('{"usage":{}}', 0), ("{}", 0)])
def test_usage_defaults_to_zero(spark, payload, expected):
    assert variants(spark, [payload]).select(usage(F.col("p"), "a").alias("u")).first()["u"] == expected
