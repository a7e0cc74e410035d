import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.rules import any_rule, heat_rule, power_rule, process_power, strain_rule

SCHEMA = "type string, air_temp double, proc_temp double, rpm double, torque double, tool_wear double"
QUIET = dict(type="M", air_temp=300.0, proc_temp=310.0, rpm=1500.0, torque=40.0, tool_wear=100.0)


def verdict(spark, rule, **changes):
    row = {**QUIET, **changes}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)
    return df.select(rule.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "air, proc, rpm, expected",
    [
        (300.0, 308.5, 1379.0, True),
        (300.0, 308.5, 1380.0, False),
        (300.0, 308.6, 1300.0, False),
        (302.3, 310.9, 1300.0, True),
    ],
)
def test_heat_boundaries(spark, air, proc, rpm, expected):
    assert verdict(spark, heat_rule(), air_temp=air, proc_temp=proc, rpm=rpm) is expected


@pytest.mark.parametrize(
    "torque, rpm, expected",
    [(20.0, 1671.0, True), (20.0, 1672.0, False), (60.0, 1432.0, False), (60.0, 1433.0, True)],
)
def test_power_boundaries(spark, torque, rpm, expected):
    assert verdict(spark, power_rule(), torque=torque, rpm=rpm) is expected


@pytest.mark.parametrize(
    "kind, wear, expected",
    [
        ("L", 220.0, False),
        ("L", 221.0, True),
        ("M", 240.0, False),
        ("M", 241.0, True),
        ("H", 260.0, False),
        ("H", 261.0, True),
        ("X", 1000.0, False),
        (None, 1000.0, False),
    ],
)
def test_strain_boundaries(spark, kind, wear, expected):
    assert verdict(spark, strain_rule(), type=kind, tool_wear=wear, torque=50.0) is expected


@pytest.mark.parametrize("missing", [None, math.nan])
def test_missing_sensor_never_fires(spark, missing):
    assert verdict(spark, heat_rule(), air_temp=missing, proc_temp=1.0, rpm=1.0) is False
    assert verdict(spark, power_rule(), torque=missing) is False
    assert verdict(spark, strain_rule(), tool_wear=missing) is False
    assert verdict(spark, any_rule(), torque=missing) == 0


def test_any_rule_is_the_disjunction(spark):
    assert verdict(spark, any_rule()) == 0
    assert verdict(spark, any_rule(), torque=1.0) == 1
    assert verdict(spark, process_power(), torque=20.0, rpm=1671.0) == pytest.approx(3499.73, abs=0.01)


def test_rules_stay_in_generated_code(spark):
    df = spark.range(10).select(
        *[F.col("id").cast("double").alias(c) for c in ("air_temp", "proc_temp", "rpm", "torque", "tool_wear")],
        F.lit("L").alias("type"),
    )
    assert "Python" not in df.select(any_rule())._jdf.queryExecution().toString()
