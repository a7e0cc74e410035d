"""Threshold rules over sensor columns.

Every rule is a boolean column, false where an input is missing. Comparisons are strict and
on doubles: a decimal cast would move rows that lie on a limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.columns import holds, known

# Limits of the failure rules.
TEMPERATURE_GAP_K = 8.6
LOW_SPEED_RPM = 1380.0
POWER_FLOOR_W = 3500.0
POWER_CEILING_W = 9000.0
STRAIN_LIMITS = {"L": 11000, "M": 12000, "H": 13000}
RAD_PER_S_PER_RPM = 2.0 * math.pi / 60.0


@dataclass(frozen=True)
class Sensors:
    """Which columns the rules read."""

    air_temp: str = "air_temp"
    proc_temp: str = "proc_temp"
    rpm: str = "rpm"
    torque: str = "torque"
    tool_wear: str = "tool_wear"
    variant: str = "type"


@dataclass(frozen=True)
class Limits:
    """Rule limits, by default those of the sensor table."""

    temperature_gap: float = TEMPERATURE_GAP_K
    low_speed: float = LOW_SPEED_RPM
    power_floor: float = POWER_FLOOR_W
    power_ceiling: float = POWER_CEILING_W
    strain: dict[str, float] = field(default_factory=lambda: dict(STRAIN_LIMITS))


def process_power(sensors: Sensors = Sensors()) -> Column:
    """Mechanical power in watts."""
    return known(F.col(sensors.torque)) * known(F.col(sensors.rpm)) * F.lit(RAD_PER_S_PER_RPM)


def strain_limit(variant: Column, limits: dict[str, float]) -> Column:
    """Limit of a variant, NULL for an unknown one."""
    chosen = F.lit(None).cast("double")
    for name, limit in limits.items():
        chosen = F.when(variant == name, F.lit(float(limit))).otherwise(chosen)
    return chosen


def heat_rule(sensors: Sensors = Sensors(), limits: Limits = Limits()) -> Column:
    """Small temperature gap at low speed."""
    gap = known(F.col(sensors.proc_temp)) - known(F.col(sensors.air_temp))
    slow = known(F.col(sensors.rpm)) < limits.low_speed
    return holds((gap < limits.temperature_gap) & slow)


def power_rule(sensors: Sensors = Sensors(), limits: Limits = Limits()) -> Column:
    """Power outside its band; the bounds themselves pass."""
    power = process_power(sensors)
    return holds((power < limits.power_floor) | (power > limits.power_ceiling))


def strain_rule(sensors: Sensors = Sensors(), limits: Limits = Limits()) -> Column:
    """Wear times torque above the variant's limit."""
    load = known(F.col(sensors.tool_wear)) * known(F.col(sensors.torque))
    return holds(load > strain_limit(F.col(sensors.variant), limits.strain))


def any_rule(sensors: Sensors = Sensors(), limits: Limits = Limits()) -> Column:
    """1 where one of the three rules fires; wear-out and random failures follow no rule."""
    return (
        heat_rule(sensors, limits) | power_rule(sensors, limits) | strain_rule(sensors, limits)
    ).cast("int")
