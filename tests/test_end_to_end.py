"""From a raw CSV to the summary of all arms, through files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.rules import any_rule
from plumbline.operators.candidates import Candidate, candidate_trials
from plumbline.operators.configs import sample_configs
from plumbline.operators.features import make_features, make_target
from plumbline.operators.models import Evaluation, default_logistic
from plumbline.operators.splits import assign_splits
from plumbline.operators.trials import best_so_far, leaderboard, log_summary, seed_band
from plumbline.plans import report as reports
from plumbline.schemas import FAILURE_NAMES, SENSORS, SHORT_NAMES
from plumbline.session import cut_lineage
from plumbline.sources.sensor_table import read_sensor_csv, short_names
from plumbline.sources.trial_logs import (
    append_trials,
    read_log_folder,
    read_summary,
    replace_trials,
    write_summary,
)


@pytest.fixture(scope="module")
def raw_csv(tmp_path_factory):
    draw = random.Random(11)
    path = tmp_path_factory.mktemp("raw") / "sensors.csv"
    with path.open("w", newline="", encoding="utf-8-sig") as out:
        writer = csv.writer(out)
        writer.writerow(SHORT_NAMES)
        for udi in range(1500):
            kind = draw.choices("LMH", [6, 3, 1])[0]
            air = round(draw.gauss(300, 2), 1)
            gap = round(draw.gauss(10, 1), 1)
            rpm = int(draw.gauss(1540, 180))
            torque = round(draw.gauss(40, 10), 1)
            failed = int(torque * rpm * 0.1047 > 8000 or draw.random() < 0.02)
            flags = [failed] + [0] * (len(FAILURE_NAMES) - 1)
            writer.writerow(
                [udi, f"{kind}{udi}", kind, air, round(air + gap, 1), rpm, torque, draw.randint(0, 250), *flags]
            )
    return str(path)


def test_whole_experiment(spark, raw_csv, tmp_path):
    raw = make_target(short_names(read_sensor_csv(spark, raw_csv)), "machine_failure")
    flagged = raw.withColumn("rule", any_rule())
    table = make_features(flagged, "udi", SENSORS, "type", keep=["machine_failure", "rule"])
    assert not set(table.columns) & {"twf", "hdf", "pwf", "osf", "rnf", "product_id"}
    split = cut_lineage(assign_splits(table, "udi", "machine_failure"))
    names = [*SENSORS, "type_H", "type_L", "type_M"]

    logs = str(tmp_path / "logs")
    found = candidate_trials(
        split, [Candidate("p", "torque * rpm", 3), Candidate("t", "torque", 1)], SENSORS, "machine_failure"
    )
    replace_trials(found, logs)
    with Evaluation(split, names, "machine_failure", keep=["rule"]) as evaluation:
        for seed in (0, 1):
            configs = sample_configs(spark.range(4), "id", seed).where("estimator = 'logistic'")
            reports.evaluate_configs(
                evaluation, configs, "id", f"optuna_seed{seed}", on_batch=lambda b: append_trials(b, logs)
            )
        trials = read_log_folder(spark, logs)
        baselines, summary = reports.report(evaluation, "rule", trials, [default_logistic()])
        replace_trials(baselines, logs)
        write_summary(summary, str(tmp_path / "summary"))

    counts = {r["log"]: r["n"] for r in log_summary(read_log_folder(spark, logs)).collect()}
    assert counts["pysr"] == 10 and counts["baselines"] == 2 and counts["optuna_seed0"] >= 1
    band = seed_band(best_so_far(read_log_folder(spark, logs)), "optuna_seed").collect()
    assert all(0 <= r["low"] <= r["median"] <= r["high"] <= 1 for r in band)
    rows = leaderboard(read_summary(spark, str(tmp_path / "summary"))).collect()
    assert {r["arm"] for r in rows} == {
        "baseline_default_logistic", "ground_truth_rules", "optuna_seed0", "optuna_seed1", "pysr"
    }
    assert all(0 <= r["holdout_ap"] <= 1 for r in rows)
    assert [r["holdout_ap"] for r in rows] == sorted((r["holdout_ap"] for r in rows), reverse=True)
    assert {r["arm"]: r["folds_present"] for r in rows}["pysr"] == 5
    assert split.where(F.col("machine_failure").isNull()).count() == 0
