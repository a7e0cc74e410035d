import json

import pytest
from pyspark.sql import functions as F

from plumbline.schemas import REQUIRED_COLUMNS, SHORT_NAMES
from plumbline.sources import commits, trial_logs
from plumbline.sources.sensor_table import read_sensor_csv, sensor_rows_and_rejects, short_names

HEADER = list(SHORT_NAMES)
ROW = ["1", "M14860", "M", "298.1", "308.6", "1551", "42.8", "0", "0", "0", "0", "0", "0", "0"]


def write_csv(path, header=HEADER, rows=(ROW,), bom=False):
    text = "\n".join(",".join(r) for r in (header, *rows)) + "\n"
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return str(path)


def test_header_order_comes_from_names(spark, tmp_path):
    by_name = dict(zip(["UDI", "Product ID", "Type", *REQUIRED_COLUMNS[:-1]], ROW))
    header = list(reversed(HEADER))
    path = write_csv(tmp_path / "t.csv", header, [[by_name[h] for h in header]], bom=True)
    row = short_names(read_sensor_csv(spark, path)).first()
    assert row["udi"] == 1 and row["type"] == "M" and row["product_id"] == "M14860"
    assert row["rpm"] == 1551.0 and row["air_temp"] == 298.1 and row["machine_failure"] == 0


def test_missing_columns_are_listed_sorted(spark, tmp_path):
    header = [h for h in HEADER if h not in ("Type", "HDF")]
    path = write_csv(tmp_path / "t.csv", header, [ROW[: len(header)]])
    with pytest.raises(ValueError, match=r"\['HDF', 'Type'\]"):
        read_sensor_csv(spark, path)


def test_swapped_header_and_bad_rows(spark, tmp_path):
    write_csv(tmp_path / "a.csv", rows=[ROW, [*ROW[:5], "fast", *ROW[6:]], ROW[:9], [*ROW, "more"], [*ROW[:6], "", *ROW[7:]]])
    good, rejects = sensor_rows_and_rejects(spark, str(tmp_path / "a.csv"))
    assert sorted(r["Torque [Nm]"] or 0 for r in good.collect()) == [0, 42.8]
    assert good.count() == 2 and rejects.count() == 3
    assert {r["file"] for r in rejects.collect()} == {"a.csv"}
    assert [r["line"] for r in rejects.where("line LIKE '%fast%'").collect()] == [",".join([*ROW[:5], "fast", *ROW[6:]])]
    with pytest.raises(Exception, match="not a row of the table"):
        read_sensor_csv(spark, str(tmp_path / "a.csv")).select("Type").collect()
    folder = tmp_path / "two"
    folder.mkdir()
    write_csv(folder / "a.csv")
    assert read_sensor_csv(spark, str(folder)).count() == 1
    write_csv(folder / "b.csv", [HEADER[1], HEADER[0], *HEADER[2:]], [[ROW[1], ROW[0], *ROW[2:]]])
    with pytest.raises(Exception, match="header"):
        read_sensor_csv(spark, str(folder)).collect()


def test_lines_that_are_no_records(spark, tmp_path):
    whole = record(0, mean_score=float("nan"))
    absent = {k: v for k, v in record(1).items() if k not in ("arm", "timestamp")}
    lines = [json.dumps(r) for r in (whole, absent, record(2, budget=3), record("two"), record(4, payload=None))]
    lines += [json.dumps(record(5))[:-9], "", "[1]", json.dumps({k: v for k, v in record(8).items() if k != "payload"})]
    (tmp_path / "agent.jsonl").write_text("\n".join(lines) + "\n")
    found = trial_logs.log_lines(spark, f"{tmp_path}/*.jsonl")
    good, rejects = trial_logs.records_and_rejects(found)
    assert sorted(r["trial_index"] for r in good.select("trial_index").collect()) == [0, 4, 8]
    assert good.where("isnan(mean_score)").count() == 1 and good.where("payload IS NULL").count() == 0
    assert sorted(r["reason"] for r in rejects.collect()) == sorted([
        "missing: arm, timestamp", "unknown: budget", "value of another type", *["not an object"] * 3,
    ])
    with pytest.raises(Exception, match="in "):
        trial_logs.read_log_files(spark, f"{tmp_path}/*.jsonl").select("arm").collect()


def test_a_batch_is_seen_once_or_not_at_all(spark, tmp_path):
    write_log(tmp_path, "agent", [record(0), record(1)])
    write_log(tmp_path, "a=b +c%", [record(7)])
    trials = trial_logs.read_log_files(spark, f"{tmp_path}/*.jsonl")
    folder = str(tmp_path / "logs")
    assert trial_logs.read_log_folder(spark, folder).count() == 0
    assert trial_logs.append_trials(trials, folder, "first/1")
    assert not trial_logs.append_trials(trials, folder, "first/1")
    failing = trials.withColumn("arm", F.when(F.col("trial_index") > 0, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        trial_logs.append_trials(failing, folder, "second")
    back = trial_logs.read_log_folder(spark, folder)
    assert sorted(tuple(r) for r in back.select("log", "trial_index").collect()) == [("a=b +c%", 7), ("agent", 0), ("agent", 1)]
    assert trial_logs.append_trials(trials.where("trial_index = 1"), folder, "second")
    assert trial_logs.append_trials(trials.where("false"), folder)
    assert trial_logs.read_log_folder(spark, folder).count() == 4
    assert commits.compact(spark, folder, "log") and not commits.compact(spark, folder + "x", "log")
    before = sorted(map(str, trial_logs.read_log_folder(spark, folder).select("log", "trial_index").collect()))
    assert len(before) == 4 and commits.remove_hidden(spark, folder) >= 3
    assert sorted(map(str, trial_logs.read_log_folder(spark, folder).select("log", "trial_index").collect())) == before


def record(index=3, **changes):
    return {
        "arm": "optuna",
        "trial_index": index,
        "params": {"estimator": "random_forest", "max_depth": 17},
        "fold_scores": [0.125, 0.375, 0.25],
        "mean_score": 0.25,
        "std_score": 0.125,
        "wall_clock_s": 7.75,
        "cumulative_s": 93.0,
        "timestamp": "2025-02-17T06:45:30+00:00",
        "payload": {"rationale": "less shrinkage", "usage": {"requests": 4}},
        **changes,
    }


def write_log(folder, name, records):
    (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))


def test_log_files_are_named_by_stem_and_baselines_left_out(spark, tmp_path):
    write_log(tmp_path, "optuna_seed0", [record(0), record(1)])
    write_log(tmp_path, "agent", [record(0, payload=None)])
    write_log(tmp_path, "baselines", [record(0)])
    (tmp_path / "iteration2").mkdir()
    write_log(tmp_path / "iteration2", "pysr", [record(0)])
    trials = trial_logs.read_log_files(spark, f"{tmp_path}/*.jsonl")
    counts = {r["log"]: r["count"] for r in trials.groupBy("log").count().collect()}
    assert counts == {"optuna_seed0": 2, "agent": 1}
    everything = trial_logs.read_log_files(spark, f"{tmp_path}/*.jsonl", baselines=True)
    assert everything.count() == 4
    row = trials.where("log = 'optuna_seed0' AND trial_index = 1").select(
        F.try_variant_get("params", "$.max_depth", "int").alias("depth"),
        F.to_json("payload").alias("payload"),
        "fold_scores",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("at"),
    ).first()
    assert row["depth"] == 17 and row["fold_scores"][2] == 0.25 and row["at"] == "2025-02-17 06:45"
    assert json.loads(row["payload"])["usage"] == {"requests": 4}
    empty = trials.where("log = 'agent'").select(F.to_json("payload").alias("p")).first()
    assert empty["p"] == "{}"


def test_appended_logs_read_back_and_are_replaced_one_by_one(spark, tmp_path):
    write_log(tmp_path, "optuna_seed0", [record(0), record(1)])
    write_log(tmp_path, "agent", [record(0)])
    trials = trial_logs.read_log_files(spark, f"{tmp_path}/*.jsonl")
    folder = str(tmp_path / "logs")
    trial_logs.replace_trials(trials, folder)
    trial_logs.append_trials(trials.where("log = 'agent'").withColumn("trial_index", F.lit(1)), folder)
    back = trial_logs.read_log_folder(spark, folder)
    key = ["log", "trial_index"]
    assert sorted(tuple(r) for r in back.select(key).collect()) == [
        ("agent", 0), ("agent", 1), ("optuna_seed0", 0), ("optuna_seed0", 1),
    ]
    columns = [*key, "arm", "fold_scores", "mean_score", "timestamp",
               F.to_json("params").alias("params"), F.to_json("payload").alias("payload")]
    before = trials.select(columns).orderBy(key).collect()
    after = back.where("NOT (log = 'agent' AND trial_index = 1)").select(columns).orderBy(key).collect()
    assert before == after
    trial_logs.replace_trials(trials.where("log = 'agent'"), folder)
    counts = {r["log"]: r["count"] for r in
              trial_logs.read_log_folder(spark, folder).groupBy("log").count().collect()}
    assert counts == {"optuna_seed0": 2, "agent": 1}


def test_routing(spark):
    names = ["optuna_seed3", "agent", "pysr", "agent2", "baselines", "optuna"]
    df = spark.createDataFrame([(n,) for n in names], "log string")
    kinds = [r[0] for r in df.select(trial_logs.log_kind(F.col("log"))).collect()]
    assert kinds == ["parametric", "parametric", "expression", None, None, None]


def test_summary_and_environment(spark, tmp_path):
    entries = [
        {"arm": "ground_truth_rules", "best_params": {"expression": "hdf | pwf | osf"},
         "cv_mean": None, "holdout_ap": 0.84},
        {"arm": "pysr", "best_params": {"complexity": 9, "expression": "x"}, "cv_mean": 0.32,
         "holdout_ap": 0.36, "folds_present": 5},
    ]
    (tmp_path / "holdout.json").write_text(json.dumps(entries, indent=2) + "\n")
    summary = trial_logs.read_summary_array(spark, str(tmp_path / "holdout.json"))
    trial_logs.write_summary(summary, str(tmp_path / "summary"))
    back = trial_logs.read_summary(spark, str(tmp_path / "summary"))
    for df in (summary, back):
        rows = {r["arm"]: r for r in df.drop("best_params").collect()}
        assert rows["pysr"]["folds_present"] == 5 and rows["pysr"]["cv_mean"] == 0.32
        assert rows["ground_truth_rules"]["cv_mean"] is None
    (tmp_path / "environment.json").write_text(
        json.dumps({"timestamp": "2026-08-31T17:00:00+00:00", "python": "3.12.12",
                    "packages": {"numpy": "2.0"}, "cpu": "c", "threads": 1, "julia": None,
                    "agent_model": "m"}, indent=2)
    )
    row = trial_logs.read_environment(spark, str(tmp_path / "environment.json")).first()
    assert row["threads"] == 1 and row["packages"] == {"numpy": "2.0"} and row["julia"] is None
