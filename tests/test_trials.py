import json
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.functions.params import params_text
from plumbline.operators import trials as T

SCHEMA = (
    "log string, trial_index long, mean_score double, std_score double, wall_clock_s double, "
    "cumulative_s double, p string, q string"
)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"params": F.parse_json("p"), "payload": F.parse_json("q")}).drop("p", "q")


def trial(log, index, score, params=None, payload=None, std=0.0, clock=1.0, total=60.0):
    return (log, index, score, std, clock, total, json.dumps(params or {}), json.dumps(payload or {}))


SCORES = {
    "optuna_seed0": [0.1, 0.5, 0.3, 0.9],
    "optuna_seed1": [0.4, 0.2, 0.9, 0.1],
    "optuna_seed2": [0.3, 0.3, 0.3, 0.3],
    "agent": [0.2, None, 0.8],
}


@pytest.fixture(scope="module")
def logs(spark):
    return frame(spark, [trial(l, i, s) for l, scores in SCORES.items() for i, s in enumerate(scores)])


def test_summary_and_budget(logs):
    rows = {r["log"]: r for r in T.log_summary(logs).collect()}
    assert rows["optuna_seed0"]["n"] == 4 and rows["agent"]["best"] == 0.8
    assert rows["agent"]["minutes"] == 1.0
    assert {r["log"]: r["remaining"] for r in T.budget_status(logs, 50).collect()}["agent"] == 47


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_best_so_far(logs, block):
    found = {(r["log"], r["trial_index"]): r["best_score"] for r in T.best_so_far(logs, block).collect()}
    for log, scores in SCORES.items():
        best = None
        for i, s in enumerate(scores):
            best = s if best is None else best if s is None else max(best, s)
            assert found[(log, i)] == best


def test_seed_band_and_lines(logs):
    best = T.best_so_far(logs)
    band = {r["trial_index"]: r for r in T.seed_band(best, "optuna_seed").collect()}
    assert (band[0]["low"], band[0]["median"], band[0]["high"]) == (0.1, 0.3, 0.4)
    assert (band[3]["low"], band[3]["median"], band[3]["high"]) == (0.3, 0.9, 0.9)
    labels = {r["label"] for r in T.comparison_lines(best, "optuna_seed", ["agent"]).collect()}
    assert labels == {"median of seeds", "agent"}


def test_spread_of_a_hot_key_is_the_exact_median(spark):
    rows = [("hot", float((i * 37) % 1000)) for i in range(1200)] + [("b", 2.0), ("b", 5.0), ("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r["median"] for r in T.spread(df, ["k"], "v").collect()}
    for key in "hot", "b", "c":
        assert found[key] == statistics.median(v for k, v in rows if k == key)


def test_best_seed_and_best_record_take_the_first_of_equals(spark, logs):
    row = T.best_log(logs, "optuna_seed").first()
    assert (row["log"], row["best_score"]) == ("optuna_seed0", 0.9)
    ties = frame(spark, [trial("x", 0, 0.1), trial("x", 1, 0.7), trial("x", 2, 0.7)])
    assert T.best_records(ties, ["trial_index", "mean_score"]).first()["trial_index"] == 1


def test_band_membership(spark):
    summary = spark.createDataFrame(
        [("optuna_seed0", 0.82, 0.81), ("optuna_seed1", 0.83, 0.82), ("agent", 0.834, 0.817), ("p", 0.3, 0.3)],
        "arm string, cv_mean double, holdout_ap double",
    )
    rows = {r["arm"]: r for r in T.band_membership(summary, "optuna_seed").collect()}
    assert set(rows) == {"agent", "p"}
    assert not rows["agent"]["cv_inside"] and rows["agent"]["holdout_inside"]
    assert not rows["p"]["holdout_inside"]


def expression(index, complexity, score, holdout=None, log="pysr"):
    return trial(
        log, index, score, {"complexity": complexity, "expression": f"expr_{complexity}_{index}"},
        {} if holdout is None else {"holdout_ap": holdout, "fold": index},
    )


def chosen(spark, rows):
    return T.full_coverage_entry(T.expression_records(frame(spark, rows)))


def test_full_coverage_beats_a_higher_single_score(spark):
    scores = {2: [0.1, 0.3, 0.2], 8: [0.25, 0.45, 0.35], 11: [0.7, 0.75], 13: [0.99]}
    rows = [(k, s) for k, each in scores.items() for s in each]
    row = chosen(spark, [expression(i, k, s, s / 2) for i, (k, s) in enumerate(rows)])
    assert row["complexity"] == 8 and row["folds_present"] == 3
    assert row["cv_mean"] == pytest.approx(0.35) and row["holdout_ap"] == pytest.approx(0.175)
    assert row["expression"] == "expr_8_5"


def test_full_coverage_ties_missing_holdouts_and_no_records(spark):
    row = chosen(spark, [expression(0, 9, 0.5), expression(1, 3, 0.5), expression(2, 1, 0.4)])
    assert row["complexity"] == 9 and row["holdout_ap"] is None
    row = chosen(spark, [expression(0, 9, 0.5, 0.2), expression(1, 9, 0.5)])
    assert row["holdout_ap"] == 0.2
    with pytest.raises(ValueError):
        chosen(spark, [])


def test_expression_tables(spark):
    rows = [expression(0, 5, 0.6), expression(1, 5, 0.2), expression(2, 5, 0.2), expression(3, 7, 0.9), expression(4, 1, 0.1)]
    records = T.expression_records(frame(spark, rows))
    top = T.top_expressions(records, 2).collect()
    assert [(r["complexity"], r["folds"]) for r in top] == [(7, 1), (5, 3)]
    assert top[1]["expression"] == "expr_5_2"
    latest = T.latest_expressions(records, 6).collect()
    assert [r["expression"] for r in latest] == ["expr_7_3", "expr_5_2", "expr_1_4"]
    pareto = {r["complexity"]: r for r in T.pareto(records).collect()}
    assert pareto[5]["cv"] == pytest.approx(1 / 3) and pareto[5]["holdout"] is None
    two = records.withColumn("iteration", F.lit(1)).unionByName(
        records.where("complexity <> 5").withColumn("iteration", F.lit(2))
    )
    rows = {r["iteration"]: r for r in T.compare_iterations(two).collect()}
    assert rows[1]["best_complexity"] == 5 and rows[1]["peak_cv"] == 0.9
    assert rows[2]["best_complexity"] == 7 and rows[2]["folds"] == 1


def test_usage_accumulates_and_absent_counters_are_zero(spark):
    payloads = [
        {"latency_s": 1.25, "usage": {"input_tokens": 10, "output_tokens": 5, "output_reasoning_tokens": 2}},
        {"latency_s": 0.5, "usage": {"input_tokens": 7, "output_tokens": 1}},
    ]
    df = frame(spark, [trial("agent", i, 0.5, {}, p) for i, p in enumerate(payloads)])
    usage = T.cumulative_usage(df).orderBy("trial_index").collect()
    assert [(r["input"], r["output"], r["reasoning"]) for r in usage] == [(10, 5, 2), (17, 6, 2)]
    long = T.usage_long(T.cumulative_usage(df))
    assert long.count() == 6
    assert long.where("kind = 'input' AND trial_index = 1").first()["cumulative_tokens"] == 17


LOGISTIC = {"estimator": "logistic", "use_interactions": False, "C": 10.0, "penalty": "l2", "class_weight": "balanced"}
FOREST = {"estimator": "random_forest", "n_estimators": 310, "max_depth": 14, "min_samples_leaf": 9,
          "max_features": "log2", "class_weight": "balanced"}


def test_numeric_params_skip_text_and_booleans(spark):
    df = frame(spark, [trial("s", 0, 0.1, LOGISTIC), trial("s", 1, 0.2, FOREST), trial("s", 2, 0.3, {})])
    rows = {(r["trial_index"], r["param"]): r["value"] for r in T.numeric_params(df).collect()}
    assert rows == {
        (0, "log10 C"): pytest.approx(1.0),
        (1, "n_estimators"): 310.0,
        (1, "max_depth"): 14.0,
        (1, "min_samples_leaf"): 9.0,
    }


def test_trajectories_pick_the_best_seed(spark):
    df = frame(spark, [trial("optuna_seed0", 0, 0.1, FOREST), trial("optuna_seed1", 0, 0.2, LOGISTIC),
                       trial("agent", 0, 0.9, FOREST), trial("pysr", 0, 1.0)])
    rows = {r["log"]: r["label"] for r in T.trajectories(df, "optuna_seed", "agent").collect()}
    assert rows == {"optuna_seed1": "best seed", "agent": "agent"}


def test_history_line_and_decision_trail(spark):
    odd = {"estimator": "logistic", "warm": None, "C": 3.0, "max_depth": "deep", "a b": [1, 2.5], "penalty": "l1"}
    df = frame(spark, [trial("agent", 0, 0.25, odd, {"latency_s": 0.75, "rationale": "why"}),
                       trial("agent", 31, 0.98765, FOREST, {"latency_s": 6.0}, std=0.04, clock=2.26)])
    lines = {r["trial_index"]: r["line"] for r in T.history_lines(df).collect()}
    text = '{"estimator":"logistic","C":3.0,"penalty":"l1","max_depth":"deep","a b":[1,2.5],"warm":null}'
    assert lines[0] == f"t00 | {text} | AP=0.2500 (+-0.0000) | 1.0s"
    assert lines[31].startswith('t31 | {"estimator":"random_forest","n_estimators":310,"max_depth":14,')
    trail = {r["trial"]: r for r in T.decision_trail(df).collect()}
    assert trail[0]["params"] == "{" + text.partition(",")[2] and trail[0]["latency_s"] == 0.8
    assert trail[0]["rationale"] == "why" and trail[31]["estimator"] == "random_forest"


def test_parameters_without_fields_or_object(spark):
    df = spark.createDataFrame([(0, "{}"), (1, "[1,2]"), (2, None), (3, '{"q\\"k":"v\\n"}')], "i int, p string")
    texts = df.select("i", params_text(F.parse_json("p")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in texts} == {0: "{}", 1: "[1,2]", 2: None, 3: '{"q\\"k":"v\\n"}'}


def test_lines_over_time_are_labelled(logs):
    lines = T.time_lines(T.best_so_far(logs), "optuna_seed", ["agent"]).collect()
    assert {(r["log"], r["label"]) for r in lines} == {
        ("optuna_seed0", "optuna seed"), ("optuna_seed1", "optuna seed"), ("optuna_seed2", "optuna seed"), ("agent", "agent")
    }
    assert T.time_lines(T.best_so_far(logs), "none", []).count() == 0


def test_numbering_counts_from_zero_per_log(spark):
    df = spark.createDataFrame([("a", 30), ("a", 10), ("b", 5), ("a", 20)], "log string, t int")
    rows = {(r["log"], r["t"]): r["trial_index"] for r in T.numbered(df, ["t"]).collect()}
    assert rows == {("a", 10): 0, ("a", 20): 1, ("a", 30): 2, ("b", 5): 0}


def test_reference_row_entries_and_leaderboard(spark):
    scores = spark.createDataFrame([("rules", 0.85)], "arm string, mean_score double")
    no_skill = spark.createDataFrame([(0.034,)], "prevalence double")
    assert T.with_reference_row(scores, no_skill).count() == 2
    first = spark.createDataFrame([("a", None, 0.50565), ("b", 0.8, None)], "arm string, cv_mean double, holdout_ap double")
    second = spark.createDataFrame([("pysr", 0.32, 0.8, 5)], "arm string, cv_mean double, holdout_ap double, folds_present long")
    rows = T.leaderboard(T.combine_entries(first, second)).collect()
    assert [r["arm"] for r in rows] == ["pysr", "a", "b"]
    assert rows[0]["folds_present"] == 5 and rows[1]["folds_present"] is None
    assert rows[1]["holdout_ap"] == 0.5056  # an exact tie goes to the even digit


def test_elapsed_minutes(logs):
    assert T.elapsed_minutes(T.best_so_far(logs)).where("cumulative_min <> 1.0").count() == 0
