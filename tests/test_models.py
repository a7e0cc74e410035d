import json

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from plumbline.operators import logistic
from plumbline.operators.configs import sample_configs
from plumbline.operators.models import (
    MAX_DEPTH,
    Evaluation,
    build_model,
    default_forest,
    default_logistic,
    forest_model,
    logistic_model,
)
from plumbline.operators.ranking import average_precision
from plumbline.operators.splits import assign_splits
from plumbline.plans import report as reports
from plumbline.sources.trial_logs import append_trials, read_log_folder

FEATURES = ["a", "b", "c"]
LOGISTIC = {"estimator": "logistic", "use_interactions": False, "C": 0.7, "penalty": "l2", "class_weight": "none"}
FOREST = {"estimator": "random_forest", "n_estimators": 75, "max_depth": 6, "min_samples_leaf": 3,
          "max_features": "sqrt", "class_weight": "balanced"}


@pytest.fixture(scope="module")
def table(spark):
    def noise(i):
        return (F.xxhash64("id", F.lit(i)) % 1000) / 1000.0

    df = spark.range(1200).select(
        "id", noise(1).alias("a"), (noise(2) * 40 + 300).alias("b"), noise(3).alias("c"), noise(4).alias("e")
    )
    label = (F.col("a") + (F.col("b") - 300) / 60 + F.col("e") * 0.4 > 0.8).cast("int")
    df = df.select("id", *FEATURES, label.alias("y"), (F.col("a") > 0.5).cast("int").alias("flag"))
    return assign_splits(df, "id", "y").cache()


@pytest.fixture(scope="module")
def evaluation(table):
    with Evaluation(table, FEATURES, "y", keep=["flag"]) as e:
        yield e


def newton(x, y, w, c):
    """Reference solution: unpenalised intercept, sum of weighted losses times c."""
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = c * design.T @ (w * (p - y)) + ridge @ beta
        hessian = c * (design * (w * p * (1 - p))[:, None]).T @ design + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return beta


@pytest.mark.parametrize("mode", ["none", "balanced"])
def test_logistic_probabilities_match_an_independent_solution(table, evaluation, mode):
    model = logistic_model(LOGISTIC | {"class_weight": mode})
    found = sorted(r["score"] for r in evaluation.fold_scores(model, 2).collect())
    rows = table.where("NOT is_holdout").select("fold", "y", *FEATURES).collect()
    fit = [r for r in rows if r["fold"] != 2]
    x = np.array([[r[f] for f in FEATURES] for r in fit])
    y = np.array([r["y"] for r in fit])
    w = np.ones(len(y)) if mode == "none" else len(y) / (2 * np.where(y == 1, y.sum(), (1 - y).sum()))
    mean, deviation = x.mean(0), x.std(0)
    beta = newton((x - mean) / deviation, y, w, LOGISTIC["C"])
    z = (np.array([[r[f] for f in FEATURES] for r in rows if r["fold"] == 2]) - mean) / deviation
    expected = sorted(1 / (1 + np.exp(-(z @ beta[:-1] + beta[-1]))))
    assert found == pytest.approx(expected, abs=2e-4)


def test_parameters_reach_the_estimators():
    logistic = logistic_model(LOGISTIC | {"penalty": "l1", "C": 2.0}).estimator(500)
    assert logistic.getElasticNetParam() == 1.0 and logistic.getRegParam() == 1 / 1000
    assert not logistic.getStandardization() and logistic.getMaxIter() == 1000
    assert logistic_model(LOGISTIC).estimator(5).getElasticNetParam() == 0.0
    assert build_model(LOGISTIC | {"class_weight": "balanced_subsample"}).balanced
    assert build_model(LOGISTIC | {"use_interactions": True}).interactions
    forest = build_model(FOREST, seed=3).estimator(5)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (75, 6, 3)
    assert forest.getFeatureSubsetStrategy() == "sqrt" and forest.getSeed() == 3
    assert default_forest().estimator(5).getMaxDepth() == MAX_DEPTH
    assert not default_forest().scaled and default_logistic().scaled
    with pytest.raises(ValueError):
        build_model({"estimator": "gradient_boosting"})


def test_cross_validation_records(evaluation):
    models = [default_logistic(), logistic_model(LOGISTIC | {"use_interactions": True}), forest_model(FOREST)]
    rows = {r["trial_index"]: r for r in evaluation.cross_validate(models).collect()}
    assert set(rows) == {0, 1, 2}
    for r in rows.values():
        assert len(r["fold_scores"]) == 5 and all(0 <= s <= 1 for s in r["fold_scores"])
        assert r["mean_score"] == pytest.approx(np.mean(r["fold_scores"]))
        assert r["std_score"] == pytest.approx(np.std(r["fold_scores"]))
        assert r["mean_score"] > 0.7 and r["wall_clock_s"] > 0
    assert rows[0]["arm"] == "baseline_default_logistic"


def test_two_folds(table):
    two = table.withColumn("fold", F.col("fold") % 2)
    with Evaluation(two, FEATURES, "y", folds=2) as e:
        assert len(e.cross_validate([default_logistic()]).first()["fold_scores"]) == 2


def test_configs_are_evaluated_in_order_and_logged(spark, evaluation, tmp_path):
    configs = sample_configs(spark.range(6), "id", seed=5).withColumn(
        "n_estimators", F.when(F.col("n_estimators").isNotNull(), F.lit(50))
    ).withColumn("max_depth", F.when(F.col("max_depth").isNotNull(), F.lit(4)))
    configs = configs.withColumn("C", F.when(F.col("id") == 0, F.lit(-1.0)).otherwise(F.col("C")))
    expected = configs.where("id > 0 OR estimator <> 'logistic'").count()
    folder = str(tmp_path / "logs")
    records = reports.evaluate_configs(
        evaluation, configs, "id", "optuna_seed0", on_batch=lambda b: append_trials(b, folder)
    )
    rows = records.orderBy("trial_index").collect()
    assert [r["trial_index"] for r in rows] == list(range(expected))
    assert all(r["cumulative_s"] >= r["wall_clock_s"] > 0 for r in rows)
    assert all(len(r["fold_scores"]) == 5 for r in rows)
    assert read_log_folder(spark, folder).where("log = 'optuna_seed0'").count() == expected
    with pytest.raises(ValueError):
        reports.evaluate_configs(evaluation, configs.where("false"), "id", "x")


def test_report(spark, evaluation):
    def row(log, index, score, params, payload="{}"):
        return (log, index, score, json.dumps(params), payload)

    trials = spark.createDataFrame(
        [
            row("optuna_seed0", 0, 0.4, LOGISTIC),
            row("optuna_seed0", 1, 0.6, FOREST),
            row("agent", 0, 0.5, LOGISTIC),
            row("pysr", 0, 0.3, {"complexity": 3, "expression": "a"}, '{"holdout_ap":0.2}'),
            row("other", 0, 0.9, LOGISTIC),
        ],
        "log string, trial_index long, mean_score double, p string, q string",
    ).withColumns({"params": F.parse_json("p"), "payload": F.parse_json("q")})
    models = [default_logistic()]
    baselines, summary = reports.report(evaluation, "flag", trials, models)
    assert {r["arm"] for r in baselines.select("arm").collect()} == {
        "baseline_default_logistic", "ground_truth_rules"
    }
    assert baselines.where("size(fold_scores) <> 5").count() == 0
    rows = {r["arm"]: r for r in summary.withColumn("best_params", F.to_json("best_params")).collect()}
    assert set(rows) == {"baseline_default_logistic", "ground_truth_rules", "optuna_seed0", "agent", "pysr"}
    assert rows["optuna_seed0"]["cv_mean"] == 0.6 and rows["baseline_default_logistic"]["cv_mean"] is None
    assert json.loads(rows["optuna_seed0"]["best_params"]) == FOREST
    assert rows["pysr"]["folds_present"] == 1 and rows["agent"]["folds_present"] is None
    assert all(0 <= r["holdout_ap"] <= 1 for r in rows.values())


def joint_parts(table, evaluation, products):
    """Rows of the search part and the design of each fold's own scale, in numpy."""
    rows = table.where("NOT is_holdout").select("fold", "y", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y, fold = np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])

    def design(k):
        z = (x - x[fold != k].mean(0)) / x[fold != k].std(0)
        if products:
            z = np.hstack([z, *[(z[:, i] * z[:, j])[:, None] for i in range(3) for j in range(i + 1, 3)]])
        return z

    return design, y, fold


@pytest.mark.parametrize("mode", ["none", "balanced"])
@pytest.mark.parametrize("products", [False, True])
def test_joint_fits_match_an_independent_solution(table, evaluation, mode, products):
    params = LOGISTIC | {"class_weight": mode, "use_interactions": products}
    fits = [logistic_model(params).joint(k) for k in range(5)]
    scored = evaluation.joint.scores(fits, evaluation.joint.fitted(fits), False).collect()
    design, y, fold = joint_parts(table, evaluation, products)
    for k in range(5):
        z, fit = design(k), fold != k
        n, ones = fit.sum(), y[fit].sum()
        w = np.ones(n) if mode == "none" else n / (2 * np.where(y[fit] == 1, ones, n - ones))
        beta = newton(z[fit], y[fit], w, LOGISTIC["C"])
        expected = sorted(1 / (1 + np.exp(-(z[~fit] @ beta[:-1] + beta[-1]))))
        assert sorted(r["score"] for r in scored if r["fit"] == k) == pytest.approx(expected, abs=1e-7)


@pytest.mark.parametrize("c", [0.01, 0.5])
def test_joint_lasso_meets_its_conditions(table, evaluation, c):
    fit = logistic_model(LOGISTIC | {"penalty": "l1", "C": c, "use_interactions": True}).joint(3)
    own, whole = evaluation.statistics[3], evaluation.statistics[-1]
    beta = np.linalg.solve(logistic.scaled_by(own, whole, FEATURES, True), evaluation.joint.fitted([fit])[0])
    design, y, fold = joint_parts(table, evaluation, True)
    z = np.insert(design(3)[fold != 3], 3, 1.0, axis=1)
    gradient = z.T @ (1 / (1 + np.exp(-z @ beta)) - y[fold != 3])
    assert abs(gradient[3]) < 1e-4
    for j in (0, 1, 2, 4, 5, 6):
        if abs(beta[j]) > 1e-9:
            assert gradient[j] == pytest.approx(-np.sign(beta[j]) / c, abs=1e-3)
        else:
            assert abs(gradient[j]) <= 1 / c + 1e-3
    assert (np.abs(beta) < 1e-9).any()


def test_joint_and_single_fits_rank_alike(evaluation):
    models = [default_logistic(), logistic_model(LOGISTIC | {"penalty": "l1", "C": 5.0}, "lasso")]
    single = [average_precision(evaluation.fold_scores(m, 1), "_y", "score").first()["ap"] for m in models]
    before = evaluation.joint.jobs
    rows = evaluation.cross_validate(models).orderBy("trial_index").collect()
    assert [r["fold_scores"][1] for r in rows] == pytest.approx(single, abs=1e-6)
    assert evaluation.joint.jobs - before < 20
    assert all(r["cumulative_s"] >= r["wall_clock_s"] > 0 for r in rows)


def test_one_class_has_no_score(spark, table):
    alone = table.withColumn("y", F.lit(0))
    with Evaluation(alone, FEATURES, "y") as e:
        assert e.cross_validate([default_logistic()]).first()["fold_scores"] == [None] * 5


def test_missing_values_and_weights_are_refused(table):
    with pytest.raises(ValueError, match="class weight"):
        logistic_model(LOGISTIC | {"class_weight": None})
    gaps = table.withColumn("a", F.when(F.col("id") != 17, F.col("a")))
    with Evaluation(gaps, FEATURES, "y") as e, pytest.raises(Exception, match="missing values"):
        e.cross_validate([default_logistic()])


def test_large_fit_parts_are_sampled(table):
    small = forest_model(FOREST | {"n_estimators": 50})
    with Evaluation(table, FEATURES, "y", row_id="id", max_fit_rows=300, fit_partitions=3) as e:
        search = e.table.where("NOT is_holdout AND fold <> 2")
        part = e._fit_part(search, 2)
        assert part.count() == 300 and part.rdd.getNumPartitions() == 3
        share = search.agg(F.avg("y")).first()[0]
        assert part.agg(F.avg("y")).first()[0] == pytest.approx(share, abs=0.01)
        assert e.cross_validate([small]).first()["mean_score"] > 0.7
    with Evaluation(table, FEATURES, "y", max_fit_rows=300) as e, pytest.raises(ValueError, match="row_id"):
        e.cross_validate([small])


def test_written_tables_are_deleted(spark, table):
    from pathlib import Path

    from plumbline.session import work_folder

    folder = Path(work_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with Evaluation(table, FEATURES, "y") as e:
        e.cross_validate([default_logistic()])
        assert len(set(folder.iterdir()) - before) == 2
    assert set(folder.iterdir()) == before


def test_configurations_outside_the_space_are_not_refitted(spark, evaluation):
    def best(params):
        rows = spark.createDataFrame([("agent", 4, 0.5, json.dumps(params))], "log string, trial_index long, mean_score double, p string")
        return rows.withColumn("params", F.parse_json("p"))

    wrong = {"estimator": "random_forest", "n_estimators": 9, "max_depth": "deep"}
    row = reports.best_configurations(best(wrong)).first()
    assert row["reasons"] == ["n_estimators", "max_depth", "min_samples_leaf", "max_features", "class_weight"]
    with pytest.raises(ValueError, match="agent 4: n_estimators, max_depth"):
        reports.parametric_entries(evaluation, best(wrong))
    kept = reports.parametric_entries(evaluation, best(LOGISTIC | {"note": [1, "x"]}))
    assert json.loads(kept.select(F.to_json("best_params")).first()[0]) == LOGISTIC | {"note": [1, "x"]}


def test_forests_are_fitted_in_pieces_that_the_driver_can_hold(table, monkeypatch):
    fitted = []
    fit = RandomForestClassifier.fit

    def counted(self, rows):
        made = fit(self, rows)
        fitted.append((self.getNumTrees(), self.getSeed(), made.totalNumNodes))
        return made

    monkeypatch.setattr(RandomForestClassifier, "fit", counted)
    model, most = forest_model(FOREST), 1500
    with Evaluation(table, FEATURES, "y", row_id="id", max_nodes=5 * most) as e:
        pieces = average_precision(e.fold_scores(model, 1), "_y", "score").first()
        own = list(fitted)
        records = e.cross_validate([model]).first()
    assert sum(n for n, _, _ in own) == FOREST["n_estimators"] and len(own) > 2
    assert len({seed for _, seed, _ in own}) == len(own)
    assert all(nodes <= most for _, _, nodes in own)
    assert records["fold_scores"][1] == pieces["ap"] and sum(n for n, _, _ in fitted) == 6 * FOREST["n_estimators"]
    with Evaluation(table, FEATURES, "y") as e:
        fitted.clear()
        whole = average_precision(e.fold_scores(model, 1), "_y", "score").first()
    assert [n for n, _, _ in fitted] == [FOREST["n_estimators"]]
    assert whole["n"] == pieces["n"] and pieces["ap"] == pytest.approx(whole["ap"], abs=0.05)
