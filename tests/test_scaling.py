import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.scaling import (
    WHOLE_SEARCH,
    fit_statistics,
    scale,
    views,
    with_fit_weights,
    with_interactions,
)


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(4)
    n = 400
    return {
        "id": np.arange(n),
        "fold": draw.integers(0, 6, n),  # 5 stands for the holdout
        "y": (draw.random(n) < 0.2).astype(int),
        "a": draw.normal(1e9, 1e-2, n),  # a spread far below the mean
        "b": draw.normal(0, 3, n),
        "c": np.full(n, 7.0),
    }


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [tuple(v.item() for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, c double")
    return df.withColumn("fold", F.when(F.col("fold") < 5, F.col("fold"))).cache()


def test_statistics_match_direct_computation(table, data):
    rows = {r["scaler_fold"]: r for r in fit_statistics(table, ["a", "b", "c"], "y", 5).collect()}
    assert set(rows) == {WHOLE_SEARCH, 0, 1, 2, 3, 4}
    for k, r in rows.items():
        fit = (data["fold"] != k) & (data["fold"] < 5)
        assert r["fit_rows"] == fit.sum() and r["fit_ones"] == data["y"][fit].sum()
        for x in "abc":
            assert r[f"mu_{x}"] == pytest.approx(data[x][fit].mean(), rel=1e-13)
            assert r[f"sd_{x}"] == pytest.approx(data[x][fit].std(), rel=1e-6, abs=1e-9)


def test_scaling_uses_the_own_fold_and_spares_constants(table, data):
    statistics = fit_statistics(table, ["b", "c"], "y", 5)
    rows = scale(views(table, "validation", 5), statistics, ["b", "c"]).collect()
    assert len(rows) == (data["fold"] < 5).sum()
    for r in rows:
        fit = (data["fold"] != r["fold"]) & (data["fold"] < 5)
        z = (data["b"][r["id"]] - data["b"][fit].mean()) / data["b"][fit].std()
        assert r["b"] == pytest.approx(z, abs=1e-9) and r["c"] == 0.0


def test_views_pair_rows_with_folds(table, data):
    held = int((data["fold"] == 5).sum())
    assert views(table, "holdout", 5).count() == held * 5
    assert views(table, "fit", 5).count() == (400 - held) * 4
    assert views(table, "fit", 5).where("fold = scaler_fold").count() == 0
    with pytest.raises(ValueError):
        views(table, "other", 5)


def test_fit_weights_balance_each_fit_part(table):
    statistics = fit_statistics(table, ["b"], "y", 5)
    weighted = with_fit_weights(scale(views(table, "fit", 5), statistics, ["b"]), "y")
    totals = {
        (r["scaler_fold"], r["y"]): r["w"]
        for r in weighted.groupBy("scaler_fold", "y").agg(F.sum("weight").alias("w")).collect()
    }
    for k in range(5):
        assert totals[(k, 0)] == pytest.approx(totals[(k, 1)])


def test_interactions_are_products_of_pairs(table):
    widened, names = with_interactions(table, ["a", "b", "c"])
    assert names == ["a", "b", "c", "a_x_b", "a_x_c", "b_x_c"]
    assert widened.where("b_x_c <> b * c").count() == 0
    eight = [f"x{i}" for i in range(8)]
    wide = table.select(*[F.col("b").alias(x) for x in eight])
    assert len(with_interactions(wide, eight)[1]) == 36
