"""Forests grown in the tasks: against a tree by plain recursion, whole rows, and Spark's own forest."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from plumbline.operators import forest
from plumbline.operators.models import Evaluation, forest_model
from plumbline.operators.ranking import average_precision
from plumbline.operators.splits import assign_splits

DEEP = {"estimator": "random_forest", "n_estimators": 12, "max_depth": 30, "min_samples_leaf": 1, "max_features": "sqrt", "class_weight": "balanced"}


def plain_tree(codes, b0, b1, by, depth=0):
    """Zeros, ones, and below a split its feature, code and sides; merged like Spark's."""
    (w0, w1), zeros, ones = by.weights, int(b0.sum()), int(b1.sum())
    node, best = [zeros, ones, None], None

    def gini(a, b):
        return 1 - ((w0 * a) ** 2 + (w1 * b) ** 2) / (w0 * a + w1 * b) ** 2

    if depth < by.depth and zeros and ones:
        for j in range(codes.shape[1]):
            for c in sorted(set(codes[b0 + b1 > 0, j].tolist()))[:-1]:
                left = codes[:, j] <= c
                a, b = b0[left].sum(), b1[left].sum()
                if min(a + b, zeros - a + ones - b) < by.least:
                    continue
                share = (w0 * a + w1 * b) / (w0 * zeros + w1 * ones)
                gain = float(forest.gain_of(*map(np.float64, (a, b, zeros, ones)), by))
                assert gain == pytest.approx(gini(zeros, ones) - share * gini(a, b) - (1 - share) * gini(zeros - a, ones - b), abs=1e-9)
                if gain > forest.LEAST_GAIN and (best is None or gain > best[0]):
                    best = gain, j, c
    if best:
        left = codes[:, best[1]] <= best[2]
        sides = [plain_tree(codes[s], b0[s], b1[s], by, depth + 1) for s in (left, ~left)]
        says = [w1 * s[1] > w0 * s[0] for s in sides]
        if any(s[2] for s in sides) or says[0] != says[1]:
            node[2] = best[1], best[2], *sides
    return node


def plain_vote(node, cell, weights):
    while node[2]:
        j, c, left, right = node[2]
        node = left if cell[j] <= c else right
    return weights[1] * node[1] / (weights[0] * node[0] + weights[1] * node[1])


@pytest.mark.parametrize("depth, least, weights, bins", [(30, 1, (1.0, 1.0), 32), (4, 3, (0.6, 2.5), 32), (30, 2, (1.0, 1.0), 6)])
def test_trees_are_those_of_plain_recursion(depth, least, weights, bins):
    rng = np.random.default_rng(depth + least)
    codes = np.unique(rng.integers(0, 6, (150, 3)), axis=0).astype(np.uint8)
    n0, n1 = rng.integers(0, 4, len(codes)), rng.integers(0, 3, len(codes))
    by = forest.Settings(3, depth, least, 0.0, "all", 7, bins, weights)
    for tree in range(3):
        draws = np.random.default_rng([7, tree])
        plain = plain_tree(codes, draws.poisson(n0), draws.poisson(n1), by)
        found = forest.votes(forest.grown(codes, n0, n1, by, tree), codes, by)
        assert found == pytest.approx([plain_vote(plain, c, weights) for c in codes])
        assert len(set(found.tolist())) > 3


def test_counts_and_order_find_the_same_splits():
    rng, by = np.random.default_rng(1), forest.Settings(1, 9, 2, 0.0, "all", 0, 40, (1.0, 3.0))
    node, code = rng.integers(0, 30, 4000), rng.integers(0, 40, 4000).astype(np.uint8)
    b0, b1 = rng.poisson(1, 4000) + 1, rng.poisson(1, 4000)
    t0, t1 = np.bincount(node, b0), np.bincount(node, b1)
    for x, y in zip(forest.best_by_counts(code, b0, b1, node, t0, t1, by), forest.best_by_order(code, b0, b1, node, t0, t1, by)):
        assert x.tolist() == y.tolist()


def test_features_at_a_node_are_read_like_spark_reads_them():
    given = ["auto", "all", "sqrt", "log2", "onethird", "2", "99", "0.5", "1.0"]
    assert [forest.features_at_a_node(s, 9, 10) for s in given] == [3, 9, 3, 4, 3, 2, 9, 5, 9]
    assert forest.features_at_a_node("auto", 9, 1) == 9


@pytest.mark.parametrize("values", [forest.VALUES, 50])
def test_thresholds_come_from_all_rows(spark, monkeypatch, values):
    """One row of 30,000 has a value of its own, which a sample would miss; quantiles hold near-equal shares."""
    monkeypatch.setattr(forest, "VALUES", values)
    rows = spark.range(30_000).select(
        F.array(F.when(F.col("id") == 29_317, 7.0).otherwise(F.col("id") % 3), F.col("id") * 1.0).alias("x"), (F.col("id") % 2).cast("int").alias("y")
    )
    few, many = forest.thresholds(rows, 2, 32, (1.0, 1.0))
    assert few.tolist() == [0.5, 1.5, 4.5]
    assert len(many) == 31 and np.diff(many, prepend=0, append=30_000) == pytest.approx(30_000 / 32, abs=30_000 / 32 if values == 50 else 8)


@pytest.fixture(scope="module")
def table(spark):
    def noise(i):
        return (F.xxhash64("id", F.lit(i)) % 1000) / 1000.0

    df = spark.range(3000).select("id", noise(1).alias("a"), noise(2).alias("b"), noise(3).alias("c"), noise(4).alias("e"))
    df = df.select("id", "a", "b", "c", (F.col("a") + F.col("b") + F.col("e") * 0.4 > 0.6).cast("int").alias("y"))
    return assign_splits(df, "id", "y").cache()


def test_deep_forests_take_all_rows_without_the_driver(table, monkeypatch):
    """No rows are left out, no trees are gathered, and neither tasks nor the order of rows matter."""
    plain, drawn = forest.cell_count, []

    def seen(cells):
        drawn.append(sum(np.frombuffer(r[c], "<i8").sum() for r in cells.collect() for c in ("n0", "n1")))
        return plain(cells)

    def scores(rows, **bounds):
        with Evaluation(rows, ["a", "b", "c"], "y", row_id="id", **bounds) as e:
            found = e.fold_scores(forest_model(DEEP), 1)
            return sorted((r["_y"], r["score"]) for r in found.collect()), average_precision(found, "_y", "score").first()["ap"], e.statistics[1]["fit_rows"]

    with monkeypatch.context() as patch:
        patch.setattr(forest, "fits_a_task", lambda *_: False)
        spark_ap = scores(table)[1]
    monkeypatch.setattr(forest, "cell_count", seen)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: pytest.fail("gathered on the driver"))
    rows, ap, count = scores(table, max_nodes=5000)
    assert drawn == [count] and len(rows) == table.where("fold = 1").count()
    assert ap == pytest.approx(spark_ap, abs=0.05) and ap > 0.8
    monkeypatch.setattr(forest, "TASKS", 3)
    again = scores(table.repartition(7, "c"), max_nodes=5000)[0]
    assert [y for y, _ in again] == [y for y, _ in rows] and [s for _, s in again] == pytest.approx([s for _, s in rows])


def test_missing_values_and_labels_are_refused(table):
    for faulty, message in ((table.withColumn("a", F.when(F.col("id") > 40, F.col("a"))), "null"), (table.withColumn("y", F.when(F.col("id") < 40, 2).otherwise(F.col("y"))), "neither 0 nor 1")):
        with Evaluation(faulty, ["a", "b", "c"], "y", row_id="id", max_nodes=5000) as e, pytest.raises(Exception, match=message):
            e.cross_validate([forest_model(DEEP)])


def test_no_bound_on_fit_rows_unless_asked_for(table):
    """A fit part of any size is taken whole: here the statistics count three million rows more than there are."""
    with Evaluation(table, ["a", "b", "c"], "y", row_id="id", fit_partitions=2) as e:
        search = e._search(1)
        few = e.statistics[1].asDict()
        e._statistics[1] = type(e.statistics[1])(**few | {"fit_rows": few["fit_rows"] + 3_000_000})
        assert e._fit_rows(1) == few["fit_rows"] + 3_000_000
        assert e._fit_part(search, 1).count() == search.count()
        assert "left_semi" not in e._fit_part(search, 1)._jdf.queryExecution().toString().lower().replace("leftsemi", "left_semi")
