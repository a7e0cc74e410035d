import math
import random
from collections import defaultdict

import pytest

from plumbline.operators.ranking import (
    average_precision,
    flag_average_precision,
    fold_summary,
    prevalence,
)

# Counts (hits, positives, rows) and the average precision they give.
GOLDENS = [
    (44, 54, 1600, 0.8210648148148147),
    (48, 54, 1600, 0.8926388888888889),
    (41, 54, 1600, 0.7673842592592593),
    (49, 54, 1600, 0.9105324074074075),
    (48, 55, 1600, 0.8771022727272727),
    (57, 68, 2000, 0.843735294117647),
    (0, 54, 1600, 0.03375),
    (0, 68, 2000, 0.034),
]


def counted_rows(key, hits, positives, rows):
    return (
        [(key, 1, 1.0)] * hits
        + [(key, 1, 0.0)] * (positives - hits)
        + [(key, 0, 0.0)] * (rows - positives)
    )


def brute_force(pairs):
    """Straight from the definition, one threshold per distinct score."""
    pairs = [
        (y, -math.inf if s is None or math.isnan(s) else s) for y, s in pairs if y is not None
    ]
    total = sum(y for y, _ in pairs)
    if not total:
        return None
    result, recall = 0.0, 0.0
    for threshold in sorted({s for _, s in pairs}, reverse=True):
        taken = [y for y, s in pairs if s >= threshold]
        result += (sum(taken) / total - recall) * sum(taken) / len(taken)
        recall = sum(taken) / total
    return result


def test_goldens(spark):
    rows = [r for i, (h, p, n, _) in enumerate(GOLDENS) for r in counted_rows(i, h, p, n)]
    df = spark.createDataFrame(rows, "k int, y int, s double")
    for scored in (
        average_precision(df, "y", "s", ["k"]),
        flag_average_precision(df.withColumn("s", df.s.cast("int")), "y", "s", ["k"]),
    ):
        found = {r["k"]: r["ap"] for r in scored.collect()}
        for i, (_, _, _, expected) in enumerate(GOLDENS):
            assert found[i] == pytest.approx(expected, abs=1e-12)


def test_fold_summary_golden(spark):
    rows = [r for i, (h, p, n, _) in enumerate(GOLDENS[:5]) for r in counted_rows(i, h, p, n)]
    df = spark.createDataFrame(rows, "k int, y int, s double")
    summary = fold_summary(average_precision(df, "y", "s", ["k"])).first()
    assert summary["mean_score"] == pytest.approx(0.8537445286195287, abs=1e-12)
    assert summary["std_score"] == pytest.approx(0.052553360437042916, abs=1e-12)
    assert summary["folds"] == 5


def test_no_positives_is_null(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.7)], "y int, s double")
    assert average_precision(df, "y", "s").first()["ap"] is None
    assert flag_average_precision(df.selectExpr("y", "1 AS s"), "y", "s").first()["ap"] is None


@pytest.mark.parametrize("buckets", [1, 2, 8, 64])
def test_against_definition_with_a_hot_key_ties_and_missing_scores(spark, buckets):
    draw = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 else draw.choice(["a", "b", None])
        score = draw.choice([None, math.nan, 0.0, -0.0, draw.gauss(0, 1), round(draw.gauss(0, 1), 1)])
        label = draw.choice([0, 0, 0, 1, None])
        rows.append((key, label, score))
    df = spark.createDataFrame(rows, "k string, y int, s double")
    found = {
        r["k"]: r["ap"] for r in average_precision(df, "y", "s", ["k"], buckets=buckets).collect()
    }
    groups = defaultdict(list)
    for key, label, score in rows:
        groups[key].append((label, score))
    assert set(found) == set(groups)
    for key, pairs in groups.items():
        assert found[key] == pytest.approx(brute_force(pairs), abs=1e-12)


def test_prevalence(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (0,)], "y int")
    assert prevalence(df, "y").first()["prevalence"] == 0.25
