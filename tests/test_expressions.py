import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.expressions import FUNCTIONS, compile_expression, logistic_loss, squared_loss
from plumbline.operators.candidates import (
    BLOCK,
    Candidate,
    candidate_losses,
    candidate_trials,
    score_candidates,
)
from plumbline.operators.ranking import average_precision
from plumbline.operators.splits import assign_splits


def value(spark, text, **variables):
    df = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in variables.items()] or ["id"])
    return df.select(compile_expression(text, {k: F.col(k) for k in variables}).alias("v")).first()["v"]


def test_functions_of_ones_own(spark):
    own = FUNCTIONS | {"square": (1, lambda a: a * a), "pick": (3, lambda a, b, c: F.when(a > 0, b).otherwise(c))}
    df = spark.range(1).select(F.lit(-3.0).alias("x"))
    made = compile_expression("pick(x, 1.0, square(x)) + max(x, 0.5)", {"x": F.col("x")}, own)
    assert df.select(made.alias("v")).first()["v"] == 9.5
    for text in ("square(x)", "max(x)", "pick(x, x)"):
        with pytest.raises(ValueError):
            compile_expression(text, {"x": F.col("x")}, FUNCTIONS if text == "square(x)" else own)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("0.4375", 0.4375),
        ("y - max(x, 1.5)", 1.5),
        ("min(x * y, 4.0)", -6.0),
        ("y * 0.25 - x", 2.75),
        ("greater(x, y)", 0.0),
        ("greater(x, x)", 0.0),
        ("less(x, y)", 1.0),
        ("logical_or(greater(x, y), less(x, y))", 1.0),
        ("logical_and(greater(x, y), less(x, y))", 0.0),
        ("-x / 4", 0.5),
        ("1e-3 * y", 0.003),
    ],
)
def test_values(spark, text, expected):
    assert value(spark, text, x=-2.0, y=3.0) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "text", ["1 / x", "max(1.0, 1 / x)", "min(y, 2.0 / (x * 3.0))", "max(z, 1.0)", "min(w, 1.0)"]
)
def test_no_value_stays_no_value_through_max_and_min(spark, text):
    assert value(spark, text, x=0.0, y=1.0, z=None, w=math.nan) is None


@pytest.mark.parametrize(
    "text",
    ["__import__('os')", "x.real", "x ** 2", "unknown + 1", "max(x)", "exp(x)", "'a'", "True", "x +",
     "max(x, y=1)", "[x]"],
)
def test_anything_else_is_refused(spark, text):
    with pytest.raises(ValueError):
        compile_expression(text, {"x": F.col("x")})


def test_losses(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0)], "p double, y double")
    row = df.select(
        F.avg(squared_loss(F.col("p"), F.col("y"))).alias("s"),
        F.avg(logistic_loss(F.col("p"), F.col("y"))).alias("l"),
    ).first()
    s = 1 / (1 + math.exp(-0.5))
    assert row["s"] == 0.25
    assert row["l"] == pytest.approx(-(math.log(s + 1e-9) + math.log(1 - s + 1e-9)) / 2, abs=1e-15)


@pytest.fixture(scope="module")
def split(spark):
    df = spark.range(1000).select(
        "id",
        (F.xxhash64("id") % 7 == 0).cast("int").alias("y"),
        (F.xxhash64("id", F.lit(1)) % 50).cast("double").alias("a"),
        (F.xxhash64("id", F.lit(2)) % 9).cast("double").alias("b"),
    )
    return assign_splits(df, "id", "y").cache()


def test_scores_of_a_monotone_expression_equal_those_of_the_column(split):
    scores = score_candidates(split, [Candidate("a", "a * 2.0"), Candidate("c", "0.5")], ["a", "b"], "y")
    rows = {(r["candidate"], r["fold"]): r for r in scores.collect()}
    assert len(rows) == 10
    direct = {
        r["fold"]: r["ap"]
        for r in average_precision(split.where("NOT is_holdout"), "y", "a", ["fold"]).collect()
    }
    held = average_precision(split.where("is_holdout"), "y", "a").first()["ap"]
    for k in range(5):
        assert rows[("a", k)]["ap"] == pytest.approx(direct[k], abs=1e-12)
        assert rows[("a", k)]["holdout_ap"] == pytest.approx(held, abs=1e-12)
        part = split.where(F.col("fold") == k).agg(F.avg("y")).first()[0]
        assert rows[("c", k)]["ap"] == pytest.approx(part, abs=1e-12)


def test_constant_half_has_loss_a_quarter(split):
    losses = candidate_losses(split, [Candidate("half", "0.5")], ["a", "b"], "y")
    assert [r["loss"] for r in losses.collect()] == pytest.approx([0.25] * 5, abs=1e-12)


def test_candidates_of_one_fold_and_more_than_one_block(split):
    many = [Candidate(f"e{i}", f"a + {i}.0 * b", 3, fold=i % 5) for i in range(BLOCK + 6)]
    scores = score_candidates(split, many, ["a", "b"], "y")
    losses = candidate_losses(split, many, ["a", "b"], "y", loss=logistic_loss)
    for df in (scores, losses):
        assert {(r["candidate"], r["fold"]) for r in df.collect()} == {(c.name, c.fold) for c in many}
    rows = candidate_trials(split, many, ["a", "b"], "y").withColumns(
        {
            "fold": F.try_variant_get("payload", "$.fold", "int"),
            "loss": F.try_variant_get("payload", "$.loss", "double"),
            "held": F.try_variant_get("payload", "$.holdout_ap", "double"),
        }
    ).drop("params", "payload").orderBy("trial_index").collect()
    assert [r["trial_index"] for r in rows] == list(range(len(many)))
    assert [r["fold"] for r in rows] == sorted(c.fold for c in many)
    assert all(r["fold_scores"] == [r["mean_score"]] and r["std_score"] == 0.0 for r in rows)
    assert all(r["loss"] > 0 and 0 <= r["held"] <= 1 for r in rows)


def test_empty_candidate_list_is_an_error(split):
    with pytest.raises(ValueError):
        score_candidates(split, [], ["a"], "y")
