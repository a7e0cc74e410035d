"""Scoring many candidate expressions in one scan."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import FUNCTIONS, compile_expression, squared_loss
from plumbline.operators.ranking import average_precision
from plumbline.operators.scaling import fit_statistics, scale, views, with_fit_weights
from plumbline.sources.trial_logs import EXPRESSION_LOG

# Expressions compiled into one projection; more are scanned in further blocks, because one
# generated method per projection can only grow so far.
BLOCK = 64


@dataclass(frozen=True)
class Candidate:
    """An expression over feature names; with ``fold`` it is scored for that fold only."""

    name: str
    expression: str
    complexity: int | None = None
    fold: int | None = None


def _blocks(candidates: Sequence[Candidate]) -> Iterator[Sequence[Candidate]]:
    if not candidates:
        raise ValueError("no candidates")
    for start in range(0, len(candidates), BLOCK):
        yield candidates[start : start + BLOCK]


def _wanted(candidate: Candidate) -> Column:
    return F.lit(True) if candidate.fold is None else F.col("scaler_fold") == candidate.fold


def score_candidates(
    df: DataFrame,
    candidates: Sequence[Candidate],
    features: Sequence[str],
    target: str,
    folds: int = 5,
    functions: Mapping[str, tuple[int, Callable[..., Column]]] = FUNCTIONS,
) -> DataFrame:
    """Average precision of every candidate on its validation fold and on the holdout.

    Features are standardised with the statistics of the fold's fit part in both cases. Rows are
    read once: a search row goes with its own fold, a holdout row with every fold. The scores
    of a block are columns of one projection, in which what expressions share is computed once.
    Returns ``candidate, fold, ap, holdout_ap``.
    """
    statistics = fit_statistics(df, features, target, folds)
    every = F.array(*[F.lit(k) for k in range(folds)])
    own = F.when(F.col("fold").isNull(), every).otherwise(F.array("fold"))
    rows = df.withColumn("scaler_fold", F.explode(own))
    scaled = scale(rows, statistics, features).select(
        "scaler_fold", F.col("fold").isNull().alias("held"), F.col(target).alias("_y"), *features
    )
    variables = {x: F.col(x) for x in features}

    def long_form(block: Sequence[Candidate]) -> DataFrame:
        values = [
            compile_expression(c.expression, variables, functions).alias(f"_s{i}")
            for i, c in enumerate(block)
        ]
        scores = [
            F.struct(
                F.lit(c.name).alias("candidate"),
                F.col(f"_s{i}").alias("score"),
                _wanted(c).alias("wanted"),
            )
            for i, c in enumerate(block)
        ]
        wide = scaled.select("scaler_fold", "held", "_y", *values)
        return wide.select("scaler_fold", "held", "_y", F.inline(F.array(*scores))).where("wanted")

    scored = reduce(DataFrame.unionByName, [long_form(b) for b in _blocks(candidates)])
    by_part = average_precision(scored, "_y", "score", ["candidate", "scaler_fold", "held"])
    return by_part.groupBy("candidate", F.col("scaler_fold").alias("fold")).agg(
        F.max(F.when(~F.col("held"), F.col("ap"))).alias("ap"),
        F.max(F.when(F.col("held"), F.col("ap"))).alias("holdout_ap"),
    )


def candidate_losses(
    df: DataFrame,
    candidates: Sequence[Candidate],
    features: Sequence[str],
    target: str,
    folds: int = 5,
    loss: Callable[[Column, Column], Column] = squared_loss,
    functions: Mapping[str, tuple[int, Callable[..., Column]]] = FUNCTIONS,
) -> DataFrame:
    """Class-weighted mean loss of every candidate over the fit part of each fold.

    One sum per candidate, so nothing but ``folds`` rows is shuffled. Rows on which an
    expression has no value are left out. Returns ``candidate, fold, loss``.
    """
    statistics = fit_statistics(df, features, target, folds)
    rows = with_fit_weights(scale(views(df, "fit", folds), statistics, features), target)
    variables = {x: F.col(x) for x in features}
    label = F.col(target).cast("double")

    def block_losses(block: Sequence[Candidate]) -> DataFrame:
        sums = []
        for i, c in enumerate(block):
            value = loss(compile_expression(c.expression, variables, functions), label)
            weight = F.when(value.isNotNull() & _wanted(c), F.col("weight"))
            sums.append(F.try_divide(F.sum(weight * value), F.sum(weight)).alias(f"_l{i}"))
        entries = [
            F.struct(
                F.lit(c.name).alias("candidate"),
                F.col(f"_l{i}").alias("loss"),
                _wanted(c).alias("wanted"),
            )
            for i, c in enumerate(block)
        ]
        return (
            rows.groupBy("scaler_fold")
            .agg(*sums)
            .select(F.col("scaler_fold"), F.inline(F.array(*entries)))
            .where("wanted")
            .select("candidate", F.col("scaler_fold").alias("fold"), "loss")
        )

    return reduce(DataFrame.unionByName, [block_losses(b) for b in _blocks(candidates)])


def candidate_trials(
    df: DataFrame,
    candidates: Sequence[Candidate],
    features: Sequence[str],
    target: str,
    folds: int = 5,
    loss: Callable[[Column, Column], Column] = squared_loss,
    log: str = EXPRESSION_LOG,
    functions: Mapping[str, tuple[int, Callable[..., Column]]] = FUNCTIONS,
) -> DataFrame:
    """One trial record per candidate and fold, counted by fold and then complexity.

    The score is the validation fold's; training loss and holdout score are in the payload.
    Counting in one window is safe: rows are no more than the given list times the folds. They
    are computed here and now, since a record tells its time: all candidates share the scans, so
    ``wall_clock_s`` is what those took, ``cumulative_s`` the time from the start of the call.
    """
    start = time.perf_counter()
    scores = score_candidates(df, candidates, features, target, folds, functions)
    losses = candidate_losses(df, candidates, features, target, folds, loss, functions)
    spark = df.sparkSession
    texts = spark.createDataFrame(
        [(c.name, c.complexity, c.expression) for c in candidates],
        "candidate string, complexity int, expression string",
    )
    joined = scores.join(losses, ["candidate", "fold"], "left").join(texts, "candidate")
    in_order = Window.partitionBy(F.lit(log)).orderBy("fold", "complexity", "candidate")
    counted = joined.select(
        (F.row_number().over(in_order) - 1).cast("long").alias("trial_index"),
        F.to_json(F.struct("complexity", "expression")).alias("params"),
        F.col("ap").alias("mean_score"),
        F.to_json(F.struct("fold", "loss", "holdout_ap")).alias("payload"),
    )
    scan = time.perf_counter()
    rows = counted.collect()
    end = time.perf_counter()
    schema = "trial_index long, params string, mean_score double, payload string"
    return spark.createDataFrame(rows, schema).select(
        F.lit(log).alias("log"),
        F.lit(log).alias("arm"),
        "trial_index",
        F.parse_json("params").alias("params"),
        F.array("mean_score").alias("fold_scores"),
        "mean_score",
        F.lit(0.0).alias("std_score"),
        F.lit(end - scan).alias("wall_clock_s"),
        F.lit(end - start).alias("cumulative_s"),
        F.parse_json("payload").alias("payload"),
        F.current_timestamp().alias("timestamp"),
    )
