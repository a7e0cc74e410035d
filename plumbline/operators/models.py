"""Classifiers scored on fixed folds and a holdout.

Input tables carry the feature columns, a 0/1 target, ``is_holdout`` and ``fold``. Logistic models
of all folds and configurations are fitted together, one pass over the table for each Newton step.
Other classifiers are Spark ML estimators whose fits are independent jobs; a few run at a time,
each of them spread over the whole cluster. Forests of many rows, and deep ones too large for the driver, are
grown in the tasks instead (``operators.forest``), from all rows and without gathering trees. Where a fit part
has too many distinct rows for a task, Spark's forest is fitted some trees at a time: each piece adds its votes
to the written scores and is dropped. The scored rows of all fits are ranked by one keyed job.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.params import CLASS_WEIGHTS, FOREST, LOGISTIC
from plumbline.operators import forest
from plumbline.operators.logistic import Fit, JointFits
from plumbline.operators.ranking import average_precision
from plumbline.operators.scaling import (
    WHOLE_SEARCH,
    balanced_weight,
    fit_statistics,
    standardised,
    with_interactions,
)
from plumbline.operators.splits import stratified_sample
from plumbline.session import remove_tables, written_table

MAX_DEPTH = 30  # the deepest tree Spark grows
DEEP = 10  # beyond this, remembering each row's node beats walking the trees again
CONCURRENT_FITS = 5  # fits at a time
# Spark's forest draws its samples per partition, so the number of partitions follows the rows and
# nothing else: not the cores, not the session, not how the rows arrive.
ROWS_PER_PARTITION = 100_000
LEAST_PARTITIONS = 8
# From more rows than this Spark's forest chooses thresholds from a sample; it isn't used for them.
SPARK_FOREST_ROWS = 10_000
# Tree nodes that all fits together hold on the driver, some 500 bytes each.
MAX_NODES = 400_000
SPARE = 1.25  # of a tree's nodes, as other trees of the forest may have more
SEED_STEP = 1_000_003  # between pieces of a forest; Spark adds the number of a partition to a seed


@dataclass(frozen=True)
class Model:
    """How to prepare the features and which estimator to fit on them.

    ``estimator`` gets the number of fit rows and returns an unfitted classifier with a
    probability column; any ``pyspark.ml`` classifier will do.
    """

    name: str
    estimator: Callable[[int], Any]
    scaled: bool = False
    interactions: bool = False
    balanced: bool = False
    params: Mapping[str, Any] = field(default_factory=dict)
    #: Inverse penalty and whether it is L1; models that have it are fitted together.
    penalty: tuple[float, bool] | None = None

    def joint(self, fold: int) -> Fit:
        """This logistic model as one of many joint fits."""
        c, l1 = self.penalty
        return Fit(fold, c, l1, self.interactions, self.balanced)


def logistic_model(params: Mapping[str, Any], name: str = LOGISTIC) -> Model:
    """Logistic branch: standardise, optionally add products, fit with an L1 or L2 penalty.

    Spark averages the loss over the rows while C multiplies its sum, hence the division by
    the number of fit rows (which is also the total of the balanced weights).
    """

    def build(fit_rows: int) -> LogisticRegression:
        return LogisticRegression(
            regParam=1.0 / (params["C"] * fit_rows),
            elasticNetParam=1.0 if params["penalty"] == "l1" else 0.0,
            standardization=False,
            maxIter=1000,
        )

    return Model(
        name,
        build,
        scaled=True,
        interactions=bool(params["use_interactions"]),
        balanced=_balanced(params),
        params=params,
        penalty=(params["C"], params["penalty"] == "l1"),
    )


def _balanced(params: Mapping[str, Any]) -> bool:
    """Whether classes are weighted; anything but the known modes is an error, a missing one too."""
    if params["class_weight"] not in CLASS_WEIGHTS:
        raise ValueError(f"unknown class weight {params['class_weight']!r}")
    return params["class_weight"] != CLASS_WEIGHTS[0]


def forest_model(params: Mapping[str, Any], seed: int = 0, name: str = FOREST) -> Model:
    """Forest branch. Spark weighs rows before sampling, so both balanced modes are one."""

    def build(fit_rows: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            numTrees=params["n_estimators"],
            maxDepth=params["max_depth"],
            minInstancesPerNode=params["min_samples_leaf"],
            featureSubsetStrategy=params["max_features"],
            seed=seed,
            maxMemoryInMB=512,
            cacheNodeIds=params["max_depth"] > DEEP,
        )

    return Model(name, build, balanced=_balanced(params), params=params)


def build_model(params: Mapping[str, Any], seed: int = 0, name: str | None = None) -> Model:
    """Model of a valid configuration of either branch."""
    if params["estimator"] == LOGISTIC:
        return logistic_model(params, name or LOGISTIC)
    if params["estimator"] == FOREST:
        return forest_model(params, seed, name or FOREST)
    raise ValueError(f"unknown estimator {params['estimator']!r}")


def default_logistic() -> Model:
    """Unweighted L2 logistic regression with C = 1 on standardised features."""
    return logistic_model(
        {"C": 1.0, "penalty": "l2", "use_interactions": False, "class_weight": "none"},
        "baseline_default_logistic",
    )


def default_forest(seed: int = 0) -> Model:
    """A hundred unweighted trees, grown as deep as Spark allows."""
    return forest_model(
        {
            "n_estimators": 100,
            "max_depth": MAX_DEPTH,
            "min_samples_leaf": 1,
            "max_features": "sqrt",
            "class_weight": "none",
        },
        seed,
        "baseline_default_forest",
    )


class Room:
    """So many at a time over all threads; who asks for more than there is waits for all of it."""

    def __init__(self, size: int) -> None:
        self.size = self.free = size
        self.changed = threading.Condition()

    @contextmanager
    def taken(self, wanted: int) -> Iterator[None]:
        wanted = min(wanted, self.size)
        with self.changed:
            self.changed.wait_for(lambda: self.free >= wanted)
            self.free -= wanted
        try:
            yield
        finally:
            with self.changed:
                self.free += wanted
                self.changed.notify_all()


class Evaluation:
    """A split table prepared once and scored by many models.

    Keeps only the needed columns, written to the checkpoint folder and held in memory with
    spill to disk: a lost part is read again rather than computed again, and the many short
    jobs of a fit do not carry the plan of the split. The fit statistics of all folds,
    ``folds + 1`` rows, are the only data on the driver. Use as a context manager to release
    the memory and delete what was written.

    Args:
        row_id: Column that tells rows apart; needed only with ``max_fit_rows``.
        max_fit_rows: Rows that one Spark ML fit takes at most, evenly by class, for callers that ask for
            a sample; by default a fit takes all rows, and joint fits do in any case.
        fit_partitions: Partitions of such a fit, by default one for ``ROWS_PER_PARTITION`` rows.
        max_nodes: Nodes of trees that the driver holds at a time, except that one tree is whole.
    """

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str],
        target: str,
        folds: int = 5,
        keep: Sequence[str] = (),
        row_id: str | None = None,
        max_fit_rows: int | None = None,
        fit_partitions: int | None = None,
        max_nodes: int = MAX_NODES,
    ) -> None:
        self.features, self.target, self.folds = list(features), target, folds
        self.row_id, self.max_fit_rows, self.fit_partitions = row_id, max_fit_rows, fit_partitions
        self.spark = df.sparkSession
        self._written: list[str] = []
        needed = df.select(
            *self.features,
            F.col(target).cast("int").alias(target),
            "is_holdout",
            "fold",
            *keep,
            *[c for c in [row_id] if c and c not in keep],
        )
        self.table = self._keep(needed, "evaluated").persist(StorageLevel.MEMORY_AND_DISK)
        statistics = fit_statistics(self.table, self.features, target, folds)
        self._statistics: dict[int, Row] = {
            row["scaler_fold"]: row for row in statistics.collect()
        }
        self.joint = JointFits(self.table, self.features, target, self._statistics)
        self._concurrent = CONCURRENT_FITS
        self._room = Room(max_nodes)
        self._cells: dict[tuple, Future] = {}
        self._lock = threading.Lock()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        table, path = written_table(df, name)
        self._written.append(path)
        return table

    def __enter__(self) -> Evaluation:
        return self

    def __exit__(self, *_) -> None:
        self.table.unpersist()
        remove_tables(self.spark, self._written)

    @property
    def statistics(self) -> Mapping[int, Row]:
        """Fit statistics by ``scaler_fold``."""
        return self._statistics

    def _prepared(self, model: Model, rows: DataFrame, scaler_fold: int) -> DataFrame:
        """Features as a vector, scaled and weighted by the statistics of one fit part."""
        fit, used = self._statistics[scaler_fold], self.features
        weight = F.lit(1.0)
        if model.balanced:
            weight = balanced_weight(
                F.col(self.target), F.lit(fit["fit_rows"]), F.lit(fit["fit_ones"])
            )
        ready = rows.withColumn("weight", weight)
        if model.scaled:
            ready = ready.withColumns(
                {
                    x: standardised(F.col(x), F.lit(fit[f"mu_{x}"]), F.lit(fit[f"sd_{x}"]))
                    for x in used
                }
            )
        if model.interactions:
            ready, used = with_interactions(ready, used)
        return VectorAssembler(
            inputCols=used, outputCol="features", handleInvalid="error"
        ).transform(ready.select(*used, self.target, "weight"))

    def _laid_out(self, rows: DataFrame, count: int) -> DataFrame:
        """The rows dealt by their values and sorted, so that a fit doesn't depend on how they arrived."""
        parts = self.fit_partitions or max(LEAST_PARTITIONS, -(-count // ROWS_PER_PARTITION))
        names = [*self.features, self.target]
        return rows.repartition(parts, *names).sortWithinPartitions(*names)

    def _fit_rows(self, scaler_fold: int) -> int:
        count = self._statistics[scaler_fold]["fit_rows"]
        return count if self.max_fit_rows is None else min(count, self.max_fit_rows)

    def _fit_part(self, rows: DataFrame, scaler_fold: int) -> DataFrame:
        """The rows of a fit: all of them, unless the caller has set a bound."""
        count = self._statistics[scaler_fold]["fit_rows"]
        if count > self._fit_rows(scaler_fold):
            if self.row_id is None:
                raise ValueError(f"{count} rows to fit, more than {self.max_fit_rows}: name a row_id to sample by")
            rows = stratified_sample(rows, self.row_id, self.target, self.max_fit_rows)
            count = self.max_fit_rows
        return self._laid_out(rows, count)

    def _estimator(self, model: Model, scaler_fold: int):
        estimator = model.estimator(self._fit_rows(scaler_fold))
        return estimator.copy(
            {
                estimator.featuresCol: "features",
                estimator.labelCol: self.target,
                estimator.weightCol: "weight",
            }
        )

    def _search(self, scaler_fold: int) -> DataFrame:
        """The rows to fit on."""
        search = self.table.where(~F.col("is_holdout"))
        return search if scaler_fold == WHOLE_SEARCH else search.where(F.col("fold") != scaler_fold)

    def _held(self, scaler_fold: int) -> DataFrame:
        """The rows to score: those of the fold, or the holdout."""
        held = F.col("is_holdout")
        return self.table.where(held if scaler_fold == WHOLE_SEARCH else ~held & (F.col("fold") == scaler_fold))

    @property
    def _share(self) -> int:
        """Tree nodes on the driver that one of the concurrent fits may have."""
        return self._room.size // self._concurrent

    def _most_nodes(self, estimator: RandomForestClassifier, scaler_fold: int) -> int:
        """The nodes that a tree may have."""
        leaves = 2 * self._fit_rows(scaler_fold) // estimator.getMinInstancesPerNode()
        return min(2 ** (estimator.getMaxDepth() + 1) - 1, leaves + 1)

    def _pieces(self, model: Model, scaler_fold: int) -> Iterator[tuple[Any, float]]:
        """Spark ML models fitted one after the other, each with its share of the score.

        A forest whose trees could have too many nodes together begins with one tree, whose nodes
        tell how many trees are fitted next.
        """
        estimator = self._estimator(model, scaler_fold)
        rows = self._prepared(model, self._fit_part(self._search(scaler_fold), scaler_fold), scaler_fold)
        if not isinstance(estimator, RandomForestClassifier):
            yield estimator.fit(rows), 1.0
            return
        trees, seed, done = estimator.getNumTrees(), estimator.getSeed(), 0
        most, share = self._most_nodes(estimator, scaler_fold), self._share
        size, nodes = (trees, most) if trees * most <= share else (1, most)
        largest = 0
        while done < trees:
            size = min(size, trees - done)
            with self._room.taken(int(size * nodes)):
                piece = estimator.copy({estimator.numTrees: size, estimator.seed: seed + done * SEED_STEP})
                fitted = piece.fit(rows)
                largest = max(largest, *(t.numNodes for t in fitted.trees))
                yield fitted, size / trees
                del fitted
            done += size
            nodes = SPARE * largest
            size = max(1, int(share / nodes))

    def _forest_scores(self, model: Model, scaler_fold: int) -> DataFrame | None:
        """``_y, score``, written, by a forest grown in the tasks; none where that isn't for this model or its rows."""
        estimator, fit = self._estimator(model, scaler_fold), self._statistics[scaler_fold]
        rows, ones = fit["fit_rows"], fit["fit_ones"]
        if type(estimator) is not RandomForestClassifier or self._fit_rows(scaler_fold) < rows:
            return None
        too_large = estimator.getMaxDepth() > DEEP and estimator.getNumTrees() * self._most_nodes(estimator, scaler_fold) > self._share
        if rows <= SPARK_FOREST_ROWS and not too_large:
            return None
        weights = (1.0, 1.0)
        if model.balanced:
            weights = tuple(rows / (2.0 * n) if n else 1.0 for n in (rows - ones, ones))
        by = forest.settings(estimator, weights)
        if by is None:
            return None
        key = (scaler_fold, by.bins, weights, model.scaled, model.interactions)
        with self._lock:
            first = key not in self._cells
            made = self._cells.setdefault(key, Future())
        if first:  # several models share the cells of a fit part
            try:
                made.set_result(self._in_cells(model, scaler_fold, by))
            except BaseException as fault:
                made.set_exception(fault)
        own, held, width = made.result()
        if own is None:
            return None
        return self._keep(forest.scored(own, held, width, by), "votes")

    def _in_cells(self, model: Model, scaler_fold: int, by: forest.Settings) -> tuple[DataFrame | None, DataFrame | None, int]:
        """The fit part and the rows to score as written cells, and the number of features; no cells if too many for a task."""
        y = F.col(self.target)
        known = F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.lit(f"{self.target} is neither 0 nor 1")).cast("int"))

        def prepared(rows: DataFrame, y: Column) -> DataFrame:
            ready = self._prepared(model, rows, scaler_fold)
            return ready.select(vector_to_array("features").alias("x"), y.alias("y"))

        rows = prepared(self._search(scaler_fold), known)
        held = prepared(self._held(scaler_fold).where(y.isNotNull()), known)
        width = len(self.features) * (len(self.features) + 1) // 2 if model.interactions else len(self.features)
        cut = forest.thresholds(rows, width, by.bins, by.weights)
        count = self._statistics[scaler_fold]["fit_rows"]
        own = self._keep(forest.slices(rows, count, cut), "cells")
        if not forest.fits_a_task(forest.cell_count(own), width):
            return None, None, width
        return own, self._keep(forest.slices(held, count // max(1, self.folds - 1), cut), "cells"), width

    def _scores(self, model: Model, scaler_fold: int) -> DataFrame:
        """``_y, score``, written, on the fold's own rows or on the holdout, by a classifier fitted on the others."""
        grown = self._forest_scores(model, scaler_fold)
        if grown is not None:
            return grown
        rows = self._prepared(model, self._held(scaler_fold), scaler_fold)
        rows, path = rows.select(F.col(self.target).alias("_y"), "features", F.lit(0.0).alias("score")), None
        for fitted, share in self._pieces(model, scaler_fold):
            votes = F.col("score") + vector_to_array("probability")[1] * F.lit(share)
            scored = fitted.transform(rows).select("_y", "features", votes.alias("score"))
            rows, made = written_table(scored, "votes")
            del fitted, scored
            self._written.append(made)
            if path:
                remove_tables(self.spark, [path])
                self._written.remove(path)
            path = made
        return rows.select("_y", "score")

    def fold_scores(self, model: Model, fold: int) -> DataFrame:
        """Scores of the validation rows of a fold by a Spark ML model fitted on the other folds."""
        return self._scores(model, fold)

    def holdout_scores(self, model: Model) -> DataFrame:
        """Scores of the holdout by a Spark ML model fitted on the whole search part."""
        return self._scores(model, WHOLE_SEARCH)

    def _ranked(self, models: Sequence[Model], parts: Sequence[int]) -> list[tuple[int, int, float, float, float]]:
        """Average precision of every model on every part: ``model, part, ap, start, end``.

        Joint fits first, all of them pass by pass, then the others a few at a time. Scored rows
        are written and ranked together. A fit's time runs from its start to the end of its scores; that
        of a joint fit from the first pass to the last, as it takes part in all of them.
        """
        jobs = [(i, k) for i in range(len(models)) for k in parts]
        together = [(i, k) for i, k in jobs if models[i].penalty is not None]
        alone = [(i, k) for i, k in jobs if models[i].penalty is None]
        scored, times = [], {}
        if together:
            start = time.perf_counter()
            fits = [models[i].joint(k) for i, k in together]
            found = self.joint.fitted(fits)
            held = parts == [WHOLE_SEARCH]
            scored.append(self.joint.scores(fits, found, held).withColumnRenamed("fit", "job"))
            times |= {job: (start, time.perf_counter()) for job in together}
        tasks = [lambda i=i, k=k: self._scores(models[i], k) for i, k in alone]
        results = run_all(self.spark, tasks, self._concurrent)
        for n, ((i, k), (rows, start, end)) in enumerate(zip(alone, results), len(together)):
            scored.append(rows.select(F.lit(n).alias("job"), "_y", "score"))
            times[i, k] = start, end
        if not scored:
            return []
        every = self._keep(reduce(DataFrame.union, scored), "scored")
        ranked = average_precision(every, "_y", "score", ["job"]).select("job", "ap").collect()
        ap = {r["job"]: r["ap"] for r in ranked}
        return [(i, k, ap.get(n), *times[i, k]) for n, (i, k) in enumerate([*together, *alone])]

    def holdout_ap(self, models: Sequence[Model]) -> DataFrame:
        """Holdout average precision per model: ``arm, holdout_ap``."""
        ranked = sorted(self._ranked(models, [WHOLE_SEARCH]))
        return self.spark.createDataFrame(
            [(models[i].name, ap) for i, _, ap, _, _ in ranked], "arm string, holdout_ap double"
        )

    def cross_validate(self, models: Sequence[Model]) -> DataFrame:
        """One trial record per model over the shared folds.

        ``wall_clock_s`` is the time from the start of a model's first fit to the end of its last,
        ``cumulative_s`` the time from the start of this call to that end.
        """
        origin = time.perf_counter()
        ranked = sorted(self._ranked(models, list(range(self.folds))))
        rows = []
        for i, model in enumerate(models):
            own = [r for r in ranked if r[0] == i]
            start, end = min(r[3] for r in own), max(r[4] for r in own)
            scores = [r[2] for r in own]
            known = [s for s in scores if s is not None]
            mean = sum(known) / len(known) if known else None
            deviation = (sum((s - mean) ** 2 for s in known) / len(known)) ** 0.5 if known else None
            rows.append((i, model.name, scores, mean, deviation, end - start, end - origin))
        return self.spark.createDataFrame(rows, CROSS_VALIDATED)


CROSS_VALIDATED = (
    "trial_index long, arm string, fold_scores array<double>, mean_score double, "
    "std_score double, wall_clock_s double, cumulative_s double"
)


def settled(df: DataFrame) -> DataFrame:
    """Compute a frame with a row per arm now, so that it outlives the cached table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def as_records(by_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold scores in fold order with their mean and population deviation, per key."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "ap")))
    return by_fold.groupBy(*keys).agg(
        F.transform(ordered, lambda s: s["ap"]).alias("fold_scores"),
        F.avg("ap").alias("mean_score"),
        F.stddev_pop("ap").alias("std_score"),
    )


def run_all(
    spark: SparkSession, tasks: Sequence[Callable[[], Any]], parallelism: int
) -> list[tuple[Any, float, float]]:
    """Run driver-side calls a few at a time; results in order, with start and end times."""

    @inheritable_thread_target(spark)
    def timed(task: Callable[[], Any]) -> tuple[Any, float, float]:
        start = time.perf_counter()
        return task(), start, time.perf_counter()

    if not tasks:
        return []
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(timed, tasks, chunksize=1)
